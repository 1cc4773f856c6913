"""Removal of repeated windows: the distributed part that two operators share.

The question is which windows of a fixed number of units (bytes or words) start
more than once in the corpus. Only anchors are shuffled, one per some 170 bytes or
15 words:

1. Texts are reduced to distinct ones, within tasks before they are shuffled, and
   written as a table bucketed by the text's digest, so later joins do not move them.
2. Each text gives its anchors: a key (hash of the anchor's own units), a hash of
   the context, and the place. Anchors whose key no other anchor has are dropped.
3. Equal contexts are one row (partial aggregate). A context found twice is
   repeated as a whole, wherever it is.
4. Keys with several contexts: the contexts' units are fetched, one text for each
   distinct context, and a kernel that is given all distinct contexts of a key
   tells which of their windows others have too. A key with more than
   ``max_group`` contexts is split first, as often as needed: each half of the
   offsets that a window can have to the anchor makes a group of its own, keyed
   by the longer run of units that these windows share, until groups are small.
   Contexts that the clipping makes equal are one row again.
5. Spans of each text meet the text in the bucketed table, which is cut there.

No window is left out at any size; ``max_group`` only tells when to split.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from kgspark.llm.anchors import anchors
from kgspark.llm.common import map_rows, runs, shuffle_partitions, utf8
from kgspark.skew import lookup_join
from kgspark.storage import Scratch

SPAN = "array<struct<start:bigint,end:bigint>>"
PLACE = 1 << 24  # packs a place, and the two distances of a context's ends


@dataclass(frozen=True)
class Alphabet:
    """What a text consists of.

    ``units`` gives the sequence of a text (bytes, or a list of words), ``hashes``
    a 64-bit number per unit, ``join`` the bytes of a part of a sequence, ``split``
    the sequence back. ``kernel(contexts, window)`` gets (left, right) sequences
    around a shared anchor and yields (index, units to the left, units to the
    right) of repeated runs.
    """

    window: int
    gram: int
    units: Callable[[bytes], object]
    hashes: Callable[[object], np.ndarray]
    join: Callable[[object], bytes]
    split: Callable[[bytes], object]
    kernel: Callable[[list[tuple], int], Iterable[tuple[int, int, int]]]


def _digest(column: str = "text"):
    return F.unhex(F.md5(column))


def _distinct_texts(docs: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """(tid, text): each text once, as a table bucketed by tid; texts come as bytes."""
    def once(rows):
        seen = set()
        for tid, text in rows:
            if tid not in seen:
                seen.add(tid)
                yield tid, text

    schema = "tid binary, text binary"
    n = shuffle_partitions(docs)
    here = map_rows(docs.select("tid", "text"), once, schema)
    there = map_rows(here.repartition(n, "tid"), once, schema)
    there.write.bucketBy(n, "tid").option("path", scratch.new_path("texts")).option("compression", "zstd").saveAsTable(name)
    return docs.sparkSession.table(name)


def _anchors(texts: DataFrame, alphabet: Alphabet, scratch: Scratch) -> DataFrame:
    """(key, ctx, tid, at, ends): ``ends`` packs the distances from the anchor to the
    first window's start and from the anchor to the last window's end."""
    window, gram = alphabet.window, alphabet.gram

    def find(rows):
        for tid, text in rows:
            hashes = alphabet.hashes(alphabet.units(text))
            if len(hashes) < window:
                continue
            flat = np.ascontiguousarray(hashes)
            for keys, places, first, last in anchors(flat, window, gram):
                left, right = places - first, last + window - places
                ends = left * PLACE + right
                for key, at, a, b, x, end in zip(
                    keys.tolist(), places.tolist(), first.tolist(), last.tolist(), left.tolist(), ends.tolist()
                ):
                    ctx = xxhash.xxh3_64_intdigest(memoryview(flat[a:b + window]), x) - (1 << 63)
                    yield key, ctx, tid, at, end

    return scratch.save(map_rows(
        texts.select("tid", "text"), find, "key bigint, ctx bigint, tid binary, at bigint, ends bigint"
    ), "anchors")


def _fetch(wanted: DataFrame, texts: DataFrame, alphabet: Alphabet) -> DataFrame:
    """(key, ctx, left, right): the units around the anchor of one occurrence of each context."""
    places = wanted.groupBy("tid").agg(F.collect_list(F.struct("key", "ctx", "at", "ends")).alias("places"))

    def cut(rows):
        for text, places in rows:
            units = alphabet.units(text)
            for p in places:
                at, left, right = p["at"], p["ends"] // PLACE, p["ends"] % PLACE
                yield p["key"], p["ctx"], alphabet.join(units[at - left:at]), alphabet.join(units[at:at + right])

    return map_rows(
        texts.join(places, "tid").select("text", "places"), cut, "key bigint, ctx bigint, left binary, right binary"
    )


def _repeated_in_groups(contexts: DataFrame, alphabet: Alphabet, scratch: Scratch, max_group: int) -> DataFrame:
    """(key, ctx, left, right): repeated runs, as units to the left and right of the anchor.

    Rows are members of groups: ``group`` and ``member`` hash what they share and
    what they have, ``low`` and ``high`` bound the offsets of the group's windows.
    """
    window = alphabet.window
    rows = contexts.select(
        F.col("key").alias("group"), F.col("ctx").alias("member"), "key", "ctx",
        F.lit(0).alias("low"), F.lit(window - alphabet.gram).alias("high"), "left", "right",
    )
    found, member = [], ["group", "member"]
    while True:
        sizes = scratch.save(
            rows.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "groups"
        )
        small = rows.join(sizes.where(F.col("members") <= max_group).select("group"), "group")
        found.append(scratch.save(_run_kernel(small, alphabet), "found"))
        if sizes.where(F.col("members") > max_group).isEmpty():
            break
        halves = _split(rows.join(sizes.where(F.col("members") > max_group).select("group"), "group"), alphabet)
        halves = scratch.save(halves, "halves")
        # Equal members of a half are repeats as a whole; one of them goes on for the others.
        counts = scratch.save(halves.groupBy(*member).agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "ctx")).alias("one")
        ), "members")
        whole = lookup_join(halves.withColumn("id", F.struct(*member)), counts.where("n > 1").select(
            F.struct(*member).alias("id")
        ), "id", how="inner")
        found.append(scratch.save(whole.select(
            "key", "ctx", F.col("n_left").alias("left"), F.col("n_right").alias("right")
        ), "found"))
        ones = counts.select(*member, "one.key", "one.ctx")
        rows = scratch.save(halves.join(ones, [*member, "key", "ctx"], "left_semi"), "rows")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _split(rows: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Each member once per half of its group's offsets that it has windows of."""
    window = alphabet.window

    def halve(rows):
        for group, key, ctx, low, high, left, right in rows:
            a, b = alphabet.split(left), alphabet.split(right)
            middle = (low + high) // 2
            for lo, hi in ((low, middle), (middle + 1, high)):
                # Windows start up to len(a) units before the anchor, and end up to len(b) after it.
                x0, x1 = max(lo, window - len(b)), min(hi, len(a))
                if lo > hi or x0 > x1:
                    continue
                cut = a[len(a) - x1:], b[:window - x0]
                core = alphabet.join(a[len(a) - lo:]) + b"\0" + alphabet.join(b[:window - hi])
                parts = [alphabet.join(c) for c in cut]
                yield (
                    xxhash.xxh3_64_intdigest(core, (group + lo) & 0xFFFFFFFFFFFFFFFF) - (1 << 63),
                    xxhash.xxh3_64_intdigest(b"\0".join(parts)) - (1 << 63), key, ctx, lo, hi, *parts,
                    len(cut[0]), len(cut[1]),
                )

    return map_rows(
        rows.select("group", "key", "ctx", "low", "high", "left", "right"), halve,
        "group bigint, member bigint, key bigint, ctx bigint, low int, high int, left binary, right binary, "
        "n_left bigint, n_right bigint",
    )


def _run_kernel(rows: DataFrame, alphabet: Alphabet) -> DataFrame:
    members = rows.select("group", "key", "ctx", "left", "right").repartition("group").sortWithinPartitions("group")

    def run(rows):
        for _, group in runs(rows, lambda r: r[0]):
            contexts = [(alphabet.split(r[3]), alphabet.split(r[4])) for r in group]
            best: dict[int, list[tuple[int, int]]] = {}
            for i, left, right in alphabet.kernel(contexts, alphabet.window):
                best.setdefault(i, []).append((left, right))
            for i, spans in best.items():
                for left, right in _outer(spans):
                    yield group[i][1], group[i][2], left, right

    return map_rows(members, run, "key bigint, ctx bigint, left bigint, right bigint")


def _outer(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (to the left, to the right) that no other one contains."""
    out, reach = [], -1 << 62
    for left, right in sorted(set(spans), key=lambda s: (-s[0], -s[1])):
        if right > reach:
            out.append((left, right))
            reach = right
    return out


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the units that spans cover."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


def repeated_spans(texts: DataFrame, alphabet: Alphabet, scratch: Scratch, max_group: int = 8192) -> DataFrame:
    """(tid, spans): what distinct texts (tid, text) repeat of other places.

    A text that has copies is repeated as a whole besides; that is not asked here.
    """
    placed = _anchors(texts, alphabet, scratch)
    # Written, so that the join reads two shuffles and Spark can split the rows of a hot key.
    keys = scratch.save(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    shared = scratch.save(placed.join(keys, "key"), "shared")
    scratch.drop(placed)
    contexts = scratch.save(shared.groupBy("key", "ctx").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("tid", "at", "ends")).alias("one")
    ), "contexts")
    several = scratch.save(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "several")
    wanted = contexts.join(several, "key").select("key", "ctx", "one.*")
    units = scratch.save(_fetch(wanted, texts, alphabet), "units")
    partial = _repeated_in_groups(units, alphabet, scratch, max_group)
    # A context found once has its place at hand; those found more often are repeated as a whole.
    single = contexts.where("n = 1").select("key", "ctx", "one.tid", "one.at").join(partial, ["key", "ctx"]).select(
        "tid", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("end")
    )
    often = contexts.where("n > 1").select(F.struct("key", "ctx").alias("id"))
    whole = lookup_join(shared.withColumn("id", F.struct("key", "ctx")), often, "id", how="inner").select(
        "tid", (F.col("at") - F.floor(F.col("ends") / PLACE)).alias("start"),
        (F.col("at") + F.col("ends") % PLACE).alias("end"),
    )
    return single.unionByName(whole).groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, alphabet: Alphabet, scratch: Scratch, max_group: int = 8192) -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept_sha256, kept) of each document.

    ``kept`` are the units that stay, as bytes; null if all stay.
    """
    spark, window = docs.sparkSession, alphabet.window
    sources = docs.select("doc_id", utf8()).withColumn("tid", _digest())
    refs = scratch.save(sources.select("doc_id", "tid"), "refs")

    def cut(rows):
        for tid, text, spans in rows:
            units = alphabet.units(text)
            n, removed = len(units), merge((s["start"], s["end"]) for s in spans or ())
            kept, at = [], 0
            for start, end in removed:
                kept.append(units[at:start])
                at = end
            kept.append(units[at:])
            whole = alphabet.join([u for part in kept for u in part] if isinstance(units, list) else b"".join(kept))
            yield (
                tid, n, sum(b - a for a, b in removed), len(removed), hashlib.sha256(whole).hexdigest(),
                whole if removed else None,
            )

    copies = refs.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"))
    name = f"texts_{uuid.uuid4().hex}"
    with Scratch(spark) as work:
        texts = _distinct_texts(sources.select("tid", "text"), name, work)
        spans = repeated_spans(texts, alphabet, work, max_group)
        judged = map_rows(
            texts.join(spans, "tid", "left").select("tid", "text", "spans"), cut,
            "tid binary, n_units bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary",
        )
        results = scratch.save(judged.join(copies, "tid"), "judged")
        spark.sql(f"DROP TABLE {name}")
    # A text with copies goes as a whole if it has a window.
    out = lookup_join(refs, results, "tid", how="inner")
    gone = (F.col("copies") > 1) & (F.col("n_units") >= window)
    return out.select(
        "doc_id", "n_units",
        F.when(gone, F.col("n_units")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.col("n_spans")).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
