"""Near duplicates by HyperMinHash sketches.

A document's set are its distinct shingles of ``size`` words. The hash of a shingle
has 64 bits: the first 7 choose one of 128 buckets, the others are its rank there.
A bucket keeps the least rank of the set as a 16-bit register: the number of
leading zeros and the 10 bits that follow the first one. Registers are grouped to
32 bands of 4; two sets that agree in a band with at least one used bucket are
candidates. A pair at the similarity asked for (0.8) agrees in a band of used
registers with probability 0.41, in none of the 32 with less than 1e-7.

Before texts are compared, the similarity of a candidate pair is estimated from
its registers: the share of agreeing ones, less the share that agrees by chance
(collisions of compressed ranks). The pair is dropped only if the estimate lies
more than six standard deviations below the limit. All others are confirmed on
the full sets.

Equal sets are one row from the start (a class), so copies cost one partial
aggregate. Each class is first compared with at most two others: of the least
classes of its bands, the one it shares most bands with, and the least. The
confirmed links make components. A band whose classes are then all in one component
is done, as more links change nothing. In the others, the classes outside of the
band's largest component are compared with all classes of the band by registers,
in blocks of bounded size. Out of a block come only as many pairs as join what may
be similar (a forest), never all of them. Components and forests make clusters.
Within a cluster, the classes outside of its largest component are compared with all
classes of the cluster on full sets, again in blocks and with a forest as result. So
every pair of a band that may be similar is tested, unless it is in one
component already, and no group's pairs are ever written out.

Defined results: texts without words, and null texts, have an empty set, are
linked with nothing and kept, as are rows with a null id; texts of fewer words
than a shingle have the whole sequence as one shingle; repeated rows of an id
are copies; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F
import xxhash

from kgspark.llm.common import map_rows, runs, utf8
from kgspark.operators.hierarchy import connected_components
from kgspark.skew import lookup_join
from kgspark.storage import Scratch

BUCKET_BITS = 7
MANTISSA_BITS = 10
BAND = 4
BLOCK = 2048  # classes of a band that are compared at a time
SURE = 6.0  # standard deviations


@dataclass(frozen=True)
class NearDup:
    """Words of a shingle, and the least similarity as a percentage."""

    size: int = 4
    percent: int = 80


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    # PySpark fixes the seed of hash() for all workers of a session.
    one = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    k = min(size, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + one[i:n - k + 1 + i])
    return np.unique(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def registers(hashes: np.ndarray) -> np.ndarray:
    """128 registers of sorted hashes: leading zeros, then mantissa; 0 if unused."""
    n = 1 << BUCKET_BITS
    bounds = np.searchsorted(hashes, np.arange(n, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS))
    ends = np.append(bounds[1:], len(hashes))
    used = bounds < ends
    rank = hashes[bounds[used]] << np.uint64(BUCKET_BITS)
    # frexp gives the exponent of the leading bit; ranks of 0 count as the least.
    exponent = np.frexp(np.maximum(rank, np.uint64(1)).astype(np.float64))[1]
    exponent = np.minimum(exponent, 64)
    zeros = np.minimum(64 - exponent, 62).astype(np.uint64)
    after = (rank << zeros) << np.uint64(1)
    mantissa = after >> np.uint64(64 - MANTISSA_BITS)
    out = np.zeros(n, np.uint16)
    out[used] = (((zeros + np.uint64(1)) << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    return out


def estimates(a: np.ndarray, b: np.ndarray, n_a, n_b) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of registers (broadcast over the first axes), and used buckets.

    Chance agreement of unequal ranks: both have the same leading zeros (one third
    of the time for sets of similar size) and the same mantissa.
    """
    used = ((a > 0) | (b > 0)).sum(-1)
    same = ((a == b) & (a > 0)).sum(-1)
    chance = 1 / 3 / (1 << MANTISSA_BITS)
    share = same / np.maximum(used, 1)
    return np.clip((share - chance) / (1 - chance), 0, 1), used


def may_reach(a: np.ndarray, b: np.ndarray, n_a, n_b, percent: int) -> np.ndarray:
    """False only if sizes or estimate exclude the similarity."""
    limit = percent / 100
    guess, used = estimates(a, b, n_a, n_b)
    slack = SURE * np.sqrt(limit * (1 - limit) / np.maximum(used, 1)) + 1 / np.maximum(used, 1)
    fits = np.minimum(n_a, n_b) * 100 >= percent * np.maximum(n_a, n_b)
    return fits & (guess + slack >= limit)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


# ------------------------------------------------------------------ the job

def signatures(docs: DataFrame, rule: NearDup, scratch: Scratch) -> DataFrame:
    """(doc_id, set_key, n_shingles, registers) of each document."""
    def sketch(rows):
        for doc_id, text in rows:
            found = shingles(text, rule.size)
            key = xxhash.xxh3_128_digest(found.tobytes())
            yield doc_id, key, len(found), registers(found).tobytes()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return scratch.save(map_rows(
        docs.select("doc_id", utf8()), sketch,
        f"doc_id {kind}, set_key binary, n_shingles bigint, registers binary",
    ), "signed")


def classes_of(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """(sid, set_key, n_shingles, registers, first_id): equal sets, numbered, with their least id."""
    sets = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key", "n_shingles", "registers").agg(
        F.min("doc_id").alias("first_id")
    )
    return scratch.save(sets.select(F.monotonically_increasing_id().alias("sid"), "*"), "classes")


def band_table(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, sid) of the bands that two classes or more share."""
    def bands(rows):
        weight = np.array([1, 65537, 65537 ** 2 % (1 << 63), 65537 ** 3 % (1 << 63)], np.uint64)
        for sid, blob in rows:
            r = np.frombuffer(blob, np.uint16).reshape(-1, BAND)
            used = np.flatnonzero(r.any(1))
            packed = np.ascontiguousarray(r[used]).view(np.uint64)[:, 0]
            keys = _mix(packed * np.uint64(0x9E3779B97F4A7C15) + used.astype(np.uint64) * weight[1] + weight[2])
            for key in keys.view(np.int64).tolist():
                yield key, sid

    rows = map_rows(classes.select("sid", "registers"), bands, "band bigint, sid bigint")
    rows = scratch.save(rows, "bands")
    leaders = rows.groupBy("band").agg(F.min("sid").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return scratch.save(rows.join(leaders.drop("n"), "band"), "shared")


def star_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each class with two of the least classes of its bands, at most."""
    met = shared.where("sid != leader").groupBy("sid", "leader").agg(F.count(F.lit(1)).alias("n"))
    chosen = met.groupBy("sid").agg(F.max(F.struct("n", -F.col("leader"))).alias("most"), F.min("leader").alias("least"))
    ends = F.explode(F.array_distinct(F.array(-F.col("most.col2"), F.col("least"))))
    return chosen.select(ends.alias("a"), F.col("sid").alias("b"))


def _full_texts(wanted: DataFrame, classes: DataFrame, texts: DataFrame, rule: NearDup, scratch: Scratch) -> DataFrame:
    """(sid, text) of the wanted classes, one text per class whatever the number of its copies."""
    sides = wanted.select("sid").distinct().join(classes.select("sid", "first_id", "set_key"), "sid")
    chosen = texts.join(sides, texts["doc_id"] == sides["first_id"]).select("sid", utf8(), "set_key")

    def check_key(rows):
        # An id that several texts share gives the text of the class.
        for sid, text, key in rows:
            if xxhash.xxh3_128_digest(shingles(text, rule.size).tobytes()) == key:
                yield sid, text

    return scratch.save(map_rows(chosen, check_key, "sid bigint, text binary").dropDuplicates(["sid"]), "texts")


def confirm(pairs: DataFrame, classes: DataFrame, texts: DataFrame, rule: NearDup, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the similarity.

    Registers exclude most that do not. The rest is confirmed on the texts: a pair
    meets both its texts in one task, by its own number, so a class with many
    pairs is no hot key.
    """
    sides = classes.select("sid", "n_shingles", "registers")
    left, right = (sides.select(*[F.col(c).alias(f"{s}_{c}") for c in sides.columns]) for s in "ab")
    met = pairs.join(left, pairs["a"] == left["a_sid"]).join(right, pairs["b"] == right["b_sid"]).select(
        "a", "b", "a_n_shingles", "b_n_shingles", "a_registers", "b_registers"
    )

    def estimate(rows):
        for a, b, n_a, n_b, r_a, r_b in rows:
            if may_reach(np.frombuffer(r_a, np.uint16), np.frombuffer(r_b, np.uint16), n_a, n_b, rule.percent):
                yield a, b

    hopeful = scratch.save(map_rows(met, estimate, "a bigint, b bigint"), "hopeful")
    ends = hopeful.select("a", "b", F.explode(F.array("a", "b")).alias("sid"))
    chosen = _full_texts(ends, classes, texts, rule, scratch)
    both = ends.join(chosen, "sid").repartition("a", "b").sortWithinPartitions("a", "b")

    def compare(rows):
        for (a, b), group in runs(rows, lambda r: (r[0], r[1])):
            if len(group) == 2 and similar(*(shingles(g[2], rule.size) for g in group), rule.percent):
                yield a, b

    return map_rows(both.select("a", "b", "text"), compare, "a bigint, b bigint")


def open_groups(members: DataFrame, components: DataFrame) -> DataFrame:
    """(grp, sid, component, main, outer, inner) of groups with several components.

    ``members`` has (grp, sid). ``main`` is a group's largest component, ``outer`` and
    ``inner`` the numbers of blocks of the other classes and of all classes.
    """
    placed = members.join(components.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn(
        "component", F.coalesce("component", "sid")
    )
    sizes = placed.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("grp").agg(
        F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n")
    ).where("parts > 1").select(
        "grp", F.col("top.component").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("outer"),
        F.ceil(F.col("n") / BLOCK).alias("inner"),
    )
    return placed.join(largest, "grp")


def forest(groups: DataFrame, payload: DataFrame, compare) -> DataFrame:
    """(a, b): pairs of classes in different components that ``compare`` accepts.

    Each group is cut to blocks; a block of the classes outside of the main component
    meets each block of all classes. ``compare(block, rows)`` is a function of the
    payloads of a block that gives, for one payload, a flag for each of the block.
    Of a pair of blocks, only pairs that join components not yet joined there come out.
    """
    rows = groups.join(payload.select("sid", "payload"), "sid")
    at = F.pmod(F.xxhash64("sid"), F.col("inner"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    inner = rows.select("grp", numbers("outer").alias("o"), at.alias("i"), F.lit(0).alias("side"), "sid", "component", "payload")
    outer = rows.where("component != main").select(
        "grp", F.pmod(F.xxhash64("sid"), F.col("outer")).alias("o"), numbers("inner").alias("i"),
        F.lit(1).alias("side"), "sid", "component", "payload",
    )
    key = ["grp", "o", "i"]
    blocks = inner.unionByName(outer).repartition(*key).sortWithinPartitions(*key)

    def run(rows):
        for _, group in runs(rows, lambda r: r[:3]):
            all_rows, few = ([g for g in group if g[3] == s] for s in (0, 1))
            if not few or len(all_rows) < 2:
                continue
            parts = np.array([g[5] for g in all_rows])
            accepts = compare([g[6] for g in all_rows])
            parent: dict[int, int] = {}

            def root(x):
                while x in parent:
                    x = parent[x]
                return x

            for _, _, _, _, sid, component, data in few:
                hits = np.flatnonzero(parts != component)
                hits = hits[accepts(data, hits)] if len(hits) else hits
                for part, k in zip(*np.unique(parts[hits], return_index=True)):
                    x, y = root(int(part)), root(component)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        yield sid, all_rows[hits[k]][4]

    return map_rows(blocks, run, "a bigint, b bigint")


def may_be_similar(rule: NearDup):
    """Comparison of payloads (size and registers) for ``forest``."""
    def block(payloads):
        sizes = np.array([int.from_bytes(p[:8]) for p in payloads])
        table = np.frombuffer(b"".join(p[8:] for p in payloads), np.uint16).reshape(len(payloads), -1)

        def accepts(payload, rows):
            n, own = int.from_bytes(payload[:8]), np.frombuffer(payload[8:], np.uint16)
            fits = np.minimum(n, sizes[rows]) * 100 >= rule.percent * np.maximum(n, sizes[rows])
            out = np.zeros(len(rows), bool)
            near = np.flatnonzero(fits)
            out[near] = may_reach(table[rows[near]], own, sizes[rows[near]], n, rule.percent)
            return out

        return accepts

    return block


def are_similar(rule: NearDup):
    """Comparison of payloads (texts) for ``forest``, on full sets by an inverted index of the block."""
    def block(payloads):
        sets = [shingles(p, rule.size) for p in payloads]
        sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]

        def accepts(payload, rows):
            own = shingles(payload, rule.size)
            first, last = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            counts = last - first
            places = np.repeat(first - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
            both = np.bincount(owner[places], minlength=len(sets))[rows]
            return 100 * both >= rule.percent * (len(own) + sizes[rows] - both)

        return accepts

    return block


def more_links(
    shared: DataFrame, links: DataFrame, classes: DataFrame, texts: DataFrame, rule: NearDup, scratch: Scratch
) -> DataFrame:
    """(a, b): links between components that the star pairs have not found."""
    components = scratch.save(connected_components(links, scratch), "components")
    bands = scratch.save(open_groups(shared.select(F.col("band").alias("grp"), "sid"), components), "open_bands")
    size = F.unhex(F.lpad(F.hex("n_shingles"), 16, "0"))
    sketch = classes.select("sid", F.concat(size, "registers").alias("payload"))
    hopeful = scratch.save(forest(bands, sketch, may_be_similar(rule)), "hopeful")
    clusters = scratch.save(connected_components(links.unionAll(hopeful), scratch), "clusters")
    groups = scratch.save(
        open_groups(clusters.select(F.col("component").alias("grp"), F.col("node").alias("sid")), components), "open_clusters"
    )
    payload = _full_texts(groups, classes, texts, rule, scratch).withColumnRenamed("text", "payload")
    return forest(groups, payload, are_similar(rule))


def near_duplicates(docs: DataFrame, scratch: Scratch, rule: NearDup = NearDup()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document.

    ``component_id`` is the least id of the documents that links lead to.
    """
    texts = docs.select("doc_id", "text")
    signed = signatures(texts, rule, scratch)
    with Scratch(docs.sparkSession) as work:
        classes = classes_of(signed, work)
        shared = band_table(classes, work)
        links = work.save(confirm(star_pairs(shared), classes, texts, rule, work), "links")
        more = work.save(more_links(shared, links, classes, texts, rule, work), "more")
        components = work.save(connected_components(links.unionAll(more), work), "components")
        ids = classes.select(F.col("sid").alias("node"), "first_id")
        least = components.join(ids, "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
        of_class = components.join(least, "component").select(F.col("node").alias("sid"), "component_id")
        of_set = scratch.save(classes.join(of_class, "sid", "left").select(
            "set_key", F.coalesce("component_id", "first_id").alias("component_id")
        ), "of_set")
    out = lookup_join(signed.drop("registers"), of_set, "set_key")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    found = F.when(linked, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "n_shingles", found.alias("component_id"),
        F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"),
    )
