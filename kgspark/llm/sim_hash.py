"""Near duplicates by SimHash fingerprints, compared bit plane by bit plane.

A text's words are cut to shingles of three, repeats included; the XXH64 of a shingle
(seed 42) votes on 64 bits, and a bit of the fingerprint is 1 if more than half of the
shingles have it. Fingerprints that differ in at most ``radius`` bits are linked.

Equal fingerprints are one row from the start, so copies cost a partial aggregate.
Candidates: the 64 bits are cut to ``radius + 2`` groups. Two linked fingerprints agree in
two groups at least, so they share a bucket of some pair of groups (a mask and the
masked value). A bucket of more than ``limit`` fingerprints is cut once more by the same
rule on the bits its mask leaves free, and again, until it is small: 64 free bits
become 32, 16 and 8, and with 8 free bits there are at most 256 fingerprints. So no group
is unbounded, no bucket is compared in parts, and each fingerprint has a fixed number
of buckets per level (6 for a radius of 2).

Within a bucket the fingerprints are stored vertically: one bit plane per bit, 64
fingerprints to a machine word. For each fingerprint and each word (a block of 64
others), the planes are added to the distances of all 64 at once by carry-save bitwise
counters, which start so high that they run over as the distance passes the
radius. After every few planes, blocks in which all distances have passed it are
abandoned. What is left are links; out of a bucket come only the links of each
component's members to its least fingerprint, never all pairs. Components over all
buckets give the classes.

Defined results: null texts and texts without words have the fingerprint zero and are
linked like any other; rows with a null id link nothing and have a null component;
rows that repeat an id are judged each by its own text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from kgspark.llm.common import map_rows, runs, utf8
from kgspark.operators.hierarchy import connected_components
from kgspark.skew import lookup_join
from kgspark.storage import Scratch, local_table

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 2
LIMIT = 1024  # fingerprints of a bucket that are compared with each other
STEP = 8  # bit planes between two looks for blocks to abandon
WORDS = 1 << 15  # pairs of a fingerprint and a block that are compared at a time
HASHES = 1 << 15  # hashes of a text whose bits are counted at a time
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# -------------------------------------------------------------- fingerprints

def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of a text as an unsigned number."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    k = min(size, n)
    first = np.append(0, ends[: n - k] + 1)
    spans = zip(first.tolist(), ends[k - 1:].tolist())
    hashed, total = xxhash.xxh64_intdigest, n - k + 1
    votes = np.zeros(BITS, np.int64)
    for at in range(0, total, HASHES):
        m = min(HASHES, total - at)
        part = np.fromiter((hashed(joined[a:b], SEED) for (a, b), _ in zip(spans, range(m))), np.uint64, m)
        votes += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(m, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > total).tobytes())


def sign(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, print) of each document; ``print`` is the fingerprint as a signed number."""
    def signed(rows):
        for doc_id, text in rows:
            yield doc_id, _signed(fingerprint(text))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return scratch.save(map_rows(docs.select("doc_id", utf8()), signed, f"doc_id {kind}, print bigint"), "prints")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


# ---------------------------------------------------------------- bit planes

def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, n / 64) words: bit ``j`` of word ``w`` in plane ``b`` is bit ``b`` of value ``64 * w + j``."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def links(buckets: list[np.ndarray], radius: int, free: int = (1 << BITS) - 1) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of linked values in the buckets laid end to end, each filled up to whole words.

    ``free`` has the bits in which members of a bucket may differ at all.
    """
    blocks = np.array([-(-len(b) // BITS) for b in buckets])
    starts = np.append(0, np.cumsum(blocks))
    values = np.zeros(starts[-1] * BITS, np.uint64)
    owner, block, over = [], [], []
    for bucket, start, n in zip(buckets, starts.tolist(), blocks.tolist()):
        m = len(bucket)
        values[start * BITS: start * BITS + m] = bucket
        # Each value meets its own block and the later ones.
        places = np.arange(m)
        count = n - places // BITS
        mine = np.repeat(places, count)
        word = mine // BITS + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        # Places that hold no value, and those up to the value itself, count as passed.
        passed = np.zeros(len(mine), np.uint64)
        if m % BITS:
            passed[word == n - 1] = FULL << np.uint64(m % BITS)
        own = word == mine // BITS
        passed[own] |= FULL >> (np.uint64(BITS - 1) - (mine[own] % BITS).astype(np.uint64))
        owner.append(mine + start * BITS)
        block.append(word + start)
        over.append(passed)
    owner, block, over = np.concatenate(owner), np.concatenate(block), np.concatenate(over)
    planes = bit_planes(values)
    n_counters = radius.bit_length()
    # Counters start at what is left to an overflow: radius + 1 differences run over.
    bias = (1 << n_counters) - 1 - radius
    counters = [np.full(len(owner), FULL if bias >> k & 1 else 0, np.uint64) for k in range(n_counters)]
    used = [b for b in range(BITS) if free >> b & 1]
    for at in range(0, len(used), STEP):
        mine = values[owner]
        for pair in range(at, min(at + STEP, len(used)), 2):
            two = [planes[b][block] ^ -(mine >> np.uint64(b) & np.uint64(1)) for b in used[pair:pair + 2]]
            carry = two.pop()
            if not n_counters:
                over |= carry if not two else carry | two[0]
                continue
            if two:  # a full adder takes two planes and the lowest counter at once
                half = counters[0] ^ carry
                carry, counters[0] = (counters[0] & carry) | (half & two[0]), half ^ two[0]
            else:
                counters[0], carry = counters[0] ^ carry, counters[0] & carry
            for k in range(1, n_counters):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
        alive = over != FULL
        if not alive.all():
            owner, block, over = owner[alive], block[alive], over[alive]
            counters = [c[alive] for c in counters]
        if not len(owner):
            break
    near = np.unpackbits((~over).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
    which, bit = np.nonzero(near)
    return owner[which], block[which] * BITS + bit


def least_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For places 0 to n - 1, the least place that links (a, b) lead to."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, before[a])
        least = least[least]
        if (least == before).all():
            return least


# -------------------------------------------------------------------- the job

def finer(mask: int, radius: int) -> list[int]:
    """Masks that add two of ``radius + 2`` groups of the bits that a mask leaves free."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    groups = radius + 2
    cuts = [len(free) * g // groups for g in range(groups + 1)]
    parts = [sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]
    return [mask | x | y for x, y in combinations(parts, 2)]


def compare(radius: int):
    """Rows (mask, value, print), bucket by bucket, to rows (a, b) that join what is linked."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        buckets, size, free = [], 0, 0
        for (mask, _), group in runs(rows, lambda r: (r[0], r[1])):
            if len(group) > 1:
                buckets.append(np.array([g[2] for g in group], np.int64).view(np.uint64))
                size += len(group) * -(-len(group) // BITS)
                free |= ~mask & ((1 << BITS) - 1)
            if size >= WORDS:
                yield from joined(buckets, free)
                buckets, size, free = [], 0, 0
        if buckets:
            yield from joined(buckets, free)

    def joined(buckets, free):
        a, b = links(buckets, radius, free)
        places = sum(-(-len(x) // BITS) for x in buckets) * BITS
        least = least_of(places, a, b)
        values = np.concatenate([np.append(x, np.zeros(-len(x) % BITS, np.uint64)) for x in buckets]).view(np.int64)
        for i in np.flatnonzero(least != np.arange(places)).tolist():
            yield int(values[least[i]]), int(values[i])

    return run


def forest(prints: DataFrame, scratch: Scratch, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """(a, b): rows that join all distinct fingerprints of ``prints`` which links connect."""
    spark = prints.sparkSession
    masks = finer(0, radius)
    rows = prints.select(F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"), "print")
    found = None
    while True:
        rows = rows.withColumn("value", F.col("print").bitwiseAND(F.col("mask")))
        sizes = scratch.save(rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        met = rows.join(sizes, ["mask", "value"])
        small = met.where(F.col("n") <= limit).select("mask", "value", "print")
        dealt = small.repartition("mask", "value").sortWithinPartitions("mask", "value")
        part = scratch.save(map_rows(dealt, compare(radius), "a bigint, b bigint"), "joined")
        found = part if found is None else found.unionAll(part)
        if sizes.where(F.col("n") > limit).isEmpty():
            return found.distinct()
        steps = [(_signed(m), _signed(x)) for m in masks for x in finer(m, radius)]
        masks = sorted({x & ((1 << BITS) - 1) for _, x in steps})
        table = local_table(spark, steps, "mask bigint, next bigint")
        # Masks of one level that are reached by two ways give the same bucket.
        rows = scratch.save(
            met.where(F.col("n") > limit).join(F.broadcast(table), "mask")
            .select(F.col("next").alias("mask"), "print").distinct(), "cut",
        )


def near_duplicates(docs: DataFrame, scratch: Scratch, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """(doc_id, print, component_id) of each document; ``component_id`` is the least id reachable."""
    signed = sign(docs, scratch)
    with Scratch(docs.sparkSession) as work:
        prints = work.save(
            signed.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("first_id")), "distinct"
        )
        joined = work.save(forest(prints, work, radius, max(limit, 256)), "forest")
        components = work.save(connected_components(joined, work), "components")
        ids = components.join(prints.withColumnRenamed("print", "node"), "node")
        least = ids.groupBy("component").agg(F.min("first_id").alias("component_id"))
        of_print = components.join(least, "component").select(F.col("node").alias("print"), "component_id")
        of_print = scratch.save(
            prints.join(of_print, "print", "left").select("print", F.coalesce("component_id", "first_id").alias("component_id")),
            "of_print",
        )
    out = lookup_join(signed, of_print, "print")
    return out.select(
        "doc_id", "print", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
