"""Chat formatting after the collapse of cumulative snapshots, with DataFrame functions only.

A conversation that is logged again and again as it grows leaves snapshots that
are prefixes of the last one. Every turn gets its place in its conversation and a
hash of (place, role, text); the exclusive-or of these hashes up to a turn is the
hash of the prefix that ends there. A conversation whose length and hash equal a
proper prefix of another is a snapshot, found by an anti-join with the distinct
prefixes; of equal conversations the one with the least id stays. What remains is
rendered, one row for each ``part_turns`` turns.

Prefix hashes are made in two steps, within blocks of adjacent turn numbers and
over the blocks of a conversation, so a conversation with a large share of all
rows is not dealt to one task. Hashes are two 64-bit numbers. Equal prefixes and
equal conversations are aggregated before they are joined, so a first turn or a
conversation that a third of the log repeats is one row in either side.

Defined results: rows without conv_id are left out; a null role is rendered as
``user``, a null text as empty, and both are told from the written value when
turns are compared; a null turn comes first; a row repeated in full counts once;
turns of equal number are ordered by role and text; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kgspark.storage import Scratch

PART_TURNS = 256
TURN_BLOCK = 256


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(
        F.lit(seed), "place", F.col("role").isNull(), F.coalesce("role", F.lit("")),
        F.col("text").isNull(), F.coalesce("text", F.lit("")),
    )


def prefixes(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, place, role, text, h1, h2): each turn with the hash of the prefix it ends."""
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text").distinct()
    turns = scratch.save(
        turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / TURN_BLOCK), F.lit(-1 << 62))), "turns"
    )
    within = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    over = Window.partitionBy("conv_id").orderBy("block")
    sizes = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("conv_id", "block", F.coalesce(before, F.lit(0)).alias("offset"))
    placed = turns.join(offsets, ["conv_id", "block"]).withColumn(
        "place", F.col("offset") + F.row_number().over(within)
    )
    hashed = scratch.save(placed.select(
        "conv_id", "block", "place", "role", "text", _turn_hash(1).alias("t1"), _turn_hash(2).alias("t2")
    ), "hashed")
    folded = hashed.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("t1"), F.bit_xor("t2").alias("t2"))
    up_to = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = folded.select(
        "conv_id", "block", F.coalesce(F.bit_xor("t1").over(up_to), F.lit(0)).alias("c1"),
        F.coalesce(F.bit_xor("t2").over(up_to), F.lit(0)).alias("c2"),
    )
    so_far = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return hashed.join(carried, ["conv_id", "block"]).select(
        "conv_id", "place", "role", "text",
        F.bit_xor("t1").over(so_far).bitwiseXOR(F.col("c1")).alias("h1"),
        F.bit_xor("t2").over(so_far).bitwiseXOR(F.col("c2")).alias("h2"),
    )


def maximal(hashed: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, n_turns, copies): conversations that are no prefix of another; least id of equals."""
    ends = hashed.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("end")).select("conv_id", "end.*")
    ends = scratch.save(ends, "ends")
    whole = ends.groupBy("place", "h1", "h2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")
    )
    key = ["place", "h1", "h2"]
    last = ends.select("conv_id", F.col("place").alias("n_turns"))
    proper = hashed.select("conv_id", *key).join(last, "conv_id").where("place < n_turns").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"), "copies")


def render(hashed: DataFrame, kept: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, n_turns, copies, text): ``<|role|>``, the text and ``<|end|>`` of each turn."""
    turn = F.concat(
        F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n")
    )
    turns = hashed.join(kept, "conv_id").select(
        "conv_id", "n_turns", "copies", F.floor((F.col("place") - 1) / part_turns).alias("part"),
        F.struct("place", turn.alias("line")).alias("turn"),
    )
    parts = turns.groupBy("conv_id", "part", "n_turns", "copies").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return parts.select(
        "conv_id", "part", "n_turns", "copies",
        F.array_join(F.transform("turns", lambda t: t["line"]), "").alias("text"),
    )


def collapse_and_render(conversations: DataFrame, scratch: Scratch, part_turns: int = PART_TURNS) -> DataFrame:
    hashed = scratch.save(prefixes(conversations, scratch), "prefixes")
    return render(hashed, scratch.save(maximal(hashed, scratch), "kept"), part_turns)
