"""Joins and numbering that survive keys holding a large share of the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from kgspark.storage import Scratch, local_table


@dataclass(frozen=True)
class SkewPolicy:
    """When a join key counts as hot, and into how many parts it is split.

    ``sample`` only steers the detection: a key that is missed or found by
    chance changes the task layout, never the rows of the result.
    """

    min_rows: int = 1_000_000
    rows_per_split: int = 250_000
    max_splits: int = 4_096
    max_keys: int = 1_024
    sample: float = 0.01


DEFAULT_SKEW = SkewPolicy()
NO_HOT_KEYS = object()  # stands for a table too small to hold a hot key


def too_small(df: DataFrame, policy: SkewPolicy = DEFAULT_SKEW) -> bool:
    """True if a written table has fewer rows than a single hot key.

    Counting a scratch table reads file footers only; other frames are not counted.
    """
    if not hasattr(df, "_scratch_path"):
        return False
    if not hasattr(df, "_scratch_rows"):
        df._scratch_rows = df.count()
    return df._scratch_rows < policy.min_rows


def hot_keys(
    left: DataFrame, key: str, policy: SkewPolicy = DEFAULT_SKEW, weight: str | None = None
) -> DataFrame:
    """At most ``max_keys`` rows (hot_key, splits).

    ``weight`` names a column that already holds the row count of each key; then
    ``left`` has one row per key and nothing is sampled.
    """
    if weight is None:
        rows = left.select(F.col(key).alias("hot_key"))
        share = policy.sample if policy.sample < 1.0 else None
        if share:
            rows = rows.sample(fraction=share, seed=7)
        counts = rows.where(F.col("hot_key").isNotNull()).groupBy("hot_key").agg(
            F.count(F.lit(1)).alias("n")
        )
        scale = 1.0 / (share or 1.0)
    else:
        counts = left.select(F.col(key).alias("hot_key"), F.col(weight).alias("n"))
        scale = 1.0
    n = F.col("n") * F.lit(scale)
    return (
        counts.where(n >= policy.min_rows)
        .orderBy(F.desc("n"), "hot_key")
        .limit(policy.max_keys)
        .select(
            "hot_key",
            F.least(
                F.ceil(n / policy.rows_per_split), F.lit(policy.max_splits)
            ).cast("int").alias("splits"),
        )
    )


def hot_ends(
    df: DataFrame, columns: list[str], scratch: Scratch, policy: SkewPolicy = DEFAULT_SKEW
) -> dict[str, DataFrame]:
    """Hot keys of several columns, found in one pass and written as a tiny table."""
    if too_small(df, policy):
        return {c: NO_HOT_KEYS for c in columns}
    rows = df.sample(fraction=policy.sample, seed=7) if policy.sample < 1.0 else df
    tagged = rows.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("hot_key")) for c in columns
    ])).alias("k")).select("k.*").where("hot_key is not null")
    n = F.col("n") / F.lit(min(policy.sample, 1.0))
    counts = tagged.groupBy("column", "hot_key").agg(F.count(F.lit(1)).alias("n")).where(n >= policy.min_rows)
    found = scratch.save(
        counts.orderBy(F.desc("n"), "column", "hot_key").limit(policy.max_keys).select(
            "column", "hot_key",
            F.least(F.ceil(n / policy.rows_per_split), F.lit(policy.max_splits)).cast("int").alias("splits"),
        ),
        "hot",
    )
    return {c: found.where(F.col("column") == c).select("hot_key", "splits") for c in columns}


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled however small it is: nothing of it passes the driver."""
    return df.hint("merge")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    policy: SkewPolicy = DEFAULT_SKEW,
    weight: str | None = None,
    hot: DataFrame | object | None = None,
    rows: int | None = None,
    shuffled: bool = False,
) -> DataFrame:
    """Equi-join of many rows with a lookup table of one row per key.

    Rows of hot keys are spread over several parts by a hash of the whole row;
    the matching lookup rows are repeated once per part. The hot table holds at
    most ``max_keys`` rows by construction, so it alone is broadcast. Whether
    the lookup side itself is broadcast is left to Spark, which measures it.
    ``rows`` is a bound on the rows of ``left``: below ``min_rows`` no key can be
    hot, and the join is a plain one. ``shuffled`` keeps Spark from sending the lookup
    side through the driver: for jobs with so many joins that their broadcasts add up.
    """
    kept = by_shuffle if shuffled else (lambda df: df)
    if hot is NO_HOT_KEYS or (rows is not None and rows < policy.min_rows):
        return left.join(kept(right.drop(weight) if weight else right), key, how)
    if hot is None:
        hot = (
            hot_keys(right, key, policy, weight)
            if weight
            else hot_keys(left, key, policy)
        )
    if weight:
        right = right.drop(weight)
    hot = F.broadcast(hot.withColumnRenamed("hot_key", key))
    salted_left = left.join(hot, key, "left").withColumn(
        "_part",
        F.when(
            F.col("splits").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.col("splits"))
        ).otherwise(F.lit(0)).cast("int"),
    ).drop("splits")
    salted_right = right.join(hot, key, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1))
    ).drop("splits")
    return salted_left.join(kept(salted_right), [key, "_part"], how).drop("_part")


def packed_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
    policy: SkewPolicy = DEFAULT_SKEW, hot: DataFrame | object | None = None,
) -> DataFrame:
    """``lookup_join`` on several columns, where nulls are equal; both sides have the keys.

    The key columns travel once, inside the packed key, and are taken out of it behind the join.
    """
    key = F.struct(*keys).alias("_key")
    added = [] if how in ("left_anti", "left_semi") else [c for c in right.columns if c not in keys]
    met = lookup_join(
        left.select(key, *[c for c in left.columns if c not in keys]), right.select(key, *added), "_key", how, policy, hot=hot
    )
    return met.select(*[F.col(f"_key.{c}") if c in keys else F.col(c) for c in left.columns], *added)


def dense_index(
    df: DataFrame, order: list, name: str, scratch: Scratch, start: int = 0
) -> DataFrame:
    """Number rows 0, 1, 2.. in the given total order without one global window.

    A range-partitioned sort numbers each part for itself; the parts' row counts,
    one number per partition, give the offsets.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*",
        F.spark_partition_id().alias("_pid"),
        (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("_local"),
    )
    parts = scratch.save(parts, "numbered")
    offsets, total = {}, start
    for pid, n in sorted(
        (r["_pid"], r["count"]) for r in parts.groupBy("_pid").count().collect()
    ):
        offsets[pid] = total
        total += n
    if not offsets:
        return parts.select(*df.columns, F.lit(0).cast("long").alias(name))
    table = local_table(
        df.sparkSession, [(pid, first) for pid, first in offsets.items()], "_pid int, _first long"
    )
    return parts.join(F.broadcast(table), "_pid").select(
        *df.columns, (F.col("_first") + F.col("_local")).alias(name)
    )


def running_total(df: DataFrame, key: str, value: str, name: str, scratch: Scratch) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows up to this one by ``key``, whose values are distinct.

    Each range of keys sums for itself; the ranges' totals, one number each, give the offsets.
    """
    parts = scratch.save(df.repartitionByRange(key).select("*", F.spark_partition_id().alias("_pid")), "ranges")
    offsets, total = [], 0
    for pid, _, part in sorted(
        (r["_pid"], r["least"], r["total"])
        for r in parts.groupBy("_pid").agg(F.min(key).alias("least"), F.sum(value).alias("total")).collect()
    ):
        offsets.append((pid, total))
        total += part
    table = local_table(df.sparkSession, offsets, "_pid int, _before long")
    own = F.sum(value).over(Window.partitionBy("_pid").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn(name, own).join(F.broadcast(table), "_pid").select(
        *df.columns, (F.col(name) + F.col("_before")).alias(name)
    )
