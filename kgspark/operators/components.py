"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kgspark.skew import DEFAULT_SKEW, SkewPolicy, by_shuffle, lookup_join
from kgspark.storage import Scratch


def _star(edges: DataFrame, policy: SkewPolicy, rows: int, shuffled: bool) -> DataFrame:
    """Join each row (node, other) with (node, low): the least id next to node."""
    lows = edges.groupBy("node").agg(
        F.least(F.col("node"), F.min("other")).alias("low"), F.count(F.lit(1)).alias("n")
    )
    return lookup_join(edges, lows, "node", how="inner", policy=policy, weight="n", rows=rows, shuffled=shuffled)


def connected_components(
    edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b",
    policy: SkewPolicy = DEFAULT_SKEW, shuffled: bool = False,
) -> DataFrame:
    """(node, component) of an undirected edge table; component = least node.

    Alternating large-star and small-star steps (Kiveris et al., SoCC 2014): every
    round relinks edges to the least neighbour, until all components are stars.
    Each round is one scratch table; hubs are split by their known edge counts.
    ``shuffled`` keeps Spark from sending tables of nodes through the driver.
    """
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where(
        "node is not null and other is not null"
    )
    nodes = scratch.save(pairs.select(F.explode(F.array("node", "other")).alias("node")).distinct(), "nodes")
    links = scratch.save(
        pairs.where("node != other").select(
            F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")
        ).distinct(),
        "links",
    )
    while True:
        if _is_star_forest(links):
            return nodes.join(by_shuffle(links) if shuffled else links, "node", "left").select(
                "node", F.coalesce("other", "node").alias("component")
            )
        n = links.count()
        both = links.select(F.explode(F.array(
            F.struct("node", "other"), F.struct(F.col("other").alias("node"), F.col("node").alias("other"))
        )).alias("e")).select("e.*")
        large = _star(both, policy, 2 * n, shuffled).where("other > node and other != low").select(
            F.col("other").alias("node"), F.col("low").alias("other")
        ).distinct()
        large = scratch.save(large, "large")
        small = _star(large, policy, n, shuffled).select(F.explode(F.array(
            F.struct(F.col("other").alias("node"), F.col("low").alias("other")),
            F.struct(F.col("node").alias("node"), F.col("low").alias("other")),
        )).alias("e")).select("e.*").where("node != other").distinct()
        small = scratch.save(small, "links")
        scratch.drop(links, large)
        links = small


def _is_star_forest(links: DataFrame) -> bool:
    """Every leaf has one centre, and no centre is itself a leaf.

    Links point from greater to lesser ids and keep the components of the graph,
    so once they are stars the centre of a star is the least node of a component.
    """
    ends = links.select(F.explode(F.array(
        F.struct(F.col("node").alias("id"), F.lit(1).alias("leaf")),
        F.struct(F.col("other").alias("id"), F.lit(0).alias("leaf")),
    )).alias("e")).select("e.*")
    roles = ends.groupBy("id").agg(F.sum("leaf").alias("leaves"), F.min("leaf").alias("least"))
    return roles.where("leaves > 1 or (leaves = 1 and least = 0)").isEmpty()
