"""Connected components and the repair of a split class hierarchy."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Row, functions as F

from kgspark import schemas
from kgspark.operators.components import connected_components
from kgspark.operators.ontology import Ontology, restrict_properties, top_classes
from kgspark.operators.repair import ARITY, replay
from kgspark.skew import DEFAULT_SKEW, SkewPolicy, dense_index, lookup_join
from kgspark.storage import Scratch, local_table


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def find_isolated_clusters(onto: Ontology, scratch: Scratch, policy: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """(class_name, cluster_index): largest cluster first, ties by least class name.

    Empty if the hierarchy is one piece or has no relation.
    """
    members = scratch.save(
        connected_components(onto.subclass_of, scratch, "subclass", "superclass", policy=policy), "members"
    )
    sizes = scratch.save(component_sizes(members), "sizes")
    if sizes.count() <= 1:
        return members.where(F.lit(False)).select(
            F.col("node").alias("class_name"), F.lit(0).alias("cluster_index")
        )
    ranked = dense_index(sizes, [F.desc("size"), F.asc("component")], "rank", scratch, start=1)
    ranked = ranked.select("component", F.col("rank").cast("int").alias("cluster_index"), F.col("size").alias("n"))
    return scratch.save(
        lookup_join(
            members, ranked, "component", how="inner", policy=policy, weight="n", rows=members.count()
        ).select(
            F.col("node").alias("class_name"), "cluster_index"
        ),
        "clusters",
    )


def cluster_relations(onto: Ontology, clusters: DataFrame) -> DataFrame:
    """(cluster_index, subclass, superclass, seq): the relations of each cluster."""
    names = clusters.withColumnRenamed("class_name", "subclass")
    return onto.subclass_of.join(names, "subclass").select("cluster_index", "subclass", "superclass", "seq")


def cluster_count(clusters: DataFrame) -> int:
    return clusters.agg(F.max("cluster_index")).first()[0] or 0


# --------------------------------------------------------------- operations

def apply_relations(onto: Ontology, relations: DataFrame) -> Ontology:
    """Merge or bridge: add relations (subclass, superclass, seq) not yet present.

    Then classes that stand in no relation leave the domains and ranges.
    """
    fresh = relations.select("subclass", "superclass", "seq").join(
        onto.subclass_of.select("subclass", "superclass").distinct(), ["subclass", "superclass"], "left_anti"
    ).groupBy("subclass", "superclass").agg(F.min("seq").alias("seq"))
    edges = onto.subclass_of.unionByName(fresh)
    related = edges.select(F.explode(F.array("subclass", "superclass")).alias("class_name"))
    return restrict_properties(replace(onto, subclass_of=edges), related, "left_semi")


def apply_prune(onto: Ontology, pruned: DataFrame, drop_class: bool = False) -> Ontology:
    """Drop relations that touch pruned classes (class_name), and clean the lists."""
    names = pruned.select("class_name").distinct()
    edges = onto.subclass_of
    for end in ("subclass", "superclass"):
        edges = edges.join(names.withColumnRenamed("class_name", end), end, "left_anti")
    edges = edges.select(onto.subclass_of.columns)
    out = restrict_properties(replace(onto, subclass_of=edges), names, "left_anti")
    if drop_class:
        out = replace(
            out, classes=onto.classes.join(names.withColumnRenamed("class_name", "name"), "name", "left_anti")
            .select(onto.classes.columns)
        )
    return out


def _operation_frames(spark, op: Row, first_seq: int) -> tuple[DataFrame, DataFrame]:
    relations = local_table(
        spark, [(r["subclass"], r["superclass"], first_seq + i) for i, r in enumerate(op["relations"] or [])],
        schemas.SUBCLASS_OF,
    )
    classes = local_table(spark, [(c,) for c in op["classes"] or []], "class_name string")
    return relations, classes


def apply_operation(onto: Ontology, op: Row, first_seq: int = 1 << 40) -> Ontology:
    """Apply one row of an operation table."""
    spark = onto.subclass_of.sparkSession
    relations, classes = _operation_frames(spark, op, first_seq)
    if op["op"] == "prune":
        return apply_prune(onto, classes)
    return apply_relations(onto, relations)


def operation_error(
    onto: Ontology, op: Row, clusters: DataFrame, scratch: Scratch, policy: SkewPolicy = DEFAULT_SKEW
) -> str | None:
    """Why an operation is refused, or None: arity, classes, indexes, then effect."""
    kind, indexes = op["op"], list(op["indexes"] or [])
    if len(indexes) != ARITY[kind]:
        return "wrong_arity"
    spark = onto.subclass_of.sparkSession
    relations, classes = _operation_frames(spark, op, 0)
    named = classes if kind == "prune" else relations.select(
        F.explode(F.array("subclass", "superclass")).alias("class_name")
    )
    if kind != "bridge":
        known = onto.subclass_of.select(F.explode(F.array("subclass", "superclass")).alias("class_name"))
        if not named.join(known, "class_name", "left_anti").isEmpty():
            return "unknown_class"
    before = cluster_count(clusters)
    if any(not 1 <= i <= before for i in indexes):
        return "unknown_cluster"
    after = find_isolated_clusters(apply_operation(onto, op), scratch, policy)
    if cluster_count(after) >= before:
        return "clusters_not_reduced"
    return None


def auto_bridge(
    onto: Ontology, clusters: DataFrame, prune_below: int = 0
) -> DataFrame:
    """Proposals as rows (op_seq, op, indexes, relations, classes).

    The top class of the largest cluster becomes superclass of the top class of
    each smaller one; clusters of at most ``prune_below`` classes are pruned.
    One operation per cluster, the last cluster first, so that the indexes of
    the clusters still to be handled stay as they are.
    """
    tops = top_classes(replace(
        onto, classes=clusters.select(F.col("class_name").alias("name"), "cluster_index")
    )).groupBy("cluster_index").agg(F.min("name").alias("top"))
    sizes = clusters.groupBy("cluster_index").agg(
        F.count(F.lit(1)).alias("size"), F.min("class_name").alias("least")
    )
    # A cluster that is one cycle has no top; its least class stands in.
    rows = sizes.join(tops, "cluster_index", "left").withColumn("top", F.coalesce("top", "least"))
    main = rows.where("cluster_index = 1").select("top").scalar()
    last = rows.agg(F.max("cluster_index")).scalar()
    prune = F.col("size") <= prune_below
    small = rows.where("cluster_index > 1")
    members = clusters.join(
        small.where(prune).select("cluster_index"), "cluster_index"
    ).groupBy("cluster_index").agg(F.sort_array(F.collect_list("class_name")).alias("members"))
    return small.join(members, "cluster_index", "left").select(
        (last - F.col("cluster_index")).cast("int").alias("op_seq"),
        F.when(prune, F.lit("prune")).otherwise(F.lit("bridge")).alias("op"),
        F.when(prune, F.array("cluster_index"))
        .otherwise(F.array(F.lit(1), F.col("cluster_index"))).alias("indexes"),
        F.when(~prune, F.array(F.struct(F.col("top").alias("subclass"), main.alias("superclass"))))
        .alias("relations"),
        F.when(prune, F.col("members")).alias("classes"),
    )


def fix_ontology(
    onto: Ontology, scratch: Scratch, ops: DataFrame | None = None, policy: SkewPolicy = DEFAULT_SKEW,
    prune_below: int = 0,
) -> tuple[Ontology, DataFrame]:
    """Make the hierarchy one piece; returns it with the history of operations.

    With an ``ops`` table its rows are checked and applied as if in ``op_seq`` order
    until there is one cluster; a refused row is logged and skipped. They are judged
    many at a time (``repair.replay``). Without one, all operations of ``auto_bridge``
    are applied in a single set step: clusters of at most ``prune_below`` classes are
    pruned, the others are bridged.
    """
    if ops is None:
        clusters = find_isolated_clusters(onto, scratch, policy)
        if cluster_count(clusters) == 0:
            return onto, local_table(clusters.sparkSession, [], schemas.OPS + ", error string")
        plan = scratch.save(auto_bridge(onto, clusters, prune_below), "ops")
        relations = plan.select(F.explode("relations").alias("r"), "op_seq").select(
            "r.*", (F.lit(1 << 40) + F.col("op_seq")).alias("seq")
        )
        fixed = apply_relations(onto, relations)
        if prune_below > 0:
            fixed = apply_prune(fixed, plan.select(F.explode("classes").alias("class_name")))
        fixed = fixed.pinned(scratch)
        return fixed, plan.withColumn("error", F.lit(None).cast("string"))
    fixed, history = replay(onto, ops, scratch, policy)
    return fixed.pinned(scratch), history.drop("pos", "round")
