"""Node and edge tables of an ontology, a graph, and both together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from kgspark.functions.scalars import confidence_width, edge_width, node_size
from kgspark.operators.graph import degree
from kgspark.operators.ontology import Ontology
from kgspark.skew import DEFAULT_SKEW, SkewPolicy, dense_index, hot_keys, lookup_join
from kgspark.storage import Scratch


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _first_kind(parts: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(node, kind): one row per name; of several kinds the first listed wins."""
    ranked = _union([
        df.select(F.col(column).alias("node"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))
        for rank, (df, column, kind) in enumerate(parts)
    ])
    return ranked.groupBy("node").agg(F.min(F.struct("rank", "kind")).alias("k")).select("node", "k.kind")


def _edges(df: DataFrame, source, label, target) -> DataFrame:
    return df.select(source.alias("source"), label.alias("label"), target.alias("target"))


def _domain_range(properties: DataFrame) -> DataFrame:
    return properties.select("name", F.explode("domain").alias("d"), "range").select(
        "name", "d", F.explode("range").alias("r")
    )


def ontology_graph(onto: Ontology) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, kind) and edges (source, label, target, dangling).

    Undeclared names in a domain or range give edges to names without a node;
    these are marked as dangling.
    """
    sub, objects, data = onto.subclass_of, onto.object_properties, onto.data_properties
    node_table = _first_kind([
        (onto.classes, "name", "class"), (sub, "subclass", "class"), (sub, "superclass", "class"),
        (data, "range", "datatype"),
    ])
    edges = _union([
        _edges(sub, F.col("subclass"), F.lit("isA"), F.col("superclass")),
        _edges(_domain_range(objects), F.col("d"), F.col("name"), F.col("r")),
        _edges(data.select("name", F.explode("domain").alias("d"), "range"),
               F.col("d"), F.col("name"), F.col("range")),
    ])
    for end in ("source", "target"):
        names = node_table.select(F.col("node").alias(end), F.lit(True).alias(f"{end}_known"))
        edges = edges.join(names, end, "left")
    known = F.coalesce(F.col("source_known") & F.col("target_known"), F.lit(False))
    return node_table, edges.select("source", "label", "target", (~known).alias("dangling"))


def ontology_graph_simple(onto: Ontology) -> tuple[DataFrame, DataFrame]:
    """Variant in which every end of a relation or property becomes a node."""
    sub, objects, data = onto.subclass_of, onto.object_properties, onto.data_properties
    typed = data.select(
        "name", F.explode("domain").alias("d"), F.concat(F.lit("datatype: "), "range").alias("node")
    )
    pairs = _domain_range(objects)
    node_table = _first_kind([
        (sub, "subclass", "class"), (sub, "superclass", "class"),
        (objects.select(F.explode("domain").alias("d")), "d", "class"),
        (objects.select(F.explode("range").alias("r")), "r", "class"),
        (typed, "d", "class"),
        (data.select(F.concat(F.lit("datatype: "), "range").alias("node")), "node", "datatype"),
    ])
    edges = _union([
        _edges(sub, F.col("subclass"), F.lit("subClassOf"), F.col("superclass")),
        _edges(pairs, F.col("d"), F.col("name"), F.col("r")),
        _edges(typed, F.col("d"), F.col("name"), F.col("node")),
    ])
    return node_table, edges


def any_case_types(triples: DataFrame) -> DataFrame:
    """(node, group): the least type of each entity, isA read in any case."""
    return triples.where(F.lower("predicate") == "isa").groupBy(F.col("subject").alias("node")).agg(
        F.min("object").alias("group")
    )


def kg_graph(triples: DataFrame, with_ontology: bool = False, policy: SkewPolicy = DEFAULT_SKEW) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, degree, size, group) and edges (source, label, target, width).

    With an ontology the isA rows only give groups; without one they are edges.
    """
    drawn = triples.where(F.lower("predicate") != "isa") if with_ontology else triples
    degrees = degree(drawn)
    top = degrees.agg(F.max("degree")).scalar()
    node_table = degrees.join(any_case_types(triples), "node", "left").select(
        "node", "degree", node_size("degree", top).alias("size"),
        F.coalesce("group", F.lit("unclassified")).alias("group"),
    )
    counts = drawn.groupBy("predicate").agg(F.count(F.lit(1)).alias("frequency"))
    widths = counts.select(
        "predicate", edge_width("frequency", counts.agg(F.max("frequency")).scalar()).alias("width")
    )
    edges = lookup_join(drawn, widths, "predicate", hot=hot_keys(drawn, "predicate", policy)).select(
        F.col("subject").alias("source"), F.col("predicate").alias("label"),
        F.col("object").alias("target"), "width",
    )
    return node_table, edges


def kg_graph_simple(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All triples as edges, as wide as they are sure (column ``confidence``)."""
    confidence = F.col("confidence") if "confidence" in triples.columns else F.lit(None)
    edges = triples.select(
        F.col("subject").alias("source"), F.col("predicate").alias("label"),
        F.col("object").alias("target"), confidence_width(confidence).alias("width"),
    )
    return triples.select(F.explode(F.array("subject", "object")).alias("node")).distinct(), edges


def combined_graph(onto: Ontology, triples: DataFrame, policy: SkewPolicy = DEFAULT_SKEW) -> tuple[DataFrame, DataFrame]:
    """Ontology and graph in one view: nodes (node, kind, group), edges with origin.

    Properties are nodes here, with hasDomain and hasRange edges. A name that
    occurs as several kinds is one node; the kind that is added first wins.
    """
    sub, objects, data = onto.subclass_of, onto.object_properties, onto.data_properties
    facts = triples.where(F.lower("predicate") != "isa")
    object_domain = objects.select("name", F.explode("domain").alias("c"))
    object_range = objects.select("name", F.explode("range").alias("c"))
    data_domain = data.select("name", F.explode("domain").alias("c"))
    # The order in which names are added: hierarchy, then property by property.
    by_property = _union([
        objects.select(F.col("name").alias("node"), F.lit("property").alias("kind"), F.struct(F.lit(0).alias("t"), "seq", F.lit(0).alias("p")).alias("at")),
        objects.select(F.explode(F.concat("domain", "range")).alias("node"), F.lit("class").alias("kind"), F.struct(F.lit(0).alias("t"), "seq", F.lit(1).alias("p")).alias("at")),
        data.select(F.col("name").alias("node"), F.lit("property").alias("kind"), F.struct(F.lit(1).alias("t"), "seq", F.lit(0).alias("p")).alias("at")),
        data.select(F.explode("domain").alias("node"), F.lit("class").alias("kind"), F.struct(F.lit(1).alias("t"), "seq", F.lit(1).alias("p")).alias("at")),
        data.select(F.col("range").alias("node"), F.lit("datatype").alias("kind"), F.struct(F.lit(1).alias("t"), "seq", F.lit(2).alias("p")).alias("at")),
        sub.select(F.explode(F.array("subclass", "superclass")).alias("node"), F.lit("class").alias("kind"), F.struct(F.lit(-1).alias("t"), "seq", F.lit(0).alias("p")).alias("at")),
        facts.select(F.explode(F.array("subject", "object")).alias("node"), F.lit("instance").alias("kind"), F.struct(F.lit(2).alias("t"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("p")).alias("at")),
    ])
    kinds = by_property.groupBy("node").agg(F.min(F.struct("at", "kind")).alias("k")).select("node", "k.kind")
    types = any_case_types(triples)
    node_table = kinds.join(types, "node", "left").select(
        "node", "kind",
        F.when(F.col("kind") == "instance", F.coalesce("group", F.lit("instance")))
        .otherwise(F.concat(F.lit("ontology_"), "kind")).alias("group"),
    )
    is_a = triples.where(F.lower("predicate") == "isa").select("subject", "object").distinct()
    shown = node_table.select("node")
    is_a = lookup_join(is_a, shown.withColumnRenamed("node", "subject"), "subject", how="inner",
                       hot=hot_keys(triples, "subject", policy))
    is_a = lookup_join(is_a, shown.withColumnRenamed("node", "object"), "object", how="inner",
                       hot=hot_keys(triples, "object", policy))

    def part(origin: str, df: DataFrame, source, label, target) -> DataFrame:
        return _edges(df, source, label, target).withColumn("origin", F.lit(origin))

    edges = _union([
        part("subclass", sub, F.col("subclass"), F.lit("isA"), F.col("superclass")),
        part("object_domain", object_domain, F.col("c"), F.lit("hasDomain"), F.col("name")),
        part("object_range", object_range, F.col("name"), F.lit("hasRange"), F.col("c")),
        part("data_domain", data_domain, F.col("c"), F.lit("hasDomain"), F.col("name")),
        part("data_range", data, F.col("name"), F.lit("hasRange"), F.col("range")),
        part("instance", facts, F.col("subject"), F.col("predicate"), F.col("object")),
        part("type", is_a, F.col("subject"), F.lit("isA"), F.col("object")),
    ])
    return node_table, edges


def node_ids(names: DataFrame, scratch: Scratch | None = None, dense: bool = False, order: str = "first_seq") -> DataFrame:
    """(node, id): a 64-bit hash by default; dense ids from 1 in first-seen order.

    For dense ids ``names`` has (node, <order>); ties go by name.
    """
    if not dense:
        return names.select("node", F.xxhash64("node").alias("id"))
    return dense_index(names, [F.asc(order), F.asc("node")], "id", scratch, start=1).select("node", "id")


def first_seen(triples: DataFrame) -> DataFrame:
    """(node, first_seq): where each name occurs first, subject before object."""
    ends = triples.select(
        F.explode(F.array(
            F.struct(F.col("subject").alias("node"), F.lit(0).alias("end")),
            F.struct(F.col("object").alias("node"), F.lit(1).alias("end")),
        )).alias("e"),
        "batch_id", "seq",
    )
    return ends.groupBy(F.col("e.node").alias("node")).agg(
        F.min(F.struct("batch_id", "seq", F.col("e.end").alias("end"))).alias("first_seq")
    )
