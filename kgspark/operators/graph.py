"""Graph analytics on a triple table (subject, predicate, object).

Everything here is partial aggregation plus a small shuffle. Totals that a row
needs (greatest degree, number of edges) are scalar subqueries, so no global
window and no cross join occurs.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce
from itertools import count, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kgspark.functions.scalars import percent_of_total
from kgspark.operators.ontology import Ontology, ontology_metrics
from kgspark.skew import DEFAULT_SKEW, NO_HOT_KEYS, SkewPolicy, hot_keys, lookup_join, too_small
from kgspark.storage import Scratch, local_table


def nodes(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("subject", "object")).alias("node")).distinct()


def degree(triples: DataFrame) -> DataFrame:
    """Times a node is a subject or object; a self-loop counts twice."""
    ends = triples.select(F.explode(F.array("subject", "object")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_incident(triples: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """Number of edges at a node; a self-loop counts once, a lone node has 0."""
    ends = triples.select(
        F.explode(F.array_distinct(F.array("subject", "object"))).alias("node"), F.lit(1).alias("one")
    )
    if all_nodes is not None:
        ends = ends.unionByName(all_nodes.select("node", F.lit(0).alias("one")))
    return ends.groupBy("node").agg(F.sum("one").alias("degree"))


def graph_metrics(triples: DataFrame) -> DataFrame:
    """node_count, edge_count and density in one row."""
    n = nodes(triples).agg(F.count(F.lit(1)).alias("n")).scalar()
    return triples.agg(F.count(F.lit(1)).alias("edge_count")).select(
        n.alias("node_count"),
        "edge_count",
        F.when(n > 1, F.col("edge_count") / (n.cast("double") * (n - 1).cast("double")))
        .otherwise(F.lit(0.0)).alias("density"),
    )


def degree_distribution(degrees: DataFrame) -> DataFrame:
    return degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("entities"))


def degree_histogram_report(degrees: DataFrame) -> DataFrame:
    """(bin, label, entities): about 20 bins once there are over 20 distinct degrees."""
    counts = degree_distribution(degrees)
    stats = counts.agg(F.count(F.lit(1)).alias("k"), F.max("degree").alias("top"))
    distinct = stats.select("k").scalar()
    width = F.when(
        distinct > 20, F.greatest(F.lit(1), F.floor(stats.select("top").scalar() / 20))
    ).cast("long")
    binned = counts.withColumn("width", width).withColumn(
        "bin", F.when(F.col("width").isNull(), F.col("degree"))
        .otherwise(F.floor(F.col("degree") / F.col("width")).cast("long"))
    )
    label = F.when(F.col("width").isNull(), F.col("bin").cast("string")).otherwise(
        F.concat_ws("-", F.col("bin") * F.col("width"), (F.col("bin") + 1) * F.col("width") - 1)
    )
    return binned.withColumn("label", label).groupBy("bin", "label").agg(
        F.sum("entities").alias("entities")
    )


def degree_histogram_page(degrees: DataFrame) -> DataFrame:
    """(bin, label, entities): at most about 30 bins from 0, empty ones included."""
    counts = degree_distribution(degrees)
    top = counts.agg(F.max("degree").alias("top")).select(
        "top", F.when(F.col("top") > 30, F.ceil(F.col("top") / 30)).otherwise(F.lit(1)).cast("long").alias("width")
    )
    bins = top.where("top is not null").select(
        "top", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / F.col("width")))).alias("bin")
    )
    width = top.select("width").scalar()
    filled = counts.groupBy(F.floor(F.col("degree") / width).alias("bin")).agg(
        F.sum("entities").alias("entities")
    )
    first = F.col("bin") * F.col("width")
    last = F.least(first + F.col("width") - 1, F.col("top"))
    label = F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first, last))
    return bins.join(filled, "bin", "left").select(
        "bin", label.alias("label"), F.coalesce("entities", F.lit(0)).cast("long").alias("entities")
    )


def average_degree(degrees: DataFrame) -> DataFrame:
    return degrees.agg(F.avg("degree").alias("avg_degree"))


def predicate_distribution(triples: DataFrame) -> DataFrame:
    counts = triples.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))
    return percent_of_total(counts, "n")


def top_k(df: DataFrame, value: str, key: str, k: int = 10) -> DataFrame:
    """The k greatest, ties by key: kept per task, never a global sort."""
    return df.orderBy(F.desc(value), F.asc(key)).limit(k)


def top_k_with_other(df: DataFrame, value: str, key: str, k: int = 10) -> DataFrame:
    """(key, value, is_other): the k greatest and one row that sums up the rest."""
    best = top_k(df.select(key, value), value, key, k)
    rest = df.join(best.select(key), key, "left_anti").agg(
        F.sum(value).alias(value), F.count(F.lit(1)).alias("_keys")
    ).where("_keys > 0")
    return best.select(key, value, F.lit(False).alias("is_other")).unionByName(
        rest.select(F.lit("Other").alias(key), value, F.lit(True).alias("is_other"))
    )


def centrality(triples: DataFrame, k: int = 10) -> DataFrame:
    return top_k(degree(triples), "degree", "node", k)


def edge_types(triples: DataFrame) -> DataFrame:
    return triples.where("predicate is not null and predicate != ''").select(
        F.col("predicate").alias("edge_type")
    ).distinct()


def node_groups(node_table: DataFrame) -> DataFrame:
    """(group, size) of the nodes that have a group."""
    return node_table.where("group is not null and group != ''").groupBy("group").agg(
        F.count(F.lit(1)).alias("size")
    )


def neighbors(triples: DataFrame, node: str) -> DataFrame:
    """Distinct nodes next to one node, either direction; a loop lists the node."""
    here = triples.where((F.col("subject") == node) | (F.col("object") == node))
    return here.select(
        F.when(F.col("subject") == node, F.col("object")).otherwise(F.col("subject")).alias("neighbor")
    ).distinct()


def neighbor_counts(triples: DataFrame) -> DataFrame:
    """Number of distinct neighbours of every node."""
    both = triples.select("subject", "object").unionByName(
        triples.select(F.col("object").alias("subject"), F.col("subject").alias("object"))
    ).distinct()
    return both.groupBy(F.col("subject").alias("node")).agg(F.count(F.lit(1)).alias("neighbors"))


def edge_lookup(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """First edge from ``source`` to ``target`` for each pair asked for."""
    first = triples.groupBy("subject", "object").agg(
        F.min(F.struct("batch_id", "seq", "predicate")).alias("first")
    )
    wanted = pairs.select(F.col("source").alias("subject"), F.col("target").alias("object")).distinct()
    return first.join(wanted, ["subject", "object"], "left_semi").select(
        F.col("subject").alias("source"), F.col("object").alias("target"),
        F.col("first.predicate").alias("label"),
    )


def hub_node(degrees: DataFrame) -> DataFrame:
    return top_k(degrees, "degree", "node", 1)


class Adjacency:
    """Edges in both directions, bucketed by node once: joins with a set of nodes do not move them.

    They are shuffled once, to their buckets. Copies of an edge stay, as they change no set of
    next nodes and a shuffle to merge them costs more than they do. Edges of hub nodes, found once,
    are dealt to parts, so that no bucket holds a hub whole; the few rows of ``hot`` tell how many
    parts a node has. ``close`` drops the table's entry.
    """

    def __init__(self, triples: DataFrame, scratch: Scratch, policy: SkewPolicy = DEFAULT_SKEW):
        spark = self.spark = triples.sparkSession
        edges = triples.select(F.col("subject").alias("node"), F.col("object").alias("other"))
        edges = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        self.nodes = edges.select("node")
        edges = edges.where("node != other")
        if too_small(triples, policy):
            hot = local_table(spark, [], "hot_key string, splits int")
        else:
            # Triples are sampled before both ends are taken; shares scale to all triples.
            share = min(policy.sample, 1.0)
            part = replace(policy, sample=1.0, min_rows=max(1, int(policy.min_rows * share)),
                           rows_per_split=max(1, int(policy.rows_per_split * share)))
            rows = triples.sample(fraction=share, seed=7) if share < 1.0 else triples
            ends = rows.where("subject != object").select(F.explode(F.array("subject", "object")).alias("node"))
            hot = hot_keys(ends, "node", part)
        self.hot = scratch.save(hot.withColumnRenamed("hot_key", "node"), "hot")
        split = edges.join(F.broadcast(self.hot), "node", "left").select(
            "node", F.when(F.col("splits").isNotNull(), F.pmod(F.xxhash64("other"), F.col("splits"))).otherwise(0).cast("int").alias("part"),
            "other",
        )
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"adjacency_{uuid.uuid4().hex}"
        # One task per bucket writes one file, sorted, so that joins need no sort either.
        split.repartition(buckets, "node", "part").write.bucketBy(buckets, "node", "part").sortBy("node", "part").option(
            "path", scratch.new_path("adjacency")
        ).saveAsTable(self.name)

    def next_to(self, frontier: DataFrame) -> DataFrame:
        """(node) of the distinct nodes next to those of ``frontier``."""
        parts = frontier.join(F.broadcast(self.hot), "node", "left").select(
            "node", F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)).alias("part")
        )
        met = self.spark.table(self.name).join(parts, ["node", "part"])
        return met.select(F.col("other").alias("node")).distinct()

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def bfs_levels(
    triples: DataFrame, start: str, scratch: Scratch, policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """(node, level): undirected hops from ``start``; unreachable nodes are absent.

    There is no limit on levels: the search ends with the first empty one. A start
    that is only linked to itself has level 0; one that is no node gives no rows.
    Edges are shuffled once, before the first level; each level is written once.
    """
    spark = triples.sparkSession
    graph = Adjacency(triples, scratch, policy)
    try:
        path = scratch.new_path("levels")
        graph.nodes.where(F.col("node") == start).limit(1).write.parquet(f"{path}/level=0")
        for level in count():
            frontier = spark.read.schema("node string").parquet(f"{path}/level={level}")
            visited = spark.read.schema("node string, level int").parquet(path)
            # The path already holds this level's folders, so write beside and read back.
            graph.next_to(frontier).join(visited.select("node"), "node", "left_anti").write.parquet(f"{path}/level={level + 1}")
            if spark.read.schema("node string").parquet(f"{path}/level={level + 1}").isEmpty():
                break
    finally:
        graph.close()
    return spark.read.schema("node string, level int").parquet(path)


def group_collapse(node_table: DataFrame, edges: DataFrame, policy: SkewPolicy = DEFAULT_SKEW) -> tuple[DataFrame, DataFrame]:
    """Merge the nodes of each group into one super-node; edges are re-pointed.

    ``node_table`` (node, group) and ``edges`` (source, target, label). A node
    without a group stays itself. Returns (super-nodes, edges with weight).
    """
    named = node_table.select("node", F.coalesce("group", "node").alias("super"))
    supers = node_table.groupBy(
        F.coalesce("group", "node").alias("node"), F.col("group").isNotNull().alias("is_group")
    ).agg(F.count(F.lit(1)).alias("members"))
    supers = supers.withColumn(
        "label", F.when(F.col("is_group"), F.concat("node", F.lit(" ("), F.col("members").cast("string"), F.lit(")")))
        .otherwise(F.col("node"))
    ).withColumn("size", F.lit(20) + F.least("members", F.lit(20)))
    # Parallel edges are counted before the joins, which shrinks what is shuffled.
    counted = edges.groupBy("source", "target", "label").agg(F.count(F.lit(1)).alias("n"))
    rows = counted
    for end in ("source", "target"):
        table = named.select(F.col("node").alias(end), F.col("super").alias(f"{end}_group"))
        rows = lookup_join(rows, table, end, how="inner", hot=hot_keys(edges, end, policy))
    collapsed = rows.groupBy("source_group", "target_group", "label").agg(F.sum("n").alias("edges"))
    return supers, collapsed


def filter_graph(
    node_table: DataFrame, edges: DataFrame, groups: list[str] | None = None,
    labels: list[str] | None = None, min_degree: int = 1, policy: SkewPolicy = DEFAULT_SKEW,
) -> tuple[DataFrame, DataFrame]:
    """Visible nodes and edges; an empty selection restricts nothing.

    ``node_table`` (node, group, degree). A node without a group always passes
    the group test; an edge without a label always passes the label test.
    """
    kept = node_table
    if groups:
        has_group = F.col("group").isNotNull() & (F.col("group") != "")
        kept = kept.where(~has_group | F.col("group").isin(groups))
    if min_degree > 1:
        kept = kept.where(F.col("degree") >= min_degree)
    shown = edges
    if labels:
        has_label = F.col("label").isNotNull() & (F.col("label") != "")
        shown = shown.where(~has_label | F.col("label").isin(labels))
    for end in ("source", "target"):
        shown = lookup_join(
            shown, kept.select(F.col("node").alias(end)), end, how="inner", hot=hot_keys(edges, end, policy)
        )
    return kept, shown.select(edges.columns)


def filter_kg(
    triples: DataFrame, predicates: list[str] | None = None, entity_types: list[str] | None = None,
    exclude_entities: list[str] | None = None, policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Triples that pass the criteria; None means no restriction.

    With ``entity_types`` a row that is no isA row needs one end with a type of
    the list (isA in any case).
    """
    rows = triples
    if predicates is not None:
        rows = rows.where(F.col("predicate").isin(predicates))
    if exclude_entities is not None:
        rows = rows.where(
            ~F.col("subject").isin(exclude_entities) & ~F.col("object").isin(exclude_entities)
        )
    if entity_types is None:
        return rows
    is_isa = F.lower("predicate") == "isa"
    wanted = triples.where((F.lower("predicate") == "isa") & F.col("object").isin(entity_types)).select(
        F.col("subject").alias("node")
    ).distinct()
    facts = rows.where(~is_isa)
    for end in ("subject", "object"):
        table = wanted.select(F.col("node").alias(end), F.lit(True).alias(f"{end}_wanted"))
        facts = lookup_join(facts, table, end, hot=hot_keys(triples, end, policy))
    facts = facts.where("subject_wanted or object_wanted").select(triples.columns)
    return rows.where(is_isa).unionByName(facts)


LONGEST = 62  # characters of a query whose distances fit one machine number


def qgram_filter(query: str, errors: int) -> tuple[list[str], int]:
    """(grams of the query, how many of them a text must hold) to be within ``errors`` edits.

    An edit destroys at most q of the query's grams; the longest grams that still leave one
    to be found are taken. No text is excluded if no length does.
    """
    for q in (3, 2, 1):
        need = len(query) - q + 1 - errors * q
        if need >= 1:
            return [query[i:i + q] for i in range(len(query) - q + 1)], need
    return [], 0


def substring_distance(text: Column, query: str) -> Column:
    """Least number of edits that turn the query into some part of the text.

    One pass over the characters by bit-parallel dynamic programming (Myers, JACM 1999): the
    differences between neighbouring rows of Sellers' column are the bits of two numbers,
    and numpy steps through many texts at once. Queries of up to ``LONGEST`` characters;
    null texts give null.
    """
    if not 0 < len(query) <= LONGEST:
        raise ValueError(f"a query has 1 to {LONGEST} characters")

    def distances(texts: pd.Series) -> pd.Series:
        codes, values = pd.factorize(texts)
        best = np.append(least_edits(list(values), query), 0)  # the last is for nulls, whose code is -1
        return pd.Series(pd.arrays.IntegerArray(best[codes].astype(np.int32), codes < 0))

    # Not deterministic for the planner, or it would compare once for a filter and again for its column.
    return F.pandas_udf(distances, "int").asNondeterministic()(text)


def least_edits(texts: list[str], query: str, step: int = 256, rows: int = 8192) -> np.ndarray:
    """Least distance of the query to a part of each text.

    Long texts are cut every ``step`` characters; a best part has at most twice the
    query's length, and the pieces overlap by that much, so none is lost.
    """
    m, out = len(query), np.full(len(texts), len(query), np.int64)
    full, last, one = np.uint64((1 << m) - 1), np.uint64(1 << (m - 1)), np.uint64(1)
    top = max(map(ord, query)) + 1
    masks = np.zeros(top + 1, np.uint64)
    for i, c in enumerate(query):
        masks[ord(c)] |= np.uint64(1 << i)
    pieces = ((i, text[at:at + step + 2 * m]) for i, text in enumerate(texts) for at in range(0, len(text), step))
    while part := list(islice(pieces, rows)):
        at, cut = np.array([i for i, _ in part]), [piece for _, piece in part]
        size = np.array([len(piece) for piece in cut])
        width = size.max()
        letters = np.array(cut, dtype=f"U{width}").view(np.uint32).reshape(len(cut), width)
        equals = masks[np.minimum(letters, top)]
        plus, minus = np.full(len(cut), full), np.zeros(len(cut), np.uint64)
        score, best = np.full(len(cut), m), np.full(len(cut), m)
        for j in range(width):
            equal = equals[:, j]
            across = equal | minus
            down = (((equal & plus) + plus) ^ plus) | equal
            more, less = minus | (full & ~(down | plus)), plus & down
            score = score + ((more & last) != 0) - ((less & last) != 0)
            best = np.where(j < size, np.minimum(best, score), best)
            more, less = (more << one) & full, (less << one) & full
            plus, minus = less | (full & ~(across | more)), more & across
        np.minimum.at(out, at, best)
    return out


def fuzzy_matches(items: DataFrame, fields: list[str], query: str, threshold: float = 0.3) -> DataFrame:
    """The items with a field that matches, wherever in it: (item columns, score), see ``fuzzy_search``."""
    query = query.lower()
    if len(query) < 2:
        return items.where(F.lit(False)).withColumn("score", F.lit(0.0))
    grams, need = qgram_filter(query, int(threshold * len(query) + 1e-9))
    may, scores = [], []
    for field in fields:
        text = F.lower(F.col(field))
        if need:
            held = reduce(lambda a, b: a + b, [F.contains(text, F.lit(g)).cast("int") for g in grams])
            may.append(F.coalesce(held >= need, F.lit(False)))
            text = F.when(may[-1], text)
        scores.append(substring_distance(text, query) / F.lit(float(len(query))))
    if need:  # rows without a candidate are not handed to Python
        items = items.where(reduce(lambda a, b: a | b, may))
    best = scores[0] if len(scores) == 1 else F.least(*scores)
    return items.withColumn("score", best).where(F.col("score") <= threshold)


def fuzzy_search(
    items: DataFrame, fields: list[str], query: str, threshold: float = 0.3, k: int = 10
) -> DataFrame:
    """The k best items by how well a field matches, wherever in it: (item columns, score).

    The score is the least number of edits that turn the query into a part of a field,
    over the query's length; a field that holds the query scores 0. Only fields with
    enough of the query's grams are compared. Needs a query of two or more characters.
    """
    return fuzzy_matches(items, fields, query, threshold).orderBy("score", *fields).limit(k)


def search_graph(
    node_table: DataFrame, edges: DataFrame, query: str, scope: str = "all", threshold: float = 0.3, k: int = 10
) -> DataFrame:
    """Search nodes (label, group) and edges (label, ends): (kind, item, score)."""
    parts = []
    if scope in ("all", "nodes"):
        hits = fuzzy_search(node_table.select("node", "group"), ["node", "group"], query, threshold, k)
        parts.append(hits.select(F.lit("node").alias("kind"), F.col("node").alias("item"), "score"))
    if scope in ("all", "edges"):
        # Copies are merged among the matches only.
        fields = ["label", "source", "target"]
        hits = fuzzy_matches(edges.select("source", "label", "target"), fields, query, threshold).distinct()
        hits = hits.orderBy("score", *fields).limit(k)
        item = F.concat_ws(" ", "source", "label", "target").alias("item")
        parts.append(hits.select(F.lit("edge").alias("kind"), item, "score"))
    found = reduce(DataFrame.unionByName, parts)
    return found.orderBy("score", F.desc("kind"), "item").limit(k)


def graph_statistics(node_table: DataFrame, triples: DataFrame) -> DataFrame:
    """nodes, edges, avg_degree, edge_types, node_groups in one row."""
    per_node = degree_incident(triples, node_table.select("node"))
    totals = per_node.agg(F.count(F.lit(1)).alias("nodes"), F.avg("degree").alias("avg_degree"))
    return totals.select(
        "nodes",
        triples.agg(F.count(F.lit(1))).scalar().alias("edges"),
        "avg_degree",
        edge_types(triples).agg(F.count(F.lit(1))).scalar().alias("edge_types"),
        node_groups(node_table).agg(F.count(F.lit(1))).scalar().alias("node_groups"),
    )


def analysis_report(triples: DataFrame, onto: Ontology | None = None) -> DataFrame:
    """All metrics in long form: (section, key, value)."""
    def rows(section: str, df: DataFrame, key, value) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value")
        )

    degrees = degree(triples)
    metrics = graph_metrics(triples)
    summary = metrics.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("key"), F.col(name).cast("double").alias("value"))
        for name in ("node_count", "edge_count", "density")
    ])).alias("m"))
    predicates = predicate_distribution(triples)
    chart = top_k_with_other(predicates, "n", "predicate")
    parts = [
        rows("summary", summary, F.col("m.key"), F.col("m.value")),
        rows("degree_histogram", degree_histogram_report(degrees), F.col("label"), F.col("entities")),
        rows("predicate_count", predicates, F.col("predicate"), F.col("n")),
        rows("predicate_percent", predicates, F.col("predicate"), F.col("percent")),
        rows("predicate_chart", chart, F.when(F.col("is_other"), F.lit("(other)")).otherwise(F.col("predicate")),
             F.col("n")),
        rows("centrality", top_k(degrees, "degree", "node"), F.col("node"), F.col("degree")),
    ]
    if onto is not None:
        counts = ontology_metrics(onto).select(F.explode(F.array(*[
            F.struct(F.lit(name).alias("key"), F.col(name).alias("value"))
            for name in ("classes", "object_properties", "data_properties")
        ])).alias("m"))
        parts.append(rows("ontology", counts, F.col("m.key"), F.col("m.value")))
    return reduce(DataFrame.unionByName, parts)
