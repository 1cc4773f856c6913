"""G1-G23: analytics on the star schema's graph."""

from pyspark.sql import functions as F

from kgspark.operators import graph as G
from kgspark.operators import views as V
from kgspark.plans.ontology_queries import SQL_PROFILE, induced_ontology
from kgspark.plans.registry import n_rows, query
from kgspark.plans.star import SQL_RAW, SQL_STAR, SUBCLASS_OF, raw_triples, star_triples


SQL_ENDS = "ends AS (SELECT s AS node FROM kg UNION ALL SELECT o FROM kg)"
SQL_DEG = f"{SQL_ENDS}, deg AS (SELECT node, count(*) AS degree FROM ends GROUP BY node)"


def kg(t):
    """The graph as a table, for jobs that read it more than once."""
    return t.scratch.save(star_triples(t), "kg")


@query("G1_nodes", f"WITH {SQL_STAR}, {SQL_ENDS} SELECT DISTINCT node FROM ends")
def g1(t):
    return G.nodes(star_triples(t))


@query("G2_graph_metrics", f"""WITH {SQL_STAR}, {SQL_ENDS}, n AS (SELECT count(DISTINCT node) AS n FROM ends)
SELECT n AS node_count, (SELECT count(*) FROM kg) AS edge_count, round((SELECT count(*) FROM kg) / (n * (n - 1.0)), 12) AS density FROM n""")
def g2(t):
    return G.graph_metrics(star_triples(t)).withColumn("density", F.round("density", 12))


@query("G3_degree", f"WITH {SQL_STAR}, {SQL_DEG} SELECT node, degree FROM deg")
def g3(t):
    return G.degree(star_triples(t))


# Every order gets a self-loop, which the two forms of degree count differently.
def looped(t):
    loops = t.orders.selectExpr(
        "concat('order_', o_orderkey) AS subject", "'sameAs' AS predicate",
        "concat('order_', o_orderkey) AS object", "o_orderkey + 4 AS batch_id", "o_orderkey * 64 + 63 AS seq",
    )
    return star_triples(t).unionByName(loops)


SQL_LOOPED = f"{SQL_STAR.replace('kg AS (', 'kg0 AS (', 1)}, kg AS (SELECT * FROM kg0 UNION ALL SELECT 'order_' || o_orderkey, 'sameAs', 'order_' || o_orderkey, o_orderkey + 4, o_orderkey * 64 + 63 FROM orders)"


@query("G4_degree_incident", f"""WITH {SQL_LOOPED}, ends AS (SELECT s AS node FROM kg UNION ALL SELECT o FROM kg WHERE o <> s),
d AS (SELECT node, count(*) AS degree FROM ends GROUP BY node)
SELECT node, degree FROM d UNION ALL SELECT 'lone_' || s_suppkey, CAST(0 AS BIGINT) FROM supplier""")
def g4(t):
    lone = t.supplier.selectExpr("concat('lone_', s_suppkey) AS node")
    return G.degree_incident(looped(t), lone)


@query("G5_degree_distribution", f"WITH {SQL_STAR}, {SQL_DEG} SELECT degree, count(*) AS entities FROM deg GROUP BY 1")
def g5(t):
    return G.degree_distribution(G.degree(star_triples(t)))


@query("G6_degree_histogram_report", f"""WITH {SQL_STAR}, {SQL_DEG},
st AS (SELECT CASE WHEN count(DISTINCT degree) > 20 THEN greatest(1, max(degree) // 20) END AS w FROM deg)
SELECT CASE WHEN w IS NULL THEN degree ELSE degree // w END AS bin,
  CASE WHEN w IS NULL THEN CAST(degree AS VARCHAR) ELSE (degree // w) * w || '-' || ((degree // w) + 1) * w - 1 END AS label, count(*) AS entities
FROM deg, st GROUP BY 1, 2""")
def g6(t):
    return G.degree_histogram_report(t.scratch.save(G.degree(star_triples(t)), "degree"))


@query("G7_degree_histogram_page", f"""WITH {SQL_STAR}, {SQL_DEG},
st AS (SELECT max(degree) AS top, CASE WHEN max(degree) > 30 THEN CAST(ceil(max(degree) / 30.0) AS BIGINT) ELSE 1 END AS w FROM deg),
b AS (SELECT unnest(range(0, top // w + 1)) AS bin, w, top FROM st)
SELECT bin, CASE WHEN bin * w = least(bin * w + w - 1, top) THEN CAST(bin * w AS VARCHAR) ELSE bin * w || '-' || least(bin * w + w - 1, top) END AS label,
  (SELECT count(*) FROM deg WHERE degree // w = bin) AS entities FROM b""")
def g7(t):
    return G.degree_histogram_page(t.scratch.save(G.degree_incident(star_triples(t)), "degree"))


@query("G8_avg_degree", f"WITH {SQL_STAR}, {SQL_DEG} SELECT round(avg(degree), 9) AS avg_degree FROM deg")
def g8(t):
    return G.average_degree(G.degree_incident(star_triples(t))).withColumn("avg_degree", F.round("avg_degree", 9))


@query("G9_predicate_distribution", f"""WITH {SQL_STAR}, f AS (SELECT p, count(*) AS n FROM kg GROUP BY p)
SELECT p AS predicate, n, round(n * 100.0 / (SELECT sum(n) FROM f), 1) AS percent FROM f""")
def g9(t):
    return G.predicate_distribution(star_triples(t))


@query("G10_centrality_top10", f"WITH {SQL_STAR}, {SQL_DEG} SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 10")
def g10(t):
    return G.centrality(star_triples(t))


@query("G11_edge_types", f"WITH {SQL_STAR} SELECT DISTINCT p AS edge_type FROM kg WHERE p <> ''")
def g11(t):
    return G.edge_types(star_triples(t))


SQL_TYPES = "ty AS (SELECT s AS node, min(o) AS grp FROM kg WHERE lower(p) = 'isa' GROUP BY s)"


@query("G12_node_groups", f"""WITH {SQL_STAR}, {SQL_TYPES}, x AS (SELECT grp, count(*) AS n FROM ty GROUP BY 1),
best AS (SELECT * FROM x ORDER BY n DESC, grp LIMIT 3)
SELECT grp AS "group", n AS size, FALSE AS is_other FROM best
UNION ALL SELECT 'Other', CAST(sum(n) AS BIGINT), TRUE FROM x WHERE grp NOT IN (SELECT grp FROM best) HAVING count(*) > 0""")
def g12(t):
    groups = G.node_groups(V.any_case_types(star_triples(t)))
    return G.top_k_with_other(groups, "size", "group", 3)


@query("G13_neighbors", f"""WITH {SQL_LOOPED}, e AS (SELECT s, o FROM kg UNION SELECT o, s FROM kg),
c AS (SELECT s AS node, count(*) AS neighbors FROM e GROUP BY 1)
SELECT node, neighbors, node IN (SELECT o FROM kg WHERE s = 'order_7' UNION SELECT s FROM kg WHERE o = 'order_7') AS next_to_order_7 FROM c""")
def g13(t):
    graph = t.scratch.save(looped(t), "kg")
    near = G.neighbors(graph, "order_7").select(F.col("neighbor").alias("node"), F.lit(True).alias("next_to_order_7"))
    return G.neighbor_counts(graph).join(near, "node", "left").withColumn(
        "next_to_order_7", F.coalesce("next_to_order_7", F.lit(False))
    )


@query("G14_edge_lookup", f"""WITH {SQL_RAW}, w AS (SELECT DISTINCT 'order_' || o_orderkey AS s, 'customer_' || o_custkey AS o FROM orders)
SELECT s AS source, o AS target, arg_min(p, (b, q)) AS label FROM kg SEMI JOIN w USING (s, o) GROUP BY 1, 2""")
def g14(t):
    pairs = t.orders.selectExpr("concat('order_', o_orderkey) AS source", "concat('customer_', o_custkey) AS target")
    return G.edge_lookup(raw_triples(t), pairs)


@query("G15_bfs_levels", f"""WITH RECURSIVE {SQL_STAR}, e AS MATERIALIZED (SELECT DISTINCT s AS a, o AS b FROM kg WHERE p <> 'isA' UNION SELECT o, s FROM kg WHERE p <> 'isA'),
bfs(node, level) AS (SELECT 'region_0', 0 UNION SELECT e.b, level + 1 FROM bfs JOIN e ON e.a = bfs.node WHERE level < 12)
SELECT node, min(level) AS level FROM bfs GROUP BY node""")
def g15(t):
    facts = star_triples(t).where("predicate != 'isA'")
    return G.bfs_levels(facts, "region_0", t.scratch)


@query("G16_hub_node", f"WITH {SQL_STAR}, {SQL_DEG} SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 1")
def g16(t):
    return G.hub_node(G.degree(star_triples(t)))


@query("G17_group_collapse", f"""WITH {SQL_STAR}, {SQL_ENDS}, {SQL_TYPES}, k2 AS (SELECT * FROM kg WHERE p <> 'isA'),
nd AS (SELECT DISTINCT node FROM (SELECT s AS node FROM k2 UNION ALL SELECT o FROM k2)),
sup AS (SELECT node, coalesce(grp, node) AS sup FROM nd LEFT JOIN ty USING (node))
SELECT a.sup AS source_group, b.sup AS target_group, p AS label, count(*) AS edges FROM k2 JOIN sup a ON a.node = s JOIN sup b ON b.node = o GROUP BY ALL
UNION ALL SELECT '(node)', sup || CASE WHEN sup IN (SELECT grp FROM ty) THEN ' (' || count(*) || ')' ELSE '' END, CAST(20 + least(count(*), 20) AS VARCHAR), count(*) FROM sup GROUP BY sup""")
def g17(t):
    graph = kg(t)
    facts = graph.where("predicate != 'isA'")
    nodes = G.nodes(facts).join(V.any_case_types(graph), "node", "left")
    edges = facts.select(F.col("subject").alias("source"), F.col("object").alias("target"), F.col("predicate").alias("label"))
    supers, collapsed = G.group_collapse(nodes, edges)
    return collapsed.unionByName(supers.select(
        F.lit("(node)").alias("source_group"), F.col("label").alias("target_group"),
        F.col("size").cast("string").alias("label"), F.col("members").alias("edges"),
    ))


@query("G18_filter_graph", f"""WITH {SQL_STAR}, {SQL_DEG}, {SQL_TYPES},
keep AS (SELECT node FROM deg LEFT JOIN ty USING (node) WHERE degree >= 3 AND (grp IS NULL OR grp IN ('Order', 'Customer', 'Nation')))
SELECT p AS label, count(*) AS edges, (SELECT count(*) FROM keep) AS nodes_visible FROM kg
WHERE p IN ('placedBy', 'locatedIn', 'shippedBy', 'hasStatus') AND s IN (SELECT node FROM keep) AND o IN (SELECT node FROM keep) GROUP BY 1""")
def g18(t):
    graph = kg(t)
    nodes = G.degree(graph).join(V.any_case_types(graph), "node", "left")
    edges = graph.select(F.col("subject").alias("source"), F.col("object").alias("target"), F.col("predicate").alias("label"))
    kept, shown = G.filter_graph(
        nodes, edges, ["Order", "Customer", "Nation"], ["placedBy", "locatedIn", "shippedBy", "hasStatus"], 3
    )
    total = kept.agg(F.count(F.lit(1))).scalar()
    return shown.groupBy("label").agg(F.count(F.lit(1)).alias("edges")).withColumn("nodes_visible", total)


@query("G19_filter_kg", f"""WITH {SQL_STAR}, w AS (SELECT s FROM kg WHERE lower(p) = 'isa' AND o IN ('Supplier', 'Nation'))
SELECT p AS predicate, count(*) AS n, CAST(sum(q) AS BIGINT) AS seq_sum FROM kg
WHERE p IN ('isA', 'locatedIn', 'shippedBy', 'partOf', 'hasStatus') AND s NOT IN ('nation_3', 'supplier_5') AND o NOT IN ('nation_3', 'supplier_5')
  AND (lower(p) = 'isa' OR s IN (SELECT s FROM w) OR o IN (SELECT s FROM w)) GROUP BY 1""")
def g19(t):
    rows = G.filter_kg(
        kg(t), ["isA", "locatedIn", "shippedBy", "partOf", "hasStatus"], ["Supplier", "Nation"], ["nation_3", "supplier_5"]
    )
    return rows.groupBy("predicate").agg(n_rows(), F.sum("seq").alias("seq_sum"))


def _sql_score(column: str, query_text: str) -> str:
    """Least distance to any part of a field, by trying all parts of about the query's length."""
    m = len(query_text)
    sizes = list(range(m - int(0.3 * m), m + int(0.3 * m) + 1))
    return (
        f"list_min(flatten([[levenshtein(substr(lower({column}), i, n), '{query_text}') FOR n IN {sizes}] "
        f"FOR i IN range(1, length({column}) + 1)])) / {float(m)}"
    )


@query("G20_fuzzy_search", f"""WITH {SQL_STAR}, {SQL_ENDS}, {SQL_TYPES},
nd AS (SELECT DISTINCT node, coalesce(grp, 'unclassified') AS g FROM ends LEFT JOIN ty USING (node)),
ns AS (SELECT 'node' AS kind, node AS item, least({_sql_score('node', 'custmer_1')}, {_sql_score('g', 'custmer_1')}) AS score FROM nd),
es AS (SELECT 'edge' AS kind, s || ' ' || p || ' ' || o AS item, least({_sql_score('p', 'custmer_1')}, {_sql_score('s', 'custmer_1')}, {_sql_score('o', 'custmer_1')}) AS score FROM (SELECT DISTINCT s, p, o FROM kg)),
n10 AS (SELECT * FROM ns WHERE score <= 0.3 ORDER BY score, item LIMIT 10),
e10 AS (SELECT * FROM es WHERE score <= 0.3 ORDER BY score, item LIMIT 10)
SELECT kind, item, round(score, 6) AS score FROM (SELECT * FROM n10 UNION ALL SELECT * FROM e10) ORDER BY score, kind DESC, item LIMIT 10""")
def g20(t):
    graph = kg(t)
    nodes = G.nodes(graph).join(V.any_case_types(graph), "node", "left").select(
        "node", F.coalesce("group", F.lit("unclassified")).alias("group")
    )
    edges = graph.select(F.col("subject").alias("source"), F.col("predicate").alias("label"), F.col("object").alias("target"))
    return G.search_graph(nodes, edges, "custmer_1").withColumn("score", F.round("score", 6))


@query("G21_graph_statistics", f"""WITH {SQL_STAR}, {SQL_DEG}, {SQL_TYPES}
SELECT count(*) AS nodes, (SELECT count(*) FROM kg) AS edges, round(avg(degree), 9) AS avg_degree,
  (SELECT count(DISTINCT p) FROM kg) AS edge_types, (SELECT count(DISTINCT grp) FROM ty) AS node_groups FROM deg""")
def g21(t):
    graph = kg(t)
    nodes = G.nodes(graph).join(V.any_case_types(graph), "node", "left")
    return G.graph_statistics(nodes, graph).withColumn("avg_degree", F.round("avg_degree", 9))


@query("G23_analysis_report", f"""WITH {SQL_STAR}, {SQL_DEG}, {SQL_PROFILE}, f AS (SELECT p, count(*) AS n FROM kg GROUP BY p),
st AS (SELECT CASE WHEN count(DISTINCT degree) > 20 THEN greatest(1, max(degree) // 20) END AS w, count(*) AS nodes FROM deg),
r AS (
  SELECT 'summary' AS section, 'node_count' AS key, CAST(nodes AS DOUBLE) AS value FROM st
  UNION ALL SELECT 'summary', 'edge_count', count(*) FROM kg
  UNION ALL SELECT 'summary', 'density', (SELECT count(*) FROM kg) / (nodes * (nodes - 1.0)) FROM st
  UNION ALL SELECT 'degree_histogram', CASE WHEN w IS NULL THEN CAST(degree AS VARCHAR) ELSE (degree // w) * w || '-' || ((degree // w) + 1) * w - 1 END, count(*) FROM deg, st GROUP BY 2
  UNION ALL SELECT 'predicate_count', p, n FROM f
  UNION ALL SELECT 'predicate_percent', p, round(n * 100.0 / (SELECT sum(n) FROM f), 1) FROM f
  UNION ALL SELECT 'predicate_chart', p, n FROM (SELECT * FROM f ORDER BY n DESC, p LIMIT 10)
  UNION ALL SELECT 'predicate_chart', '(other)', sum(n) FROM (SELECT * FROM f ORDER BY n DESC, p OFFSET 10) HAVING count(*) > 0
  UNION ALL SELECT 'centrality', node, degree FROM (SELECT * FROM deg ORDER BY degree DESC, node LIMIT 10)
  UNION ALL SELECT 'ontology', 'classes', {len(set(c for e in SUBCLASS_OF for c in e))}
  UNION ALL SELECT 'ontology', CASE WHEN ob THEN 'object_properties' ELSE 'data_properties' END, count(*) FROM (SELECT p, count(rc) > 0 AS ob FROM prof GROUP BY p) GROUP BY 2)
SELECT section, key, round(value, 12) AS value FROM r""")
def g23(t):
    report = G.analysis_report(kg(t), induced_ontology(t))
    return report.withColumn("value", F.round("value", 12))
