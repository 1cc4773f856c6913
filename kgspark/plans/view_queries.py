"""V1-V6: node and edge tables."""

from pyspark.sql import functions as F

from kgspark.operators import views as V
from kgspark.operators.triples import accumulate_first
from kgspark.plans.graph_queries import SQL_DEG, SQL_TYPES, kg
from kgspark.plans.ontology_queries import SQL_PROFILE, induced_ontology
from kgspark.plans.registry import n_rows, query
from kgspark.plans.star import SQL_ONTOLOGY, SQL_STAR, star_triples


SQL_INDUCED = f"""{SQL_ONTOLOGY}, {SQL_PROFILE},
ob AS (SELECT DISTINCT p, dc, rc FROM prof WHERE rc IS NOT NULL),
da AS (SELECT DISTINCT p, dc FROM prof WHERE p NOT IN (SELECT p FROM ob))"""


@query("V1_ontology_graph_nodes", f"""WITH {SQL_STAR}, {SQL_INDUCED}
SELECT c AS node, 'class' AS kind FROM cls UNION ALL SELECT 'xsd:string', 'datatype' FROM da HAVING count(*) > 0""")
def v1_nodes(t):
    return V.ontology_graph(induced_ontology(t))[0]


@query("V1_ontology_graph_edges", f"""WITH {SQL_STAR}, {SQL_INDUCED}
SELECT a AS source, 'isA' AS label, b AS target, FALSE AS dangling FROM sub
UNION ALL SELECT dc, p, rc, dc NOT IN (SELECT c FROM cls) OR rc NOT IN (SELECT c FROM cls) FROM ob
UNION ALL SELECT dc, p, 'xsd:string', dc NOT IN (SELECT c FROM cls) FROM da""")
def v1_edges(t):
    return V.ontology_graph(induced_ontology(t))[1]


@query("V2_ontology_graph_simple", f"""WITH {SQL_STAR}, {SQL_INDUCED}
SELECT 'edge' AS part, a AS source, 'subClassOf' AS label, b AS target FROM sub
UNION ALL SELECT 'edge', dc, p, rc FROM ob UNION ALL SELECT 'edge', dc, p, 'datatype: xsd:string' FROM da
UNION ALL SELECT 'node', c, 'class', '' FROM (SELECT a AS c FROM sub UNION SELECT b FROM sub UNION SELECT dc FROM ob UNION SELECT rc FROM ob UNION SELECT dc FROM da)
UNION ALL SELECT 'node', 'datatype: xsd:string', 'datatype', '' FROM da HAVING count(*) > 0""")
def v2(t):
    nodes, edges = V.ontology_graph_simple(induced_ontology(t))
    return edges.select(F.lit("edge").alias("part"), "source", "label", "target").unionByName(nodes.select(
        F.lit("node").alias("part"), F.col("node").alias("source"), F.col("kind").alias("label"), F.lit("").alias("target")
    ))


_DRAWN = "kg0 AS (SELECT * FROM kg WHERE lower(p) <> 'isa')"


@query("V3_kg_graph_nodes", f"""WITH {SQL_STAR}, {SQL_TYPES}, {_DRAWN}, {SQL_DEG.replace('FROM kg', 'FROM kg0')}
SELECT node, degree, round(6 + least(degree / (SELECT max(degree) FROM deg) * 20.0, 20.0), 6) AS size, coalesce(grp, 'unclassified') AS "group"
FROM deg LEFT JOIN ty USING (node)""")
def v3_nodes(t):
    nodes, _ = V.kg_graph(kg(t), with_ontology=True)
    return nodes.withColumn("size", F.round("size", 6))


@query("V3_kg_graph_edges", f"""WITH {SQL_STAR}, f AS (SELECT p, count(*) AS n FROM kg GROUP BY p)
SELECT p AS label, round(0.5 + f.n / (SELECT max(n) FROM f) * 3.0, 6) AS width, count(*) AS n, min(s) AS first_source, max(o) AS last_target
FROM kg JOIN f USING (p) GROUP BY 1, 2""")
def v3_edges(t):
    _, edges = V.kg_graph(kg(t))
    return edges.groupBy("label", F.round("width", 6).alias("width")).agg(
        n_rows(), F.min("source").alias("first_source"), F.max("target").alias("last_target")
    )


@query("V4_kg_graph_simple", """
WITH e AS (SELECT 'order_' || l_orderkey AS s, 'part_' || l_partkey AS o, round(1 + 4 * CASE WHEN l_tax = 0 THEN 1.0 ELSE 1 - l_discount END, 6) AS width FROM lineitem),
n AS (SELECT s AS node FROM e UNION SELECT o FROM e)
SELECT width, count(*) AS n, min(s) AS first_source, max(o) AS last_target, (SELECT count(*) FROM n) AS nodes FROM e GROUP BY 1""")
def v4(t):
    triples = t.lineitem.selectExpr(
        "concat('order_', l_orderkey) AS subject", "'containsPart' AS predicate", "concat('part_', l_partkey) AS object",
        "if(l_tax = 0, null, 1 - l_discount) AS confidence",
    )
    nodes, edges = V.kg_graph_simple(triples)
    total = nodes.agg(F.count(F.lit(1))).scalar()
    return edges.groupBy(F.round("width", 6).alias("width")).agg(
        n_rows(), F.min("source").alias("first_source"), F.max("target").alias("last_target")
    ).withColumn("nodes", total)


SQL_COMBINED = f"""{SQL_INDUCED}, {SQL_TYPES.replace('ty AS', 'gt AS', 1)},
ce AS (
  SELECT a AS source, 'isA' AS label, b AS target, 'subclass' AS origin FROM sub
  UNION ALL SELECT DISTINCT dc, 'hasDomain', p, 'object_domain' FROM ob UNION ALL SELECT DISTINCT p, 'hasRange', rc, 'object_range' FROM ob
  UNION ALL SELECT dc, 'hasDomain', p, 'data_domain' FROM da UNION ALL SELECT DISTINCT p, 'hasRange', 'xsd:string', 'data_range' FROM da
  UNION ALL SELECT s, p, o, 'instance' FROM kg WHERE p <> 'isA'),
cn AS (SELECT node, min(k) AS k FROM (
    SELECT unnest([a, b]) AS node, '1class' AS k FROM sub UNION ALL SELECT p, '2property' FROM ob UNION ALL SELECT p, '2property' FROM da
    UNION ALL SELECT unnest([dc, rc]), '3class' FROM ob UNION ALL SELECT dc, '3class' FROM da UNION ALL SELECT 'xsd:string', '4datatype' FROM da
    UNION ALL SELECT unnest([s, o]), '5instance' FROM kg WHERE p <> 'isA') GROUP BY 1)"""


@query("V5_combined_graph_nodes", f"""WITH {SQL_STAR}, {SQL_COMBINED}
SELECT node, substr(k, 2) AS kind, CASE WHEN k = '5instance' THEN coalesce(grp, 'instance') ELSE 'ontology_' || substr(k, 2) END AS "group" FROM cn LEFT JOIN gt USING (node)""")
def v5_nodes(t):
    return V.combined_graph(induced_ontology(t), kg(t))[0]


@query("V5_combined_graph_edges", f"""WITH {SQL_STAR}, {SQL_COMBINED},
al AS (SELECT * FROM ce UNION ALL SELECT DISTINCT s, 'isA', o, 'type' FROM kg WHERE p = 'isA' AND s IN (SELECT node FROM cn) AND o IN (SELECT node FROM cn))
SELECT origin, label, count(*) AS n, min(source) AS first_source, max(target) AS last_target FROM al GROUP BY 1, 2""")
def v5_edges(t):
    _, edges = V.combined_graph(induced_ontology(t), kg(t))
    return edges.groupBy("origin", "label").agg(
        n_rows(), F.min("source").alias("first_source"), F.max("target").alias("last_target")
    )


@query("V6_node_ids", f"""WITH {SQL_STAR}, d AS (SELECT s, p, o, min((b, q)) AS at_place FROM kg GROUP BY 1, 2, 3),
x AS (SELECT s AS node, (at_place[1], at_place[2], 0) AS f FROM d UNION ALL SELECT o, (at_place[1], at_place[2], 1) FROM d),
y AS (SELECT node, min(f) AS f FROM x GROUP BY node)
SELECT node, row_number() OVER (ORDER BY f, node) AS id FROM y""")
def v6(t):
    first = V.first_seen(accumulate_first(star_triples(t)))
    return V.node_ids(first, t.scratch, dense=True)
