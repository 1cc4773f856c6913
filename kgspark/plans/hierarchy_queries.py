"""H1-H7: components and repair of a hierarchy made of customers.

Every customer is a class below its segment and nation, that below its segment
and region: one cluster per segment and region, as deep and wide as the tables.
"""

from pyspark.sql import functions as F

from kgspark import schemas
from kgspark.operators import hierarchy as H
from kgspark.operators import ontology as O
from kgspark.plans.registry import n_rows, query
from kgspark.plans.star import make_ontology
from kgspark.storage import local_table

_SEGMENT = "initcap(c_mktsegment)"


def market_ontology(t):
    spark = t.spark
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    rows = t.customer.join(nations, "c_nationkey")
    low = rows.selectExpr(
        "concat('Customer', c_custkey) AS subclass", f"concat({_SEGMENT}, 'N', c_nationkey) AS superclass",
        "c_custkey AS seq",
    )
    high = rows.select("c_mktsegment", "c_nationkey", "region").distinct().selectExpr(
        f"concat({_SEGMENT}, 'N', c_nationkey) AS subclass", f"concat({_SEGMENT}, 'R', region) AS superclass",
        "cast(10000000000 as bigint) + c_nationkey * 10 + ascii(c_mktsegment) AS seq",
    )
    edges = t.scratch.save(low.unionByName(high), "edges")
    classes = edges.select(F.explode(F.array("subclass", "superclass")).alias("name")).distinct().selectExpr(
        "name", "cast(null as string) AS description", f"cast(null as {schemas.GUIDELINE}) AS usage_guideline",
        "xxhash64(name) AS seq",
    )
    # One data property per nation, on all its segments' classes and one unrelated class.
    per_nation = rows.groupBy("c_nationkey").agg(
        F.sort_array(F.collect_set(F.expr(f"concat({_SEGMENT}, 'N', c_nationkey)"))).alias("domain")
    )
    data = per_nation.selectExpr(
        "concat('hasTax', c_nationkey) AS name", "cast(null as string) AS description",
        "concat(domain, array('Stray')) AS domain", "'xsd:float' AS range",
        "cast(array() as array<string>) AS characteristics",
        f"cast(null as {schemas.GUIDELINE}) AS usage_guideline", "cast(c_nationkey as bigint) AS seq",
    )
    objects = make_ontology(spark, "o", [], [], [("ships", ["Stray"], ["Stray"])], []).object_properties
    return O.Ontology("markets", classes, edges, objects, data).pinned(t.scratch)


SQL_MARKETS = """r AS (SELECT *, upper(c_mktsegment[1]) || lower(substr(c_mktsegment, 2)) AS seg FROM customer JOIN nation ON n_nationkey = c_nationkey),
e AS (SELECT 'Customer' || c_custkey AS a, seg || 'N' || c_nationkey AS b, seg || 'R' || n_regionkey AS top FROM r
      UNION SELECT seg || 'N' || c_nationkey, seg || 'R' || n_regionkey, seg || 'R' || n_regionkey FROM r),
m AS (SELECT a AS c, top FROM e UNION SELECT b, top FROM e),
cl AS (SELECT top, count(*) AS size, min(c) AS least FROM m GROUP BY 1),
ix AS (SELECT top, size, least, CAST(row_number() OVER (ORDER BY size DESC, least) AS INTEGER) AS i FROM cl)"""


@query("H1_find_isolated_clusters", f"""WITH {SQL_MARKETS}
SELECT i AS cluster_index, size AS n_classes, least AS first_class, (SELECT count(*) FROM e WHERE e.top = ix.top) AS n_relations FROM ix""")
def h1(t):
    onto = market_ontology(t)
    clusters = H.find_isolated_clusters(onto, t.scratch)
    relations = H.cluster_relations(onto, clusters).groupBy("cluster_index").agg(
        F.count(F.lit(1)).alias("n_relations")
    )
    return clusters.groupBy("cluster_index").agg(
        F.count(F.lit(1)).alias("n_classes"), F.min("class_name").alias("first_class")
    ).join(relations, "cluster_index")


@query("H2_connected_components", r"""WITH RECURSIVE
l AS (SELECT DISTINCT 'page_' || page_id AS a, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS b FROM pages),
two AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(node, seen) AS (SELECT a, a FROM two UNION SELECT r.node, t.b FROM reach r JOIN two t ON t.a = r.seen)
SELECT node, min(seen) AS component FROM reach GROUP BY node""")
def h2(t):
    hrefs = F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("b")
    links = t.pages.select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("a"), hrefs)
    return H.connected_components(links, t.scratch)


def shape(scenario, onto):
    """Sizes of an ontology's tables, and of its domain lists, in one row."""
    count = F.count(F.lit(1))
    return onto.subclass_of.agg(count.alias("relations")).select(
        F.lit(scenario).alias("scenario"), "relations",
        onto.classes.agg(count).scalar().alias("classes"),
        onto.data_properties.agg(count).scalar().alias("data_properties"),
        onto.data_properties.agg(F.coalesce(F.sum(F.size("domain")), F.lit(0))).scalar().alias("domain_entries"),
        onto.object_properties.agg(count).scalar().alias("object_properties"),
    )


_SHAPE = """CAST({rel} AS BIGINT) AS relations, (SELECT count(DISTINCT c) FROM m) AS classes,
  {props} AS data_properties, {entries} AS domain_entries, CAST(0 AS BIGINT) AS object_properties"""


@query("H3_apply_merge_or_bridge", f"""WITH {SQL_MARKETS}
SELECT 'bridge' AS scenario, {_SHAPE.format(
    rel="(SELECT count(*) FROM e) + (SELECT count(*) - 1 FROM cl)",
    props="(SELECT count(DISTINCT c_nationkey) FROM r)",
    entries="(SELECT count(DISTINCT (c_nationkey, seg)) FROM r)")}""")
def h3(t):
    onto = market_ontology(t)
    clusters = H.find_isolated_clusters(onto, t.scratch)
    relations = H.auto_bridge(onto, clusters).select(F.explode("relations").alias("r"), "op_seq").select(
        "r.*", (F.lit(1 << 40) + F.col("op_seq")).alias("seq")
    )
    # Adding them twice must change nothing.
    return shape("bridge", H.apply_relations(onto, relations.unionByName(relations)))


@query("H4_apply_prune", f"""WITH {SQL_MARKETS}, gone AS (SELECT DISTINCT seg || 'N' || c_nationkey AS c FROM r WHERE n_regionkey = 2)
SELECT 'prune' AS scenario, {_SHAPE.format(
    rel="(SELECT count(*) FROM e WHERE a NOT IN (SELECT c FROM gone) AND b NOT IN (SELECT c FROM gone))",
    props="(SELECT count(DISTINCT c_nationkey) FROM r)",
    entries="(SELECT count(DISTINCT (c_nationkey, seg)) FROM r WHERE n_regionkey <> 2) + (SELECT count(DISTINCT c_nationkey) FROM r)"
).replace("CAST(0 AS BIGINT) AS object", "CAST(1 AS BIGINT) AS object")}""")
def h4(t):
    onto = market_ontology(t)
    nations = t.nation.where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    pruned = t.customer.join(nations, "c_nationkey").selectExpr(
        f"concat({_SEGMENT}, 'N', c_nationkey) AS class_name"
    ).distinct()
    return shape("prune", H.apply_prune(onto, pruned))


def scripted_ops(t, onto, clusters):
    """One operation of each kind, and faulty ones, on clusters 1 to 3."""
    tops = H.auto_bridge(onto, clusters)
    one = tops.where(F.element_at("indexes", 2) == 2).select(F.col("relations")[0].alias("r")).first()["r"]
    top1, top2 = one["superclass"], one["subclass"]
    ops = [
        (1, "merge", [1], [(top2, top1)], []),
        (2, "merge", [1, 2], [("Nowhere", top1)], []),
        (3, "merge", [1, 99999], [(top2, top1)], []),
        (4, "merge", [1, 2], [(top1, top1)], []),
        (5, "bridge", [1, 2], [(top1, "Joint"), (top2, "Joint")], []),
        (6, "prune", [1], [], ["Nowhere"]),
        (7, "prune", [1, 2], [], [top1]),
    ]
    return local_table(t.spark, [
        (seq, op, idx, [{"subclass": a, "superclass": b} for a, b in rel], cls) for seq, op, idx, rel, cls in ops
    ], schemas.OPS)


@query("H5_validate_op", f"""WITH {SQL_MARKETS}
SELECT * FROM (VALUES (1, 'merge', 'wrong_arity'), (2, 'merge', 'unknown_class'), (3, 'merge', 'unknown_cluster'),
  (4, 'merge', 'clusters_not_reduced'), (5, 'bridge', ''), (6, 'prune', 'unknown_class'), (7, 'prune', 'wrong_arity')) v(op_seq, op, error)
WHERE (SELECT count(*) FROM cl) > 1""")
def h5(t):
    onto = market_ontology(t)
    clusters = H.find_isolated_clusters(onto, t.scratch)
    _, history = H.fix_ontology(onto, t.scratch, scripted_ops(t, onto, clusters))
    return history.select("op_seq", "op", F.coalesce("error", F.lit("")).alias("error"))


@query("H6_fix_ontology", f"""WITH {SQL_MARKETS}
SELECT 'fixed' AS scenario, {_SHAPE.format(
    rel="(SELECT count(*) FROM e) + (SELECT count(*) - 1 FROM cl)",
    props="(SELECT count(DISTINCT c_nationkey) FROM r)",
    entries="(SELECT count(DISTINCT (c_nationkey, seg)) FROM r)")},
  (SELECT count(*) - 1 FROM cl) AS operations, CAST(0 AS BIGINT) AS clusters_left""")
def h6(t):
    fixed, history = H.fix_ontology(market_ontology(t), t.scratch)
    left = H.find_isolated_clusters(fixed, t.scratch)
    return shape("fixed", fixed).select(
        "*", history.agg(F.count(F.lit(1))).scalar().alias("operations"),
        left.select("cluster_index").distinct().agg(F.count(F.lit(1))).scalar().alias("clusters_left"),
    )


def market_operations(t):
    """An operation per customer, then a prune of each whole segment.

    A customer's merge puts it below its segment's class of the next region, so the
    first customers of four regions join their clusters and all others change nothing.
    """
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    rows = t.customer.join(nations, "c_nationkey")
    merges = rows.selectExpr(
        "cast(c_custkey as int) AS op_seq", "'merge' AS op", "array(1, 2) AS indexes",
        f"array(named_struct('subclass', concat('Customer', c_custkey), "
        f"'superclass', concat({_SEGMENT}, 'R', (region + 1) % 5))) AS relations",
        "cast(array() as array<string>) AS classes",
    )
    prunes = rows.groupBy("c_mktsegment").agg(F.sort_array(F.collect_set(
        F.expr(f"concat({_SEGMENT}, 'N', c_nationkey)")
    )).alias("low"), F.sort_array(F.collect_set(F.expr(f"concat({_SEGMENT}, 'R', region)"))).alias("high")).selectExpr(
        "cast(2000000000 + ascii(c_mktsegment) as int) AS op_seq", "'prune' AS op", "array(1) AS indexes",
        f"cast(array() as {schemas.OPS.split('relations ')[1].rsplit(', classes', 1)[0]}) AS relations",
        "concat(low, high) AS classes",
    )
    return t.scratch.save(merges.unionByName(prunes), "operations")


@query("H6_replay_operations", f"""WITH {SQL_MARKETS},
firsts AS (SELECT seg, n_regionkey, min(c_custkey) AS k FROM r GROUP BY 1, 2),
ranked AS (SELECT k, row_number() OVER (PARTITION BY seg ORDER BY k) AS i, count(*) OVER (PARTITION BY seg) AS n FROM firsts),
joined AS (SELECT k FROM ranked WHERE i < 5),
ends AS (SELECT c_mktsegment, row_number() OVER (ORDER BY ascii(c_mktsegment)) AS i FROM customer GROUP BY 1)
SELECT CAST(c_custkey AS INTEGER) AS op_seq, 'merge' AS op,
  CASE WHEN c_custkey IN (SELECT k FROM joined) THEN '' ELSE 'clusters_not_reduced' END AS error FROM customer
UNION ALL
SELECT CAST(2000000000 + ascii(c_mktsegment) AS INTEGER), 'prune', '' FROM ends WHERE i < (SELECT max(i) FROM ends)""")
def h6_replay(t):
    _, history = H.fix_ontology(market_ontology(t), t.scratch, market_operations(t))
    return history.select("op_seq", "op", F.coalesce("error", F.lit("")).alias("error"))


@query("H7_auto_bridge", f"""WITH {SQL_MARKETS}
SELECT CAST((SELECT max(i) FROM ix) - i AS INTEGER) AS op_seq, 'bridge' AS op, '1,' || i AS indexes,
  top AS subclass, (SELECT top FROM ix WHERE i = 1) AS superclass FROM ix WHERE i > 1""")
def h7(t):
    onto = market_ontology(t)
    clusters = H.find_isolated_clusters(onto, t.scratch)
    return H.auto_bridge(onto, clusters).select(
        "op_seq", "op", F.array_join(F.transform("indexes", lambda i: i.cast("string")), ",").alias("indexes"),
        F.col("relations")[0]["subclass"].alias("subclass"), F.col("relations")[0]["superclass"].alias("superclass"),
    )
