"""F1-F11: scalar functions over whole tables."""

from pyspark.sql import functions as F

from kgspark.functions import scalars as S
from kgspark.operators import graph
from kgspark.plans.registry import query
from kgspark.plans.star import SQL_STAR, star_triples


def distinct_words(t):
    words = F.explode(F.split("text", "[ \n]")).alias("word")
    return t.documents.select(words).distinct()


_SQL_WORDS = (
    "WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \\n]')) AS word FROM documents)"
)


@query("F1_is_snake_case", _SQL_WORDS + r"""
SELECT word, word <> '' AND word NOT LIKE '\_%' ESCAPE '\' AND word NOT LIKE '%\_' ESCAPE '\'
  AND NOT contains(word, '__') AND regexp_full_match(word, '[\p{Ll}\p{Nd}_]+') AS snake
FROM w""")
def f1(t):
    return distinct_words(t).select("word", S.is_snake_case("word").alias("snake"))


@query("F2_starts_uppercase", _SQL_WORDS + """
SELECT word, lower(word[1]) <> word[1] AS upper_start FROM w""")
def f2(t):
    return distinct_words(t).select("word", S.starts_uppercase("word").alias("upper_start"))


@query("F3_sanitize_filename", r"""
SELECT page_id, lower(substr(trim(regexp_replace(regexp_replace(url, '[\\/*?:"<>|]', '_', 'g'), '\s+', '_', 'g'), '_'), 1, 100)) AS file_name
FROM pages""")
def f3(t):
    return t.pages.select("page_id", S.sanitize_filename("url").alias("file_name"))


@query("F4_word_count", "SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_words FROM documents")
def f4(t):
    return t.documents.select("doc_id", S.word_count("text").alias("n_words"))


@query("F5_triple_to_string", f"""WITH {SQL_STAR},
x AS (SELECT p, '(' || s || ', ' || p || ', ' || o || ')' AS txt FROM kg)
SELECT p AS predicate, count(*) AS n, min(txt) AS first_text, max(txt) AS last_text,
       CAST(sum(length(txt)) AS BIGINT) AS total_length FROM x GROUP BY p""")
def f5(t):
    text = star_triples(t).select("predicate", S.triple_to_string("subject", "predicate", "object").alias("txt"))
    return text.groupBy("predicate").agg(
        F.count(F.lit(1)).alias("n"), F.min("txt").alias("first_text"), F.max("txt").alias("last_text"),
        F.sum(F.length("txt")).alias("total_length"),
    )


@query("F6_issue_to_string", """
SELECT CASE WHEN c_acctbal < 0 THEN 'class:' ELSE 'relation:' END || c_name AS path,
  '[' || CASE WHEN c_acctbal < 0 THEN 'class:' ELSE 'relation:' END || c_name || '] checked'
  || CASE WHEN c_acctbal < 1000 THEN ' (context: ' || c_mktsegment || ')' ELSE '' END
  || CASE WHEN c_nationkey < 5 THEN '' ELSE ' (hint: nation ' || c_nationkey || ')' END AS issue
FROM customer""")
def f6(t):
    issues = t.customer.select(
        F.concat(F.when(F.col("c_acctbal") < 0, "class:").otherwise("relation:"), "c_name").alias("path"),
        F.lit("checked").alias("message"),
        F.when(F.col("c_acctbal") < 1000, F.col("c_mktsegment")).alias("context"),
        F.when(F.col("c_nationkey") < 5, "").otherwise(
            F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))
        ).alias("hint"),
    )
    return issues.select("path", S.issue_to_string("path", "message", "context", "hint").alias("issue"))


def order_groups(t):
    """Orders as groups with a priority: urgent and high, medium, everything else."""
    p = F.col("o_orderpriority")
    return t.orders.select(
        "o_orderkey",
        F.when(p.startswith("1") | p.startswith("2"), "high").when(p.startswith("3"), "medium")
        .otherwise("low").alias("priority"),
    )


SQL_ORDER_GROUPS = """grp AS (SELECT o_orderkey,
  CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'high' WHEN o_orderpriority[1] = '3' THEN 'medium' ELSE 'low' END AS priority,
  CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 3 WHEN o_orderpriority[1] = '3' THEN 2 ELSE 1 END AS quota
  FROM orders)"""


@query("F7_priority_to_n", f"""WITH {SQL_ORDER_GROUPS}
SELECT priority, CAST(quota AS INTEGER) AS quota, count(*) AS n FROM grp GROUP BY 1, 2""")
def f7(t):
    return order_groups(t).withColumn("quota", S.priority_to_n("priority")).groupBy("priority", "quota").agg(
        F.count(F.lit(1)).alias("n")
    )


_SQL_DEGREE = "deg AS (SELECT node, count(*) AS degree FROM (SELECT s AS node FROM kg UNION ALL SELECT o FROM kg) GROUP BY node)"


@query("F8_node_size", f"""WITH {SQL_STAR}, {_SQL_DEGREE}
SELECT degree, round(6 + least(degree / (SELECT max(degree) FROM deg) * 20.0, 20.0), 6) AS size, count(*) AS n_nodes
FROM deg GROUP BY degree""")
def f8(t):
    degrees = graph.degree(star_triples(t))
    per_degree = degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))
    top = degrees.agg(F.max("degree")).scalar()
    return per_degree.select("degree", F.round(S.node_size("degree", top), 6).alias("size"), "n_nodes")


@query("F9_edge_width", f"""WITH {SQL_STAR}, f AS (SELECT p, count(*) AS n FROM kg GROUP BY p)
SELECT p AS predicate, n, round(0.5 + n / (SELECT max(n) FROM f) * 3.0, 6) AS width FROM f""")
def f9(t):
    counts = star_triples(t).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("width", F.round(S.edge_width("n", counts.agg(F.max("n")).scalar()), 6))


@query("F10_confidence_width", """
SELECT l_discount, l_tax = 0 AS no_confidence, round(1 + 4 * CASE WHEN l_tax = 0 THEN 1.0 ELSE 1 - l_discount END, 6) AS width, count(*) AS n
FROM lineitem GROUP BY 1, 2, 3""")
def f10(t):
    confidence = F.when(F.col("l_tax") != 0, 1 - F.col("l_discount"))
    return t.lineitem.select(
        "l_discount", (F.col("l_tax") == 0).alias("no_confidence"),
        F.round(S.confidence_width(confidence), 6).alias("width"),
    ).groupBy("l_discount", "no_confidence", "width").agg(F.count(F.lit(1)).alias("n"))


@query("F11_percent_of_total", f"""WITH {SQL_STAR}, f AS (SELECT p, count(*) AS n FROM kg GROUP BY p)
SELECT p AS predicate, n, round(n * 100.0 / (SELECT sum(n) FROM f), 1) AS percent FROM f""")
def f11(t):
    counts = star_triples(t).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))
    return S.percent_of_total(counts, "n")
