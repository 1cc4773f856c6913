"""SRC1-SRC6, SNK1-SNK7: files that Spark writes from the tables, read back."""

import gzip
from dataclasses import replace

from pyspark.sql import functions as F

from kgspark import schemas
from kgspark.operators import hierarchy as H
from kgspark.operators import text as X
from kgspark.operators.ontology import all_properties, class_names
from kgspark.plans.hierarchy_queries import SQL_MARKETS, market_ontology
from kgspark.plans.ontology_queries import SQL_CLEAN, part_ontology
from kgspark.plans.question_queries import questions
from kgspark.plans.registry import n_rows, query
from kgspark.plans.star import (
    SQL_RAW, SQL_STAR, dimension_triples, line_triples, make_ontology, order_triples, raw_triples, star_triples,
)
from kgspark.skew import dense_index
from kgspark.sources import files as S


@query("SRC1_scan_text_files", """
SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars, CAST(0 AS BIGINT) AS skipped FROM documents GROUP BY 1""")
def src1(t):
    path = t.scratch.new_path("texts")
    t.documents.select("lang", "text").write.partitionBy("lang").text(path)
    documents, skipped = S.scan_text_files(t.spark, path)
    lang = F.regexp_extract("path", "lang=([^/]*)", 1)
    n_skipped = skipped.agg(F.count(F.lit(1))).scalar()
    return documents.groupBy(lang.alias("lang")).agg(F.sum(F.length("text")).alias("n_chars")).withColumn(
        "skipped", n_skipped
    )


@query("SRC1_decode_files", """
SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars, CAST(0 AS BIGINT) AS problems FROM documents GROUP BY 1""")
def src1_decode(t):
    path = t.scratch.new_path("packed")
    t.documents.select("lang", "text").write.partitionBy("lang").option("compression", "gzip").text(path)
    found = S.decode_files(t.spark, path, t.scratch, {".gz": lambda content: gzip.decompress(content).decode()})
    return found.groupBy(F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang")).agg(
        F.sum(F.length("text")).alias("n_chars"), F.count("problem").alias("problems")
    )


@query("SRC2_drop_empty_docs", """
SELECT count(*) AS n, count(*) FILTER (trim(line) = '') AS blank FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''""")
def src2(t):
    lines = t.documents.select(F.explode(F.split("text", "\n", -1)).alias("text"))
    return X.drop_empty(lines).agg(n_rows(), F.count_if(F.trim("text") == "").alias("blank"))


@query("SRC3_read_ontology", f"""WITH {SQL_CLEAN}
SELECT 'class' AS kind, name, CAST(row_number() OVER (ORDER BY q) - 1 AS BIGINT) AS seq FROM ocls
UNION ALL SELECT 'property', 'has' || name, CAST(row_number() OVER (ORDER BY q) - 1 AS BIGINT) FROM br""")
def src3(t):
    path = t.scratch.new_path("ontology")
    S.write_ontology(part_ontology(t), path)
    onto, _ = S.read_ontology(t.spark, path, lines=True)
    # Places count up with the order of the lines.
    rows = [
        dense_index(table.select("name", F.col("seq").alias("at")), [F.asc("at")], "seq", t.scratch).select(
            F.lit(kind).alias("kind"), "name", "seq"
        )
        for kind, table in (("class", onto.classes), ("property", onto.data_properties))
    ]
    return rows[0].unionByName(rows[1])


@query("SRC4_read_kg", f"""WITH {SQL_STAR}
SELECT p AS predicate, count(*) AS n, min(s) AS first_subject, max(o) AS last_object FROM (SELECT DISTINCT s, p, o FROM kg) GROUP BY 1""")
def src4(t):
    path = t.scratch.new_path("kg")
    S.write_kg_lines(t.scratch.save(star_triples(t)), "star", path)
    triples, _ = S.read_kg(t.spark, path, lines=True)
    return triples.groupBy("predicate").agg(
        n_rows(), F.min("subject").alias("first_subject"), F.max("object").alias("last_object")
    )


SQL_LINES = """q AS (SELECT DISTINCT text FROM conversations WHERE role = 'user'),
l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM q)"""


@query("SRC5_read_lines", f"""WITH {SQL_LINES}
SELECT md5(line) AS digest, count(*) AS n FROM l GROUP BY 1""")
def src5(t):
    path = t.scratch.new_path("lines")
    # Any number of files: each ends with a line break, and the row after it is marked.
    questions(t).write.text(path)
    return S.read_lines(t.spark, path).where("not after_end").groupBy(F.md5("line").alias("digest")).agg(n_rows())


@query("SRC6_resume_stage", """
SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS key_sum, TRUE AS second_run_reused FROM orders GROUP BY 1""")
def src6(t):
    root = t.scratch.new_path("stages")
    key = S.input_fingerprint(t.orders)

    def compute():
        return t.orders.groupBy("o_orderstatus").agg(n_rows(), F.sum("o_custkey").alias("key_sum"))

    _, first = S.stage(t.spark, root, "status", key, compute)
    table, second = S.stage(t.spark, root, "status", key, compute)
    return table.withColumn("second_run_reused", F.lit(second and not first))


@query("SNK1_write_ontology", f"""WITH {SQL_CLEAN}
SELECT lower(name) AS name_key, min(q) > -1 AS found, FALSE AS is_property FROM ocls GROUP BY 1
UNION ALL SELECT 'has' || name, TRUE, TRUE FROM br""")
def snk1(t):
    path = t.scratch.new_path("ontology")
    S.write_ontology(part_ontology(t), path)
    back, _ = S.read_ontology(t.spark, path, lines=True)
    return class_names(back).select("name_key", F.lit(True).alias("found"), F.lit(False).alias("is_property")).unionByName(
        all_properties(back).select(F.col("name").alias("name_key"), F.lit(True).alias("found"), F.lit(True).alias("is_property"))
    )


@query("SNK1_write_ontology_document", """
SELECT 'class' AS kind, count(*) AS n, min('part_' || p_partkey) AS first_name, count(DISTINCT p_name) AS n_texts FROM part
UNION ALL SELECT 'relation', count(*), min('part_' || p_partkey), count(DISTINCT p_brand) FROM part
UNION ALL SELECT 'document', 1, 'parts', 0""")
def snk1_document(t):
    """A class per part, written as one document of any size and read back."""
    rows = t.part.selectExpr("concat('part_', p_partkey) AS name", "p_name", "p_brand", "p_partkey AS seq")
    empty = make_ontology(t.spark, "parts", [], [], [], [])
    onto = replace(
        empty,
        classes=rows.selectExpr("name", "p_name AS description", f"cast(null as {schemas.GUIDELINE}) AS usage_guideline", "seq"),
        subclass_of=rows.selectExpr("name AS subclass", "p_brand AS superclass", "seq"),
    )
    path = t.scratch.new_path("document")
    S.write_ontology_document(onto, path)
    back, _ = S.read_ontology(t.spark, path)

    def told(table, kind, name, text):
        return table.agg(n_rows(), F.min(name).alias("first_name"), F.countDistinct(text).alias("n_texts")).withColumn("kind", F.lit(kind))

    documents = t.spark.read.text(path, wholetext=True).agg(n_rows()).select(
        "n", F.lit(back.name).alias("first_name"), F.lit(0).cast("long").alias("n_texts"), F.lit("document").alias("kind")
    )
    return told(back.classes, "class", "name", "description").unionByName(
        told(back.subclass_of, "relation", "subclass", "superclass")
    ).unionByName(documents).select("kind", "n", "first_name", "n_texts")


@query("SNK2_write_kg", f"""WITH {SQL_STAR}
SELECT 'star' AS kg_name, p AS predicate, count(*) AS n, CAST(sum(q) AS BIGINT) AS seq_sum FROM kg GROUP BY 2""")
def snk2(t):
    path = t.scratch.new_path("kg")
    S.write_kg(star_triples(t), "star", path)
    return t.spark.read.parquet(path).groupBy("kg_name", "predicate").agg(n_rows(), F.sum("seq").alias("seq_sum"))


@query("SNK3_write_partial", f"""WITH {SQL_STAR}
SELECT CASE WHEN b < 4 THEN 0 WHEN p IN ('containsPart', 'shippedBy') THEN 2 ELSE 1 END AS epoch, count(*) AS n FROM kg GROUP BY 1""")
def snk3(t):
    path = t.scratch.new_path("partial")
    for epoch, part in enumerate((dimension_triples(t), order_triples(t), line_triples(t))):
        S.write_partial(part, epoch, path)
    S.write_partial(order_triples(t), 1, path)  # written again, as after a failure
    return t.spark.read.parquet(path).groupBy("epoch").agg(n_rows())


SQL_DIGRAPH = "e AS (SELECT s, o, arg_max(p, (b, q, p)) AS label FROM kg GROUP BY 1, 2), v AS (SELECT s AS node FROM e UNION SELECT o FROM e)"


@query("SNK4_write_graph_stats", f"""WITH {SQL_RAW}, {SQL_DIGRAPH}
SELECT (SELECT count(*) FROM v) AS nodes_count, (SELECT count(*) FROM e) AS edges_count, label, count(*) AS n FROM e GROUP BY label""")
def snk4(t):
    path = t.scratch.new_path("stats")
    S.write_graph_stats(t.scratch.save(raw_triples(t)), path)
    counts = t.spark.read.schema("nodes_count long, edges_count long").json(f"{path}/counts")
    edges = t.spark.read.schema("source string, target string, label string").json(f"{path}/edges")
    return edges.groupBy("label").agg(n_rows()).select(
        counts.select("nodes_count").scalar().alias("nodes_count"),
        counts.select("edges_count").scalar().alias("edges_count"), "label", "n",
    )


@query("SNK5_write_node_link", f"""WITH {SQL_RAW}, {SQL_DIGRAPH}
SELECT 'node' AS part, '' AS label, count(*) AS n, min(node) AS first_id, TRUE AS directed FROM v
UNION ALL SELECT 'link', label, count(*), min(s), TRUE FROM e GROUP BY label""")
def snk5(t):
    path = t.scratch.new_path("node_link")
    S.write_node_link(t.scratch.save(raw_triples(t)), path)
    head = t.spark.read.schema("directed boolean, multigraph boolean").json(f"{path}/head")
    nodes = t.spark.read.schema("id string").json(f"{path}/nodes")
    links = t.spark.read.schema("source string, target string, label string").json(f"{path}/links")
    rows = nodes.agg(n_rows(), F.min("id").alias("first_id")).select(
        F.lit("node").alias("part"), F.lit("").alias("label"), "n", "first_id"
    ).unionByName(links.groupBy("label").agg(n_rows(), F.min("source").alias("first_id")).select(
        F.lit("link").alias("part"), "label", "n", "first_id"
    ))
    return rows.withColumn("directed", head.select("directed").scalar())


@query("SNK6_write_op_history", f"""WITH {SQL_MARKETS}
SELECT op, n, (SELECT count(*) FROM e) AS original_relations, (SELECT count(DISTINCT c) FROM m) AS original_classes
FROM (SELECT 'bridge' AS op, count(*) AS n FROM ix WHERE i > 1)""")
def snk6(t):
    path = t.scratch.new_path("history")
    onto = market_ontology(t)
    clusters = H.find_isolated_clusters(onto, t.scratch)
    _, history = H.fix_ontology(onto, t.scratch)
    S.write_op_history(onto, H.cluster_relations(onto, clusters), history, path)
    back = t.spark.read.parquet(f"{path}/history")
    relations = t.spark.read.parquet(f"{path}/original_clusters").agg(F.count(F.lit(1))).scalar()
    classes = t.spark.read.parquet(f"{path}/original_ontology/classes").agg(F.count(F.lit(1))).scalar()
    return back.groupBy("op").agg(n_rows()).select(
        "op", "n", relations.alias("original_relations"), classes.alias("original_classes")
    )


@query("SNK7_write_lines", """
WITH q AS (SELECT DISTINCT replace(text, chr(10), ' ') AS text FROM conversations WHERE role = 'user')
SELECT md5(text) AS digest, count(*) AS n FROM q GROUP BY 1""")
def snk7(t):
    path = t.scratch.new_path("questions")
    flat = questions(t).select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")).distinct()
    S.write_lines(flat, "text", path, [F.asc("text")])
    return t.spark.read.text(path).groupBy(F.md5("value").alias("digest")).agg(n_rows())
