"""T1-T15: triple tables and their validation."""

from pyspark.sql import functions as F

from kgspark.operators import triples as T
from kgspark.operators.ontology import all_properties, induced_properties, superclass_sets
from kgspark.plans.registry import n_rows, query
from kgspark.plans.star import (
    SQL_ONTOLOGY, SQL_PRIOR, SQL_RAW, SQL_STAR, dimension_triples, line_triples, order_triples,
    prior_triples, raw_triples, star_ontology, star_triples,
)
from kgspark.sources import mapping as M


def sql_judge(prior: bool) -> str:
    """Row-by-row verdicts in SQL: relation ``v`` (s, p, o, b, q, code)."""
    new = "SELECT * FROM kg" + (
        " WHERE NOT EXISTS (SELECT 1 FROM prior x WHERE x.s = kg.s AND x.p = kg.p AND x.o = kg.o)" if prior else ""
    )
    given = (
        "SELECT s, arg_min(o, q) AS cl FROM prior WHERE p = 'isA' GROUP BY s" if prior
        else "SELECT '' AS s, '' AS cl WHERE FALSE"
    )
    snake = "regexp_full_match({}, '[a-z0-9]+(_[a-z0-9]+)*')"
    return f"""{SQL_ONTOLOGY},
low AS (SELECT DISTINCT lower(c) AS c FROM cls),
j AS MATERIALIZED (SELECT k.*, lower(k.o) IN (SELECT c FROM low) AS oc, lower(k.s) IN (SELECT c FROM low) AS sc FROM ({new}) k),
d AS (SELECT s, min((b, q, o)) AS d FROM j WHERE p = 'isA' AND oc AND NOT sc GROUP BY s),
g AS ({given}),
t AS MATERIALIZED (SELECT coalesce(d.s, g.s) AS s, CASE WHEN g.s IS NULL THEN d.d[1] ELSE -99 END AS b,
  CASE WHEN g.s IS NULL THEN d.d[2] ELSE -1 END AS q, coalesce(g.cl, d.d[3]) AS cl FROM d FULL JOIN g ON d.s = g.s),
ups AS (SELECT c, list(up) AS u FROM sup GROUP BY c),
v AS MATERIALIZED (
  SELECT j.s, j.p, j.o, j.b, j.q, CASE
    WHEN (j.b, j.q) = (t.b, t.q) THEN NULL
    WHEN (j.b, j.q) > (t.b, t.q) THEN CASE
      WHEN list_contains(ups.u, t.cl) OR (j.o = t.cl AND j.b > t.b) THEN NULL
      WHEN NOT {snake.format('j.s')} THEN 'isa_not_snake_case' ELSE 'isa_reclassified' END
    WHEN NOT oc THEN 'isa_unknown_class' WHEN sc THEN 'isa_subject_is_class' END AS code
  FROM j LEFT JOIN t ON t.s = j.s LEFT JOIN ups ON ups.c = j.o WHERE j.p = 'isA'
  UNION ALL
  SELECT j.s, j.p, j.o, j.b, j.q, CASE
    WHEN prop.name IS NULL THEN 'unknown_property' WHEN ts.cl IS NULL THEN 'subject_untyped'
    WHEN sc THEN 'subject_is_class' WHEN oc THEN 'object_is_class'
    WHEN NOT {snake.format('j.s')} THEN 'subject_not_snake_case'
    WHEN kind = 'object' THEN CASE
      WHEN ot.cl IS NULL THEN 'object_untyped'
      WHEN NOT coalesce(list_has_any(us.u, dom) AND list_has_any(uo.u, rng), FALSE) THEN 'domain_range_mismatch'
      WHEN NOT {snake.format('j.o')} THEN 'object_not_snake_case' END END
  FROM j LEFT JOIN prop ON prop.name = j.p
  LEFT JOIN t ts ON ts.s = j.s AND ts.b <= j.b LEFT JOIN ups us ON us.c = ts.cl
  LEFT JOIN t ot ON ot.s = j.o AND ot.b <= j.b LEFT JOIN ups uo ON uo.c = ot.cl
  WHERE j.p <> 'isA')"""


def judged_raw(t, prior=True):
    given = prior_triples(t) if prior else None
    return T.validate(raw_triples(t), star_ontology(t.spark), t.scratch, given)


@query("T1_new_triples", f"""WITH {SQL_RAW}, {SQL_PRIOR}
SELECT p AS predicate, count(*) AS n, CAST(sum(q) AS BIGINT) AS seq_sum FROM kg
WHERE NOT EXISTS (SELECT 1 FROM prior x WHERE x.s = kg.s AND x.p = kg.p AND x.o = kg.o) GROUP BY 1""")
def t1(t):
    fresh = T.new_triples(raw_triples(t), prior_triples(t))
    return fresh.groupBy("predicate").agg(n_rows(), F.sum("seq").alias("seq_sum"))


@query("T2_entity_types", f"""WITH {SQL_RAW}, {sql_judge(False)},
ty AS (SELECT s, arg_min(o, (b, q)) AS cl FROM v WHERE p = 'isA' AND code IS NULL GROUP BY s)
SELECT cl AS class_name, count(*) AS n, min(s) AS first_entity, max(s) AS last_entity FROM ty GROUP BY 1""")
def t2(t):
    types = T.entity_types(T.accepted(judged_raw(t, prior=False)))
    return types.groupBy("class_name").agg(
        n_rows(), F.min("subject").alias("first_entity"), F.max("subject").alias("last_entity")
    )


@query("T3_validate_isa", f"""WITH {SQL_RAW}, {SQL_PRIOR}, {sql_judge(True)}
SELECT code AS error_code, count(*) AS n, CAST(sum(q) AS BIGINT) AS seq_sum FROM v WHERE p = 'isA' GROUP BY 1""")
def t3(t):
    isa = judged_raw(t).where("predicate = 'isA'")
    return isa.groupBy("error_code").agg(n_rows(), F.sum("seq").alias("seq_sum"))


@query("T4_validate_property", f"""WITH {SQL_RAW}, {SQL_PRIOR}, {sql_judge(True)}
SELECT code AS error_code, p AS predicate, count(*) AS n, CAST(sum(q) AS BIGINT) AS seq_sum FROM v WHERE p <> 'isA' GROUP BY 1, 2""")
def t4(t):
    facts = judged_raw(t).where("predicate != 'isA'")
    return facts.groupBy("error_code", "predicate").agg(n_rows(), F.sum("seq").alias("seq_sum"))


@query("T5_is_valid_for", f"""WITH {SQL_STAR}, {SQL_ONTOLOGY},
ty AS (SELECT s, o AS cl FROM kg WHERE p = 'isA'), ups AS (SELECT c, list(up) AS u FROM sup GROUP BY c)
SELECT p AS predicate, a.cl AS subject_class, b.cl AS object_class,
  list_has_any(ua.u, dom) AND list_has_any(ub.u, rng) AS fits, count(*) AS n
FROM kg JOIN prop ON name = p AND kind = 'object' JOIN ty a ON a.s = kg.s JOIN ty b ON b.s = kg.o
JOIN ups ua ON ua.c = a.cl JOIN ups ub ON ub.c = b.cl GROUP BY ALL""")
def t5(t):
    kg, onto = star_triples(t), star_ontology(t.spark)
    # The rule depends on classes only: profile the graph first, then test pairs.
    types = t.scratch.save(T.entity_types(kg), "types")
    supers = superclass_sets(onto)
    profile = induced_properties(kg, types, t.scratch, distinct=False).where("range_class is not null")
    judged = (
        profile.join(all_properties(onto).where("kind = 'object'").withColumnRenamed("name", "predicate"), "predicate")
        .join(supers.select(F.col("class_name").alias("domain_class"), F.col("supers").alias("ss")), "domain_class")
        .join(supers.select(F.col("class_name").alias("range_class"), F.col("supers").alias("os")), "range_class")
    )
    return judged.select(
        "predicate", F.col("domain_class").alias("subject_class"), F.col("range_class").alias("object_class"),
        T.is_valid_for(F.col("ss"), F.col("os"), F.col("domain"), F.col("range")).alias("fits"),
        F.col("n_triples").alias("n"),
    )


@query("T6_validation_report", f"""WITH {SQL_RAW}, {SQL_PRIOR}, {sql_judge(True)}
SELECT b AS batch_id, count(*) AS n_rows, count(code) AS n_errors,
  coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS codes, count(code) = 0 AS valid FROM v GROUP BY 1""")
def t6(t):
    return T.validation_report(judged_raw(t))


# Batches of orders come in chains of four, each order following the one before.
SQL_ACCEPTED = f"""{SQL_RAW}, {sql_judge(False)},
own AS (SELECT b, bool_or(code IS NOT NULL AND NOT (p = 'followsOrder' AND code IN ('object_untyped', 'domain_range_mismatch'))) AS bad FROM v GROUP BY b),
acc AS (SELECT b, CASE WHEN b < 4 THEN NOT bad ELSE
  NOT EXISTS (SELECT 1 FROM own x WHERE x.b BETWEEN own.b - (own.b - 4) % 4 AND own.b AND x.bad AND x.b >= 4) END AS accepted FROM own)"""


@query("T7_accept_batches", f"""WITH {SQL_ACCEPTED}
SELECT accepted, count(*) AS n, CAST(sum(b) AS BIGINT) AS batch_sum FROM acc GROUP BY 1""")
def t7(t):
    raw = t.scratch.save(raw_triples(t), "raw")
    _, batches = T.accept_batches(raw, star_ontology(t.spark), t.scratch)
    return batches.groupBy("accepted").agg(n_rows(), F.sum("batch_id").alias("batch_sum"))


@query("T8_no_ontology_mode", f"""WITH {SQL_RAW}
SELECT p AS predicate, count(*) AS n, CAST(0 AS BIGINT) AS n_errors FROM kg GROUP BY 1""")
def t8(t):
    judged = T.validate(raw_triples(t), None, t.scratch)
    return judged.groupBy("predicate").agg(n_rows(), F.count("error_code").alias("n_errors"))


@query("T9_accumulate", f"""WITH {SQL_RAW}, {SQL_PRIOR}
SELECT p AS predicate, count(*) AS n, min(o) AS first_object, max(o) AS last_object
FROM (SELECT s, p, o FROM kg UNION SELECT s, p, o FROM prior) GROUP BY 1""")
def t9(t):
    kg = T.accumulate(raw_triples(t), prior_triples(t))
    return kg.groupBy("predicate").agg(
        n_rows(), F.min("object").alias("first_object"), F.max("object").alias("last_object")
    )


def epochs(t):
    """Passes that see one more table each, until a pass finds nothing new."""
    steps = [dimension_triples, order_triples, line_triples]

    def extract(kg, epoch):
        seen = [step(t) for step in steps[: epoch + 1]]
        return M.triples_from_tables(seen)

    empty = dimension_triples(t).where(F.lit(False))
    return T.run_epochs(extract, empty, star_ontology(t.spark), t.scratch, epochs=5)


@query("T10_epochs_early_stop", f"""WITH {SQL_STAR}
SELECT p AS predicate, count(*) AS n, min(s) AS first_subject, max(o) AS last_object
FROM (SELECT DISTINCT s, p, o FROM kg) GROUP BY 1""")
def t10(t):
    kg, _ = epochs(t)
    return kg.groupBy("predicate").agg(
        n_rows(), F.min("subject").alias("first_subject"), F.max("object").alias("last_object")
    )


SQL_ACCEPTED_ROWS = "SELECT DISTINCT s, p, o FROM kg JOIN acc USING (b) WHERE accepted"


@query("T10_epochs_batch_mode", f"""WITH {SQL_ACCEPTED}
SELECT p AS predicate, count(*) AS n, min(s) AS first_subject, max(o) AS last_object FROM ({SQL_ACCEPTED_ROWS}) GROUP BY 1""")
def t10_batches(t):
    """First the tables' own batches, then all batches, each taken or refused as a whole."""
    raw = t.scratch.save(raw_triples(t), "raw")
    kg, _ = T.run_epochs(
        lambda kg, epoch: raw.where("batch_id < 4") if epoch == 0 else raw, raw.where(F.lit(False)),
        star_ontology(t.spark), t.scratch, epochs=3, mode="batch",
    )
    return kg.groupBy("predicate").agg(
        n_rows(), F.min("subject").alias("first_subject"), F.max("object").alias("last_object")
    )


@query("T11_epoch_progress", f"""WITH {SQL_STAR},
k AS (SELECT *, CASE WHEN p IN ('containsPart', 'shippedBy') THEN 2 WHEN b >= 4 THEN 1 ELSE 0 END AS e FROM kg),
f AS (SELECT e, count(*) AS fresh FROM (SELECT DISTINCT s, p, o, e FROM k) GROUP BY e),
c AS (SELECT x.e, count(*) AS judged, count(DISTINCT k.b) AS batches FROM (VALUES (0), (1), (2), (3)) x(e)
      JOIN k ON k.e <= x.e AND NOT EXISTS (SELECT 1 FROM (VALUES (0)) z(z) WHERE k.e < x.e) GROUP BY x.e)
SELECT CAST(e AS INTEGER) AS epoch, batches, judged AS candidates, coalesce(fresh, 0) AS new_triples,
  CAST(sum(coalesce(fresh, 0)) OVER (ORDER BY e) AS BIGINT) AS total FROM c LEFT JOIN f USING (e)""")
def t11(t):
    _, progress = epochs(t)
    return T.epoch_totals(progress).where("candidates > 0")


@query("T12_to_digraph_edges", f"""WITH {SQL_RAW}
SELECT s AS source, o AS target, arg_max(p, (b, q, p)) AS label FROM kg GROUP BY 1, 2""")
def t12(t):
    return T.to_digraph_edges(raw_triples(t))


@query("T13_triples_from_tables", f"""WITH {SQL_RAW}
SELECT p AS predicate, count(*) AS n, min(s) AS first_subject, max(o) AS last_object,
  CAST(sum(q) AS BIGINT) AS seq_sum, CAST(sum(b) AS BIGINT) AS batch_sum FROM kg GROUP BY 1""")
def t13(t):
    return raw_triples(t).groupBy("predicate").agg(
        n_rows(), F.min("subject").alias("first_subject"), F.max("object").alias("last_object"),
        F.sum("seq").alias("seq_sum"), F.sum("batch_id").alias("batch_sum"),
    )


@query("T14_triples_from_text", r"""
WITH r AS (
  SELECT 'page_' || page_id AS s, 'linksTo' AS p, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS o FROM pages
  UNION ALL SELECT 'event_' || event_id, 'has' || upper(k[1]) || substr(k, 2), props ->> k
    FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)
  UNION ALL SELECT 'document_' || doc_id, 'mentions',
    trim(regexp_replace(lower(m), '[^\p{Ll}\p{Nd}]+', '_', 'g'), '_')
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z0-9._]+@[A-Za-z0-9.]+)', 1)) AS m FROM documents))
SELECT p AS predicate, o AS object, count(*) AS n, min(s) AS first_subject FROM r WHERE o <> '' GROUP BY 1, 2""")
def t14(t):
    links = M.triples_from_links(t.pages, M.entity("page", "page_id"), "html", "page_id")
    props = M.triples_from_json(t.events, M.entity("event", "event_id"), "props", "event_id")
    mentions = M.triples_from_pattern(
        t.documents, M.entity("document", "doc_id"), "text", "mentions", r"([A-Za-z0-9._]+@[A-Za-z0-9.]+)", "doc_id"
    )
    rows = M.triples_from_tables([links, props, mentions]).where("object != ''")
    return rows.groupBy("predicate", "object").agg(n_rows(), F.min("subject").alias("first_subject"))


def replies(t):
    """One reply per order, as a model might send it: some are null, empty or broken."""
    triple = "named_struct('subject', concat('order_', o_orderkey), 'predicate', '{}', 'object', {})"
    full = f"to_json(array({triple.format('isA', "'Order'")}, " \
           f"{triple.format('placedBy', M.entity('customer', 'o_custkey'))}))"
    return t.orders.selectExpr("o_orderkey AS request_id", f"""CASE o_orderkey % 50
        WHEN 1 THEN substring({full}, 1, 30) WHEN 2 THEN 'null' WHEN 3 THEN '[]'
        WHEN 4 THEN '[{{"subject": "x", "predicate": "y"}}]' ELSE {full} END AS response""")


@query("T15_parse_triples_json", """
WITH k AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
g AS (SELECT * FROM k WHERE k % 50 NOT IN (1, 2, 3, 4))
SELECT 'isA' AS predicate, count(*) AS n, CAST(sum(k) AS BIGINT) AS batch_sum, max('Order') AS last_object FROM g
UNION ALL SELECT 'placedBy', count(*), CAST(sum(k) AS BIGINT), max('customer_' || c) FROM g
UNION ALL SELECT '(quarantine)', count(*), CAST(sum(k) AS BIGINT), NULL FROM k WHERE k % 50 IN (1, 4)""")
def t15(t):
    rows, bad = T.parse_triples(replies(t))
    return rows.groupBy("predicate").agg(
        n_rows(), F.sum("batch_id").alias("batch_sum"), F.max("object").alias("last_object")
    ).unionByName(bad.select(
        F.lit("(quarantine)").alias("predicate"), "request_id"
    ).groupBy("predicate").agg(
        n_rows(), F.sum("request_id").alias("batch_sum"), F.lit(None).cast("string").alias("last_object")
    ))
