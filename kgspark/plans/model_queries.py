"""U1-U6: model calls, with a rule function in the place of a model."""

import json
import re
from hashlib import blake2b

import pandas as pd
from pyspark.sql import functions as F

from kgspark.operators.generate import generate_kg
from kgspark.operators import models as U
from kgspark.operators import text as X
from kgspark.operators import triples as T
from kgspark.plans.registry import n_rows, query
from kgspark.plans.star import SQL_STAR, make_ontology, star_triples


def turns(t):
    """Conversation turns as requests: id, role and whole text."""
    return t.conversations.selectExpr("conv_id * 1000 + turn AS request_id", "role", "text")


@query("U1_render_requests", """
SELECT conv_id * 1000 + turn AS request_id, role AS back_role, md5(text) AS back_text, length(text) AS n_chars FROM conversations""")
def u1(t):
    requests = U.render_requests(turns(t), "extract triples", ["role", "text"], fixed={"ontology": "{}"})
    back = F.from_json("request", "instruction string, ontology string, role string, text string").alias("r")
    return requests.select("request_id", back).where("r.instruction = 'extract triples' and r.ontology = '{}'").select(
        "request_id", F.col("r.role").alias("back_role"), F.md5("r.text").alias("back_text"),
        F.length("r.text").cast("long").alias("n_chars"),
    )


@query("U1_mentioned_state", f"""WITH {SQL_STAR},
w AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name || ' ' || replace(p_brand, '#', 'x') || ' nation_' || p_size), ' ')) AS s FROM part)
SELECT p AS predicate, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS key_sum FROM w JOIN kg USING (s) GROUP BY 1""")
def u1_state(t):
    chunks = t.part.selectExpr("p_partkey", "concat(p_name, ' ', replace(p_brand, '#', 'x'), ' nation_', p_size) AS text")
    state = U.mentioned_state(chunks, star_triples(t), "p_partkey", "text")
    return state.groupBy("predicate").agg(n_rows(), F.sum("p_partkey").alias("key_sum"))


def rule_model():
    """Stands in for a model: one triple for the speaker, one per capitalised run of letters."""
    def make():
        word = re.compile(r"[A-Z][a-z]+")

        def reply(request_id, request):
            body, subject = json.loads(request), f"turn_{request_id}"
            found = [{"subject": subject, "predicate": "isA", "object": body["role"].capitalize()}]
            found += [
                {"subject": subject, "predicate": "mentions", "object": w.lower()} for w in word.findall(body["text"])
            ]
            return json.dumps(found)

        return lambda batch: pd.Series(
            [reply(*row) for row in zip(batch["request_id"], batch["request"])], index=batch.index
        )

    return make


def replies(t):
    return U.map_model(U.render_requests(turns(t), "extract", ["role", "text"]), rule_model())


@query("U2_map_model", r"""
WITH m AS (SELECT conv_id * 1000 + turn AS id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS w FROM conversations)
SELECT 'isA' AS predicate, upper(role[1]) || substr(role, 2) AS object, count(*) AS n FROM conversations GROUP BY 2
UNION ALL SELECT 'mentions', lower(w), count(*) FROM m GROUP BY 2""")
def u2(t):
    rows, _ = T.parse_triples(replies(t))
    return rows.groupBy("predicate", "object").agg(n_rows())


@query("U3_parse_response", """
SELECT 'parsed' AS kind, o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderkey % 20 <> 0 GROUP BY 2
UNION ALL SELECT 'quarantine', NULL, count(*) FROM orders WHERE o_orderkey % 20 = 0""")
def u3(t):
    rows = t.orders.selectExpr(
        "o_orderkey AS request_id",
        "if(o_orderkey % 20 = 0, '{\"status\": ', to_json(named_struct('status', o_orderstatus, 'total', o_totalprice))) AS response",
    )
    good, bad = U.parse_response(rows, "struct<status:string,total:double>")
    return good.groupBy(F.lit("parsed").alias("kind"), F.col("parsed.status").alias("status")).agg(n_rows()).unionByName(
        bad.agg(n_rows()).select(F.lit("quarantine").alias("kind"), F.lit(None).cast("string").alias("status"), "n")
    )


def stubborn_model():
    """Gets the class right only once it is told of its error; some never do."""
    def make():
        def reply(request_id, request, attempt, errors):
            key = int(request_id)
            needed = 1 if key % 5 else 2 if key % 10 else 3 if key % 50 else 99
            right = attempt >= needed and (needed == 1 or "not a class" in (errors or ""))
            return json.dumps([
                {"subject": f"order_{key}", "predicate": "isA", "object": "Order" if right else "Gadget"},
                {"subject": f"order_{key}", "predicate": "hasStatus", "object": json.loads(request)["o_orderstatus"]},
            ])

        columns = ["request_id", "request", "attempt", "errors"]
        return lambda batch: pd.Series(
            [reply(*row) for row in zip(*(batch[c] for c in columns))], index=batch.index
        )

    return make


@query("U4_validate_and_retry", """
SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'failed' ELSE 'answered' END AS outcome,
  CAST(CASE WHEN o_orderkey % 5 <> 0 THEN 1 WHEN o_orderkey % 10 <> 0 THEN 2 WHEN o_orderkey % 50 <> 0 THEN 3 ELSE 4 END AS INTEGER) AS attempt,
  count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders GROUP BY 1, 2""")
def u4(t):
    onto = make_ontology(t.spark, "o", ["Order"], [], [], [("hasStatus", ["Order"])])
    rules = T.prepare_rules(onto, t.scratch)
    requests = U.render_requests(
        t.orders.withColumnRenamed("o_orderkey", "request_id"), "extract", ["o_orderstatus"]
    )

    def check(replies):
        rows, broken = T.parse_triples(replies)
        errors = U.reply_errors(T.error_messages(T.validate(rows, rules, t.scratch)))
        return errors.unionByName(broken.select(
            F.col("request_id").cast("long"), F.lit("the reply is no list of triples").alias("errors")
        ))

    answered, failed = U.validate_and_retry(requests, stubborn_model(), check, t.scratch, tries=4, delay=0.0)
    both = answered.select("request_id", "attempt", F.lit("answered").alias("outcome")).unionByName(
        failed.select("request_id", "attempt", F.lit("failed").alias("outcome"))
    )
    return both.groupBy("outcome", "attempt").agg(n_rows(), F.sum("request_id").alias("key_sum"))


def busy_model():
    """A call per order that times out at first for some, answers late for others, or never right."""
    def make():
        def call(request_id, request, attempt, errors):
            if request_id % 7 == 0 and attempt == 1:
                raise TimeoutError("busy")
            if request_id % 50 == 0:
                return "?"
            return json.loads(request)["o_orderstatus"] if request_id % 7 or errors == "TimeoutError: busy" else "?"

        return call

    return make


@query("U4_queue_calls", """
SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'failed' ELSE 'answered' END AS outcome,
  CAST(CASE WHEN o_orderkey % 50 = 0 THEN 3 WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempt,
  CASE WHEN o_orderkey % 50 = 0 THEN '?' ELSE o_orderstatus END AS response,
  CASE WHEN o_orderkey % 50 = 0 THEN 'no status: ?' END AS errors,
  count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders GROUP BY ALL""")
def u4_queue(t):
    requests = U.render_requests(t.orders.withColumnRenamed("o_orderkey", "request_id"), "status", ["o_orderstatus"])
    answered, failed = U.queue_calls(
        requests, busy_model(), t.scratch, tries=3, delay=0.001, jitter=0.0,
        check=lambda request, reply: None if reply in ("F", "O", "P") else f"no status: {reply}",
    )
    both = answered.withColumn("outcome", F.lit("answered")).unionByName(failed.withColumn("outcome", F.lit("failed")))
    return both.groupBy("outcome", "attempt", "response", "errors").agg(n_rows(), F.sum("request_id").alias("key_sum"))


def term_model():
    """Names long words as terms, and gives the length of those it is told are known."""
    def make():
        term = re.compile(r"\b[a-z]{14,}\b")

        def reply(request):
            request = json.loads(request)
            known = {k["subject"] for k in json.loads(request["known"])}
            terms = set(term.findall(request["text"]))
            return json.dumps(
                [{"subject": w, "predicate": "isA", "object": "Term"} for w in sorted(terms)]
                + [{"subject": w, "predicate": "hasLength", "object": str(len(w))} for w in sorted(terms & known)]
            )

        return lambda batch: batch["request"].map(reply)

    return make


@query("U6_generate_kg", r"""
WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[^\p{L}\p{Nd}_]+')) AS w FROM documents),
t AS (SELECT w FROM w WHERE regexp_full_match(w, '[a-z]{14,}'))
SELECT 0 AS epoch, 'isA' AS predicate, count(*) AS n, min('Term') AS least, max(w) AS last_subject FROM t
UNION ALL SELECT 1, 'hasLength', count(*), min(CAST(length(w) AS VARCHAR)), max(w) FROM t""")
def u6(t):
    onto = make_ontology(t.spark, "o", ["Term"], [], [], [("hasLength", ["Term"])])
    path = t.scratch.new_path("kg")
    generate_kg(t.documents, "doc_id", "text", onto, term_model(), t.scratch, epochs=4, tries=2, path=path, delay=0.0)
    return t.spark.read.parquet(path).groupBy("epoch", "predicate").agg(
        n_rows(), F.min("object").alias("least"), F.max("subject").alias("last_subject")
    )


def line_merger():
    """A user's merge function: distinct lines of several documents, in order, told by 128 bits each."""
    def merge(documents):
        seen = set()
        for document in documents:
            for line in document:
                key = blake2b(line.encode(), digest_size=16).digest()
                if key not in seen:
                    seen.add(key)
                    yield line

    return merge


@query("U5_custom_merge", """
WITH d AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS s FROM documents),
l AS (SELECT source, s, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM d),
f AS (SELECT source, line, min((s, ln)) AS place FROM l GROUP BY 1, 2),
c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT f.source, md5(string_agg(line, chr(10) ORDER BY place)) AS digest, CAST(ceil(round(log(any_value(c.n)) / log(6), 9)) AS INTEGER) AS rounds
FROM f JOIN c USING (source) GROUP BY 1""")
def u5(t):
    docs = X.number_rows(t.documents.select("source", "doc_id", "text"), [F.asc("source"), F.asc("doc_id")], t.scratch)
    first = docs.groupBy("source").agg(F.min("seq").alias("first"))
    docs = docs.join(first, "source").withColumn("seq", F.col("seq") - F.col("first"))
    merged = X.tree_merge_lines(docs, "source", "seq", "text", line_merger(), t.scratch)
    return X.joined_md5(merged, "source", "pos", "text").select("source", "digest", "rounds")
