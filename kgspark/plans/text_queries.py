"""TX1-TX7: text preparation."""

from pyspark.sql import functions as F

from kgspark.operators import text as X
from kgspark.plans.registry import query

_SQL_WORDS = r"words AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\s\v]+'), lambda x: x <> '') AS w FROM documents)"


def _fingerprint(df, *keys):
    return df.select(*keys, F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query("TX1_chunk_text", f"""WITH {_SQL_WORDS},
c AS (SELECT doc_id, w, unnest(range(0, greatest(CAST(ceil(len(w) / 512.0) AS BIGINT), 1))) AS pos FROM words),
t AS (SELECT doc_id, pos, array_to_string(w[pos * 512 + 1 : pos * 512 + 512], ' ') AS text FROM c)
SELECT doc_id, pos, length(text) AS n_chars, md5(text) AS digest FROM t WHERE text <> ''""")
def tx1(t):
    chunks = X.chunk_text(t.documents.select("doc_id", "text"))
    return _fingerprint(chunks, "doc_id", F.col("pos").cast("long").alias("pos"))


@query("TX2_chunk_gate", f"""WITH {_SQL_WORDS},
c AS (SELECT doc_id, w, unnest(range(0, greatest(CAST(ceil(len(w) / 512.0) AS BIGINT), 1))) AS pos FROM words WHERE length(text) > 2048),
t AS (SELECT doc_id, pos, array_to_string(w[pos * 512 + 1 : pos * 512 + 512], ' ') AS text FROM c
      UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 2048)
SELECT doc_id, pos, length(text) AS n_chars, md5(text) AS digest FROM t WHERE text <> ''""")
def tx2(t):
    chunks = X.chunk_gate(X.drop_empty(t.documents.select("doc_id", "text")))
    return _fingerprint(chunks, "doc_id", F.col("pos").cast("long").alias("pos"))


@query("TX3_batch_texts", """
WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS seq, text FROM documents),
b AS (SELECT seq // 4 AS batch_id, count(*) AS n_texts, string_agg(text, chr(10) ORDER BY seq) AS text FROM n GROUP BY 1)
SELECT batch_id, n_texts, length(text) AS n_chars, md5(text) AS digest FROM b""")
def tx3(t):
    docs = X.number_rows(t.documents.select("doc_id", "text"), [F.asc("doc_id")], t.scratch)
    return _fingerprint(X.batch_texts(docs, "seq", "text", 4), "batch_id", "n_texts")


@query("TX4_chunk_rows", """
WITH n AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS seq, conv_id, turn FROM conversations)
SELECT conv_id, turn, seq // 4 AS group_id, CAST(seq % 4 AS INTEGER) AS pos FROM n""")
def tx4(t):
    rows = t.conversations.select("conv_id", "turn")
    rows = X.number_rows(rows, [F.asc("conv_id"), F.asc("turn")], t.scratch)
    return X.chunk_rows(rows, "seq", 4).drop("seq")


@query("TX5_tree_merge", """
WITH l AS (
  SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents),
f AS (SELECT source, line, min((doc_id, line_no)) AS place FROM l GROUP BY 1, 2)
SELECT source, place[1] AS doc_seq, CAST(place[2] AS INTEGER) AS line_no, md5(line) AS digest FROM f""")
def tx5(t):
    merged = X.merge_distinct_lines(t.documents, "source", "doc_id", "text")
    return merged.select("source", "doc_seq", "line_no", F.md5("line").alias("digest"))


@query("TX6_min_length_check", """
SELECT lang, length(text) >= 100 AS kept, count(*) AS n, min(length(text)) AS shortest FROM documents GROUP BY 1, 2""")
def tx6(t):
    kept, short = X.check_min_length(t.documents, "text")
    both = kept.select("lang", "text", F.lit(True).alias("kept")).unionByName(
        short.select("lang", "text", F.lit(False).alias("kept"))
    )
    return both.groupBy("lang", "kept").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.length("text")).cast("long").alias("shortest")
    )


@query("TX7_non_empty_list_check", r"""
SELECT role, len(regexp_extract_all(text, '[^.?!\n]*[?]')) > 0 AS kept, count(*) AS n FROM conversations GROUP BY 1, 2""")
def tx7(t):
    replies = t.conversations.select(
        "role", F.regexp_extract_all("text", F.lit(r"[^.?!\n]*[?]"), F.lit(0)).alias("items")
    )
    kept, empty = X.check_non_empty_list(replies, "items")
    both = kept.select("role", F.lit(True).alias("kept")).unionByName(empty.select("role", F.lit(False).alias("kept")))
    return both.groupBy("role", "kept").agg(F.count(F.lit(1)).alias("n"))
