"""DuckDB SQL of the queries that SQL can express on whole tables.

The others are tested against plain restatements, round trips or held-out labels
(tests/llm): op2 cuts bytes, op4 and op8 need the vocabularies, op6 parses markup,
op7 fits a model, op11 needs a hash that DuckDB lacks, op13 solves for eigenvectors.
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_BARE = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, {_BARE}) AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, {_BARE}) AS ws FROM benchmark),
cut AS (SELECT item_id, ws, least(10, len(ws)) AS m FROM items WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS w
         FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM cut)),
sizes AS (SELECT DISTINCT m FROM wins),
docwins AS (SELECT rid, m, i, array_to_string(ws[i:i + m - 1], ' ') AS w
            FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d JOIN sizes ON m <= len(ws))),
hits AS (SELECT rid, i, docwins.m AS m, item_id FROM docwins JOIN wins ON docwins.m = wins.m AND docwins.w = wins.w),
marked AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hits) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN found USING (rid)
"""

_OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws,
                  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
           FROM documents),
wins AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS w
         FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
often AS (SELECT rid, w FROM wins GROUP BY rid, w HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n
            FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM wins JOIN often USING (rid, w)) GROUP BY rid),
base AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
                CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
         FROM d LEFT JOIN covered USING (rid)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS f FROM judged GROUP BY source),
fit AS (SELECT coalesce(avg(f / n) FILTER (n > 1), sum(f) / sum(n)) AS m, var_pop(f / n) FILTER (n > 1) AS v, sum(n) AS n
        FROM hosts),
prior AS (SELECT m, CASE WHEN coalesce(v, 0) > 0 THEN greatest(m * (1 - m) / v - 1, 0) ELSE n END AS k FROM fit),
rates AS (SELECT source, (f + (SELECT m * k FROM prior)) / (n + (SELECT k FROM prior)) AS rate FROM hosts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= 0.5 AS kept
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source
"""

_OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS ws FROM documents),
cut AS (SELECT doc_id, ws, least(4, len(ws)) AS k FROM d WHERE len(ws) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + k - 1], ' ') AS s
             FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM cut)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
              FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_have JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * both_have.n >= 80 * (x.n + y.n - both_have.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
          UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id,
       documents.doc_id = component_id AS kept
FROM documents LEFT JOIN sizes ON sizes.doc_id = documents.doc_id JOIN least_id ON a = documents.doc_id
"""

_OP9 = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
                  AS place FROM turns),
prefixes AS (SELECT *, string_agg(md5(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n')), ',')
                       OVER (PARTITION BY conv_id ORDER BY place) AS p FROM placed),
ends AS (SELECT conv_id, max(place) AS n_turns FROM placed GROUP BY conv_id),
whole AS (SELECT p, n_turns, min(conv_id) AS conv_id, count(*) AS copies
          FROM prefixes JOIN ends USING (conv_id) WHERE place = n_turns GROUP BY p, n_turns),
proper AS (SELECT DISTINCT p FROM prefixes JOIN ends USING (conv_id) WHERE place < n_turns),
kept AS (SELECT conv_id, n_turns, copies FROM whole WHERE p NOT IN (SELECT p FROM proper))
SELECT conv_id, (place - 1) // 256 AS part, n_turns, copies,
       string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), ''
                  ORDER BY place) AS text
FROM placed JOIN kept USING (conv_id) GROUP BY conv_id, part, n_turns, copies
"""

_OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
wins AS (SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
         FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
often AS (SELECT h FROM wins GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM wins JOIN often USING (h)),
words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid),
counts AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN counts USING (rid) LEFT JOIN kept USING (rid)
"""

_OP12 = rf"""
WITH RECURSIVE crc_steps(i, k, c) AS (
    SELECT i, 0, CAST(i AS BIGINT) FROM range(256) r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8),
runs AS (SELECT rid, doc_id, unnest(regexp_extract_all(
             {_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
         FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS checked, run, count(*) AS n
            FROM runs WHERE length(run) >= 6 GROUP BY rid, doc_id, run),
bytes AS (SELECT checked, flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)]
                                  ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END
                                  FOR x IN regexp_extract_all(checked, '(?s).')]) AS bs
          FROM (SELECT DISTINCT checked FROM counted)),
sums AS (SELECT checked, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(bs AS BIGINT[])),
                lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h
         FROM bytes, crc_table),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
                    ELSE run END AS word, n
        FROM counted JOIN sums USING (checked)),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, length(word) AS len, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
         FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT less.word AS a, words.word AS b FROM less JOIN words ON rest = words.word),
near AS (SELECT a, b FROM shorter UNION SELECT b, a FROM shorter
         UNION SELECT x.word, y.word FROM less x JOIN less y USING (len, i, rest) WHERE x.word <> y.word),
best AS (SELECT a, count(*) AS n_near, min({{'k': -w.n, 'b': b}}) AS top FROM near JOIN words w ON w.word = b GROUP BY a),
formed AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
                  CASE WHEN -top.k >= 5 * words.n THEN top.b END AS form, CASE WHEN -top.k >= 5 * words.n THEN -top.k END AS form_n
           FROM words LEFT JOIN best ON a = words.word),
up AS (SELECT word, word AS root FROM formed
       UNION ALL SELECT up.word, form FROM up JOIN formed ON formed.word = up.root WHERE form IS NOT NULL),
ends AS (SELECT up.word, root FROM up JOIN formed f ON f.word = root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM formed JOIN ends USING (word)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_benchmark_decontamination": _OP1,
    "op3_host_quality_rules": _OP3,
    "op5_minhash_near_dedup": _OP5,
    "op9_chat_snapshots": _OP9,
    "op10_substring_dedup": _OP10,
    "op12_spelling_variants": _OP12,
}
