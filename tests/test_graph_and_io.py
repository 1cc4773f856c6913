import json
import os
import random
import time
from functools import reduce

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kgspark.operators import graph as G
from kgspark.operators import models as U
from kgspark.operators import triples as T
from kgspark.operators import views as V
from kgspark.plans.star import make_ontology
from kgspark.skew import SkewPolicy
from kgspark.sources import files as S
from kgspark.streaming import ingest as I
from kgspark.storage import local_table

COLUMNS = "subject string, predicate string, object string, batch_id long, seq long"


def graph(spark, rows):
    return local_table(spark, [(*r, 0, i) for i, r in enumerate(rows)], COLUMNS)


SMALL = [("a", "p1", "b"), ("a", "p2", "b"), ("a", "p1", "a"), ("c", "p1", "a"), ("x", "p3", "y")]


def as_map(df):
    return {r[0]: r[1] for r in df.collect()}


def test_degrees(spark):
    kg = graph(spark, SMALL)
    assert as_map(G.degree(kg)) == {"a": 5, "b": 2, "c": 1, "x": 1, "y": 1}
    lone = spark.createDataFrame([("z",)], "node string")
    assert as_map(G.degree_incident(kg, lone)) == {"a": 4, "b": 2, "c": 1, "x": 1, "y": 1, "z": 0}
    row = G.graph_metrics(kg).first()
    assert (row["node_count"], row["edge_count"], row["density"]) == (5, 5, 0.25)
    assert {r[0] for r in G.neighbors(kg, "a").collect()} == {"a", "b", "c"}


def test_bfs(spark, scratch):
    assert as_map(G.bfs_levels(graph(spark, SMALL), "b", scratch)) == {"b": 0, "a": 1, "c": 2}
    assert G.bfs_levels(graph(spark, SMALL), "nowhere", scratch).isEmpty()


def test_histograms(spark):
    degrees = spark.createDataFrame([(f"n{i}", i) for i in range(1, 62)], "node string, degree long")
    report = {r["label"]: r["entities"] for r in G.degree_histogram_report(degrees).collect()}
    assert report["3-5"] == 3 and sum(report.values()) == 61
    page = G.degree_histogram_page(degrees).orderBy("bin").collect()
    assert sum(r["entities"] for r in page) == 61 and page[-1]["label"] == "60-61"
    few = spark.createDataFrame([("a", 1), ("b", 3)], "node string, degree long")
    assert [tuple(r) for r in G.degree_histogram_page(few).orderBy("bin").collect()] == [
        (0, "0", 0), (1, "1", 1), (2, "2", 0), (3, "3", 1)
    ]


def test_top_with_other_keeps_a_real_other_apart(spark):
    counts = spark.createDataFrame([("Other", 9), ("b", 5), ("c", 3), ("d", 2)], "k string, n long")
    got = {tuple(r) for r in G.top_k_with_other(counts, "n", "k", 2).collect()}
    assert got == {("Other", 9, False), ("b", 5, False), ("Other", 5, True)}
    assert G.top_k_with_other(counts, "n", "k", 4).where("is_other").isEmpty()


def test_filters(spark):
    kg = graph(spark, [("ann", "ISA", "Person"), ("ann", "likes", "tea"), ("bob", "likes", "tea"), ("rex", "isA", "Dog")])
    rows = lambda df: {tuple(r)[:3] for r in df.collect()}
    assert rows(G.filter_kg(kg)) == rows(kg)
    assert rows(G.filter_kg(kg, entity_types=["Person"])) == {
        ("ann", "ISA", "Person"), ("ann", "likes", "tea"), ("rex", "isA", "Dog")
    }
    assert rows(G.filter_kg(kg, predicates=["likes"], exclude_entities=["bob"])) == {("ann", "likes", "tea")}
    nodes = spark.createDataFrame([("ann", "Person", 2), ("bob", None, 1), ("tea", "Drink", 2)], "node string, group string, degree long")
    edges = spark.createDataFrame([("ann", "tea", "likes"), ("bob", "tea", ""), ("ann", "bob", "knows")], "source string, target string, label string")
    kept, shown = G.filter_graph(nodes, edges, groups=["Drink"], labels=["likes"])
    assert {r["node"] for r in kept.collect()} == {"bob", "tea"}
    assert {tuple(r) for r in shown.collect()} == {("bob", "tea", "")}
    assert G.filter_graph(nodes, edges)[1].count() == 3


def test_fuzzy_search(spark):
    items = spark.createDataFrame([("customer_1",), ("costumer_2",), ("part_3",), (None,), ("",)], "node string")
    hits = {r["node"]: r["score"] for r in G.fuzzy_search(items, ["node"], "Customer").collect()}
    assert hits == {"customer_1": 0.0, "costumer_2": 0.25}
    assert G.fuzzy_search(items, ["node"], "c").isEmpty()
    # One typo in four letters, anywhere in a field, and no word limits.
    assert [r["node"] for r in G.fuzzy_search(items, ["node"], "prt_").collect()] == ["part_3"]
    assert [r["node"] for r in G.fuzzy_search(items, ["node"], "tomer1").collect()] == ["customer_1"]


def test_substring_distance_equals_brute_force(spark):
    """Against Sellers' rule, by the plain table of distances; the filter excludes no hit."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé#") for _ in range(rng.randint(0, 14))) for _ in range(150)] + ["", "a" * 500, "😀ab"]

    def least(query, text):
        column = list(range(len(query) + 1))
        best = column[-1]
        for c in text:
            before, column = column, [0]
            for i, q in enumerate(query, 1):
                column.append(min(before[i - 1] + (q != c), before[i] + 1, column[i - 1] + 1))
            best = min(best, column[-1])
        return best

    items = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for query in ("ab", "aé#b", "abba#", "bbabéa#ab", "ab" * 31):
        got = {r["id"]: r["d"] for r in items.select("id", G.substring_distance(F.col("t"), query).alias("d")).collect()}
        assert got == {i: least(query, t) for i, t in enumerate(texts)}
        for threshold in (0.0, 0.3, 0.6):
            hits = {r["id"] for r in G.fuzzy_search(items, ["t"], query, threshold, 1000).collect()}
            assert hits == {i for i, t in enumerate(texts) if least(query, t) / len(query) <= threshold}


def test_search_compares_once_and_merges_copies_of_matches_only(spark, capsys):
    """Many texts are compared at once; long ones in overlapping pieces that lose no part."""
    text = "x" * 250 + "customer_1" + "y" * 700 + "custmr_1"
    assert list(G.least_edits([text, "", "custmer_1", text[:253]], "custmer_1", step=16, rows=3)) == [1, 9, 0, 6]
    items = spark.createDataFrame([("customer_1", "likes", "part_1")] * 3 + [("a", "b", "c")], "source string, label string, target string")
    hits = G.fuzzy_matches(items, ["label", "source", "target"], "custmer_1")
    hits.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    assert hits.count() == 3
    nodes = spark.createDataFrame([("customer_1", None)], "node string, group string")
    found = [(r["kind"], r["item"]) for r in G.search_graph(nodes, items, "custmer_1").collect()]
    assert found == [("node", "customer_1"), ("edge", "customer_1 likes part_1")]


def test_graph_stats_compute_the_edges_once(spark, tmp_path):
    """Counts and nodes come from the written edges; null ends are counted as before."""
    rows = [("a", "p", "b", 1, 1), ("a", "q", "b", 1, 2), ("b", "p", None, 1, 3), ("a", None, "c", 2, 1)]
    triples = spark.createDataFrame(rows, "subject string, predicate string, object string, batch_id long, seq long")
    counts, nodes, edges = (sorted(map(tuple, df.collect()), key=str) for df in S.graph_stats(triples))
    plain = spark.sparkContext.accumulator(0)
    once = F.udf(lambda x: plain.add(1) or x, "string").asNondeterministic()
    S.write_graph_stats(triples.withColumn("subject", once("subject")), str(tmp_path / "stats"))
    assert plain.value == len(rows)
    for name, want, schema in (
        ("counts", counts, "nodes_count long, edges_count long"), ("nodes", nodes, "node string"),
        ("edges", edges, "source string, target string, label string"),
    ):
        got = spark.read.schema(schema).json(str(tmp_path / "stats" / name)).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_views(spark, base, scratch):
    kg = graph(spark, [("jane", "isA", "Writer"), ("emma", "hasAuthor", "jane"), ("emma", "isA", "Novel")])
    nodes, edges = V.combined_graph(base, kg)
    kinds = {r["node"]: (r["kind"], r["group"]) for r in nodes.collect()}
    assert kinds["hasAuthor"] == ("property", "ontology_property")
    assert kinds["jane"] == ("instance", "Writer") and "Novel" not in kinds
    typed = edges.where("origin = 'type'").collect()
    assert [(r["source"], r["target"]) for r in typed] == [("jane", "Writer")]
    drawn, _ = V.kg_graph(kg, with_ontology=True)
    assert {r["node"]: r["group"] for r in drawn.collect()} == {"emma": "Novel", "jane": "Writer"}
    _, edges = V.ontology_graph(base)
    assert edges.where("dangling").isEmpty()
    ids = V.node_ids(V.first_seen(kg), scratch, dense=True)
    assert as_map(ids) == {"jane": 1, "Writer": 2, "emma": 3, "Novel": 4}


def test_scan_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in {"a.TXT": "one\ntwo", "sub/b.md": "ü", "c.pdf": "%PDF", "d.exe": "x", "e.txt": "", "f": "y"}.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    documents, skipped = S.scan_text_files(spark, str(tmp_path))
    found = {os.path.basename(r["path"]): r["text"] for r in documents.collect()}
    assert found == {"a.TXT": "one\ntwo", "b.md": "ü"}
    assert [os.path.basename(r["path"]) for r in skipped.collect()] == ["c.pdf"]


def test_decode_files(spark, scratch, tmp_path):
    """A file is a row whatever happens to it: decoded, empty with a problem, or left out by its suffix."""
    (tmp_path / "sub").mkdir()
    files = {"a.TXT": "ü\r\n".encode(), "sub/b.md": b"\xff\xfe", "c.pdf": b"%PDF", "d.exe": b"x", "e.txt": b"",
             "f.odt": b"odt", "g.rtf": b"broken", "h.txt": b"long" * 100, "i.csv": b"a,b", "k.own": b"0a", "l.doc": b"none"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    # A checksum of other bytes makes the file system fail on this file.
    (tmp_path / ".i.csv.crc").write_bytes(b"crc\x00\x00\x00\x02\x00\x00\x00\x00\x00")

    def strict(content):
        if content == b"broken":
            raise ValueError("no end" + "." * 500)
        return content.decode()

    found = S.decode_files(spark, str(tmp_path), scratch, {
        ".odt": strict, ".rtf": strict, ".own": lambda b: bytes.fromhex(b.decode()).decode(), ".doc": lambda b: None,
    }, max_bytes=100)
    rows = {os.path.basename(r["path"]): (r["text"], r["problem"]) for r in found.collect()}
    assert found.count() == len(rows)
    assert rows.pop("b.md")[1].startswith("UnicodeDecodeError: ")
    text, problem = rows.pop("g.rtf")
    assert text == "" and problem.startswith("ValueError: no end.") and len(problem) == S.MAX_PROBLEM
    assert rows == {
        "a.TXT": ("ü\r\n", None), "c.pdf": ("", "no decoder"), "f.odt": ("odt", None),
        "h.txt": ("", "too long"), "i.csv": ("", "unreadable"), "k.own": ("\n", None), "l.doc": ("", None),
    }
    (tmp_path / "nothing").mkdir()
    assert S.decode_files(spark, str(tmp_path / "nothing"), scratch).isEmpty()


def test_lines_round_trip(spark, tmp_path):
    (tmp_path / "q.txt").write_text("b\na\n")
    rows = S.read_lines(spark, str(tmp_path / "q.txt")).orderBy("pos").collect()
    assert [(r["line"], r["after_end"]) for r in rows] == [("b", False), ("a", False), ("", True)]


@pytest.mark.parametrize("files", [1, 3, 8])
def test_lines_do_not_depend_on_files(spark, tmp_path, files):
    texts = ["a", "", "b\nc", "", "d"] * 3
    spark.createDataFrame([(t,) for t in texts], "text string").repartition(files).write.text(str(tmp_path / "l"))
    rows = S.read_lines(spark, str(tmp_path / "l")).where("not after_end").collect()
    assert sorted(r["line"] for r in rows) == sorted("\n".join(texts).split("\n"))


def test_ontology_lines_round_trip(spark, base, tmp_path):
    S.write_ontology(base, str(tmp_path / "lines"))
    back, broken = S.read_ontology(spark, str(tmp_path / "lines"), lines=True)
    for name in ("classes", "subclass_of", "object_properties", "data_properties"):
        rows = getattr(base, name)
        assert sorted(map(str, getattr(back, name).select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert back.name == base.name and broken.isEmpty()


def test_bfs_has_no_level_limit(spark, scratch):
    chain = [(f"n{i}", "p", f"n{i + 1}", 0, i) for i in range(7)] + [("loop", "p", "loop", 0, 99)]
    rows = local_table(spark, chain, COLUMNS)
    assert {r["node"]: r["level"] for r in G.bfs_levels(rows, "n0", scratch).collect()} == {f"n{i}": i for i in range(8)}
    assert [tuple(r) for r in G.bfs_levels(rows, "loop", scratch).collect()] == [("loop", 0)]
    assert G.bfs_levels(rows, "none", scratch).isEmpty()


def test_bfs_of_a_random_graph_with_split_hubs(spark, scratch):
    """Levels equal a plain search; hubs are dealt to parts, and no level moves the edges."""
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)] + [("hub", f"n{i}") for i in range(0, 60, 4)]
    rows = graph(spark, [(a, "p", b) for a, b in pairs] + [("far", "p", "away")])
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, now = {"n1": 0}, {"n1"}
    while now:
        now = {b for a in now for b in near.get(a, ())} - set(want)
        want |= {n: max(want.values()) + 1 for n in now}
    policy = SkewPolicy(min_rows=5, rows_per_split=2, sample=1.0)
    for p in (policy, SkewPolicy()):
        assert {r["node"]: r["level"] for r in G.bfs_levels(rows, "n1", scratch, p).collect()} == want
    adjacency = G.Adjacency(rows, scratch, policy)
    assert adjacency.hot.where("node = 'hub'").count() == 1
    frontier = scratch.save(spark.createDataFrame([("hub",), ("n1",)], "node string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = adjacency.next_to(frontier)
        plan = found._jdf.queryExecution().executedPlan().toString()
        edges = plan[:plan.index(adjacency.name)].rsplit("SortMergeJoin", 1)[1]  # what lies between the join and the scan
        assert "Exchange" not in edges and "Bucketed: true" in plan
        assert {r["node"] for r in found.collect()} == near["hub"] | (near["n1"] - {"n1"})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        adjacency.close()


@pytest.mark.parametrize("mode", ["row", "batch"])
def test_stream_keeps_first_type(spark, scratch, tmp_path, mode):
    """A type is the one of the first micro-batch, whatever the batch ids are; no scratch is left."""
    onto = make_ontology(
        spark, "o", ["Thing", "Person", "Employee", "Manager"],
        [("Person", "Thing"), ("Employee", "Person"), ("Manager", "Person")], [], [],
    )
    arrivals = [("x", "isA", "Person", 5, 0), ("x", "isA", "Employee", 0, 0), ("x", "isA", "Manager", 0, 0)]
    kg, ck, src = (str(tmp_path / n) for n in ("kg", "ck", "src"))
    for row in arrivals:
        part = local_table(spark, [row], COLUMNS)
        part.write.mode("append").parquet(src)
        I.stream_ingest(spark.readStream.schema(part.schema).parquet(src), kg, ck, onto, mode=mode).awaitTermination()
    got = {(r["object"], r["epoch"]) for r in I.read_snapshot(spark, kg).collect()}
    assert got == {("Person", 0), ("Employee", 1), ("Manager", 2)}


def test_ontology_round_trip(spark, base, tmp_path):
    path = str(tmp_path / "onto")
    S.write_ontology_document(base, path)
    text = "".join(p.read_text() for p in (tmp_path / "onto").glob("part-*"))
    assert set(json.loads(text)) == {"name", "classes", "subclass_relations", "object_properties", "data_properties"}
    back, broken = S.read_ontology(spark, path)
    assert back.name == "base" and broken.isEmpty()
    for table in ("classes", "subclass_of", "object_properties", "data_properties"):
        a, b = getattr(base, table), getattr(back, table)
        assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))


def test_large_ontology_document(spark, tmp_path):
    """Many part files, repeated rows, an empty section and names that JSON escapes, in order."""
    names = [f'C"{i % 300}\\ä' for i in range(400)]
    onto = make_ontology(spark, 'n"1', names, [(n, "Top") for n in names], [], [("hasX", ["Top"])])
    path = tmp_path / "onto"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        S.write_ontology_document(onto, str(path))
        S.write_ontology_document(onto, str(path))  # written again: replaced
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [p for p in path.iterdir() if not p.name.startswith(".")]
    document = json.loads(files[0].read_text())
    assert len(files) == 1 and document["name"] == 'n"1' and document["object_properties"] == []
    assert [c["name"] for c in document["classes"]] == names
    assert [r["subclass"] for r in document["subclass_relations"]] == names
    back, broken = S.read_ontology(spark, str(path))
    assert broken.isEmpty() and [r["name"] for r in back.classes.orderBy("seq").collect()] == names
    empty = make_ontology(spark, "e", [], [], [], [])
    S.write_ontology_document(empty, str(tmp_path / "empty"))
    assert S.read_ontology(spark, str(tmp_path / "empty"))[0].name == "e"


def test_kg_documents(spark, tmp_path):
    (tmp_path / "good.json").write_bytes(
        b'{"name": "g",\n "triplets": [{"subject": "a\xff", "predicate": "p", "object": "b"}]}'
    )
    (tmp_path / "none.json").write_text('{"name": "n", "triplets": null}')
    (tmp_path / "bad.json").write_text('{"name": "x", "triplets": [')
    (tmp_path / "unnamed.json").write_text('{"triplets": []}')
    triples, broken = S.read_kg(spark, str(tmp_path))
    assert [tuple(r)[:4] for r in triples.collect()] == [("g", "a", "p", "b")]
    assert broken.count() == 2
    S.write_kg_lines(graph(spark, SMALL), "kg", str(tmp_path / "out"), rows_per_document=2)
    back, _ = S.read_kg(spark, str(tmp_path / "out"), lines=True)
    assert {(r["subject"], r["predicate"], r["object"]) for r in back.collect()} == set(SMALL)


def test_stage_depends_on_its_inputs(spark, tmp_path):
    source, calls = str(tmp_path / "in"), []

    def run():
        df = spark.read.parquet(source)
        return S.stage(spark, str(tmp_path / "st"), "s", S.input_fingerprint(df),
                       lambda: calls.append(1) or df.groupBy().count())

    spark.range(3).write.parquet(source)
    assert run()[1] is False and run()[1] is True
    spark.range(4).write.mode("overwrite").parquet(source)
    table, reused = run()
    assert not reused and table.first()[0] == 4 and len(calls) == 2


def test_retry_sends_only_failed_rows(spark, scratch, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def make():
        def call(batch: pd.DataFrame) -> pd.Series:
            for i, a in zip(batch["request_id"], batch["attempt"]):
                (log / f"{i}-{a}").write_text("")
            ok = (batch["request_id"] % 2 == 0) | batch["errors"].notna()
            return ok.map({True: "good", False: "bad"})

        return call

    check = lambda r: r.where("response = 'bad'").select("request_id", F.lit("was bad").alias("errors"))
    requests = spark.range(4).selectExpr("id AS request_id", "'x' AS request")
    pauses = []
    answered, failed = U.validate_and_retry(requests, make, check, scratch, tries=5, sleep=pauses.append)
    assert {r["request_id"]: r["attempt"] for r in answered.collect()} == {0: 1, 1: 2, 2: 1, 3: 2}
    assert failed.isEmpty() and len(pauses) == 1 and 0.5 <= pauses[0] <= 0.6
    assert sorted(p.name for p in log.iterdir()) == ["0-1", "1-1", "1-2", "2-1", "3-1", "3-2"]


def test_queued_calls_wait_for_no_other_row(spark, scratch, tmp_path):
    """One row is slow, one fails always, one fails once: each has its own tries and pauses."""
    log = tmp_path / "calls"
    log.mkdir()

    def make():
        def call(request_id, request, attempt, errors):
            (log / f"{request_id}-{attempt}").write_text(repr((time.monotonic(), errors)))
            if request_id == 0:
                time.sleep(1.5)
            if request_id == 1 or (request_id == 2 and attempt == 1):
                raise ValueError(f"no {attempt}")
            return None if request_id == 3 else "bad" if request_id == 4 and not errors else request

        return call

    rows = [(i, None if i == 5 else "x") for i in range(40)] + [(6, "y"), (None, "z")]
    requests = spark.createDataFrame(rows, "request_id bigint, request string").coalesce(1)
    answered, failed = U.queue_calls(
        requests, make, scratch, check=lambda q, r: "was bad" if r == "bad" else None,
        in_flight=2, tries=25, delay=0.01, max_delay=0.02, jitter=0.0,
    )
    got = answered.collect()
    assert len(got) == 41 and {r["request_id"]: r["attempt"] for r in got if r["attempt"] > 1} == {2: 2, 4: 2}
    assert all(r["response"] == (None if r["request_id"] == 3 else r["request"]) for r in got)
    (bad,) = failed.collect()
    assert tuple(bad) == (1, "x", None, 25, "ValueError: no 25")
    told = {p.name: eval(p.read_text()) for p in log.iterdir()}
    assert told["2-2"][1] == "ValueError: no 1" and told["4-2"][1] == "was bad" and "1-26" not in told
    # All others were called while the slow row was open, and pauses were kept.
    assert max(at for at, _ in told.values()) < told["0-1"][0] + 1.5
    assert told["1-3"][0] - told["1-2"][0] >= 0.02
    assert U.queue_calls(requests.limit(0), make, scratch)[0].isEmpty()


def test_state_of_split_words(spark):
    """Words of many chunks are split; a hub keeps all its triples in every chunk."""
    chunks = spark.createDataFrame([(i, f"hub and word_{i % 3} HUB") for i in range(60)] + [(99, None)], "id long, text string")
    kg = spark.createDataFrame(
        [("hub", "isA", "Thing"), ("hub", "p", "x"), ("word_1", "p", "y"), ("other", "p", "z")],
        "subject string, predicate string, object string",
    )
    plain = U.mentioned_state(chunks, kg, "id", "text").collect()
    split = U.mentioned_state(chunks, kg, "id", "text", SkewPolicy(min_rows=5, rows_per_split=4, sample=1.0))
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, plain)) and len(plain) == 60 * 2 + 20


def test_parse_response(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": ',), (None,)], "response string")
    good, bad = U.parse_response(rows, "struct<a:int>")
    assert [r["parsed"]["a"] for r in good.collect()] == [1] and bad.count() == 2


def test_stream_equals_batch(spark, base, scratch, tmp_path):
    arrivals = [
        [("jane", "isA", "Writer"), ("emma", "isA", "Book"), ("rex", "isA", "Dog")],
        [("emma", "hasAuthor", "jane"), ("jane", "isA", "Place"), ("emma", "isA", "Book")],
    ]
    parts = [local_table(spark, [(*t, b, q) for q, t in enumerate(rows)], COLUMNS) for b, rows in enumerate(arrivals)]
    kg, ck, src = (str(tmp_path / n) for n in ("kg", "ck", "src"))
    for part in parts:
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(part.schema).parquet(src)
        I.stream_ingest(stream, kg, ck, base).awaitTermination()
    whole = reduce(lambda a, b: a.unionByName(b), parts)
    batch = T.accumulate(T.accepted(T.validate(whole, base, scratch)))
    got = [tuple(r)[:3] for r in I.read_snapshot(spark, kg).collect()]
    assert sorted(got) == sorted(tuple(r) for r in batch.collect()) and len(got) == 3


def test_a_micro_batch_opens_only_its_own_buckets(spark, base, tmp_path):
    """The files of all other buckets are made unreadable before the next micro-batch."""
    kg, ck, src = (str(tmp_path / n) for n in ("kg", "ck", "src"))
    first = [(f"w{i}", "isA", "Writer") for i in range(40)] + [(f"b{i}", "isA", "Book") for i in range(40)]
    second = [("b1", "hasAuthor", "w1"), ("b1", "isA", "Book"), ("w2", "isA", "Place"), ("b2", "hasAuthor", "b1")]
    def arrive(rows, batch):
        part = local_table(spark, [(*t, batch, q) for q, t in enumerate(rows)], COLUMNS)
        part.write.mode("append").parquet(src)
        I.stream_ingest(spark.readStream.schema(part.schema).parquet(src), kg, ck, base, buckets=64).awaitTermination()
    arrive(first, 0)
    names = {"b1", "w1", "w2", "b2", "Book", "Place"}
    ids = spark.createDataFrame([(n,) for n in names], "n string").select(I.bucket_of("n", 64).alias("b")).collect()
    own, broken = {r["b"] for r in ids}, {}
    for path in (tmp_path / "kg" / "epoch=0").glob("bucket=*/*.parquet"):
        if int(path.parent.name.split("=")[1]) not in own:
            broken[path] = path.read_bytes()
            path.write_bytes(b"unreadable")
            path.with_name(f".{path.name}.crc").unlink()
    assert len(broken) > 20
    arrive(second, 1)
    for path, data in broken.items():
        path.write_bytes(data)
    got = {tuple(r)[:3] for r in I.read_snapshot(spark, kg).where("epoch = 1").collect()}
    assert got == {("b1", "hasAuthor", "w1")}
    assert I.read_snapshot(spark, kg).where("epoch = 0").count() == 80


def test_registered_queries_are_paired():
    from kgspark.plans import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) >= 110


def test_adjacency_shuffles_the_edges_once(spark, scratch, monkeypatch):
    """Nothing but the few hub rows is written before the buckets; copies, loops and nulls change no level."""
    names = []
    plain = scratch.save
    monkeypatch.setattr(scratch, "save", lambda df, name="t": names.append(name) or plain(df, name))
    rows = graph(spark, SMALL * 3 + [("a", "p1", None), (None, "p1", "x"), ("c", "p1", "d")])
    for policy in (SkewPolicy(), SkewPolicy(min_rows=2, rows_per_split=1, sample=1.0)):
        assert as_map(G.bfs_levels(rows, "b", scratch, policy)) == {"b": 0, "a": 1, "c": 2, "d": 3}
    assert names == ["hot", "hot"]


def test_scratch_tables_leave_no_shuffle_files(spark, scratch):
    """What was shuffled to write a table goes when it is there; the session's own setting stays as it was."""
    from kgspark.storage import FREED

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = blocks.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    there, setting = files(), spark.conf.get(FREED, None)
    rows = spark.range(10_000).selectExpr("id % 1000 AS k", "id").groupBy("k").agg(F.sum("id").alias("n"))
    saved = scratch.save(rows)
    for _ in range(100):
        if not files() - there:
            break
        time.sleep(0.1)
    assert not files() - there and saved.count() == 1000
    assert spark.conf.get(FREED, None) == setting
    assert all(f.endswith(".zstd.parquet") for f in saved.inputFiles())


def test_graph_documents_are_compressed_and_copies_merged(spark, tmp_path):
    rows = graph(spark, [(f"s{i % 500}", "p", "o" * 50) for i in range(1500)] + [("x", "p", None), ("x", "p", None)])
    S.write_kg_lines(rows, "kg", str(tmp_path / "out"), rows_per_document=100)
    parts = list((tmp_path / "out").glob("part-*"))
    assert parts and all(p.name.endswith(".gz") for p in parts) and sum(p.stat().st_size for p in parts) < 15_000
    back, broken = S.read_kg(spark, str(tmp_path / "out"), lines=True)
    assert broken.isEmpty() and back.count() == 501 and back.select(*T.SPO).distinct().count() == 501


def test_exported_edges_and_nodes_are_compressed(spark, tmp_path):
    rows = graph(spark, [(f"s{i}", "p", f"o{i % 7}") for i in range(300)])
    S.write_graph_stats(rows, str(tmp_path / "stats"))
    S.write_node_link(rows, str(tmp_path / "link"))
    for folder, n in (("stats/edges", 300), ("stats/nodes", 307), ("link/links", 300), ("link/nodes", 307)):
        parts = list((tmp_path / folder).glob("part-*"))
        assert parts and all(p.name.endswith(".json.gz") for p in parts)
        assert spark.read.json(str(tmp_path / folder)).count() == n


def test_known_triples_are_those_that_rows_may_equal(spark, scratch, tmp_path):
    """Of subjects only the predicates of the rows and types are read; nulls are equal."""
    kg = str(tmp_path / "kg")
    known = [("a", "p", "x"), ("a", "q", "x"), ("a", "isA", "A"), ("x", "isA", "X"), ("x", "p", "a"), ("a", None, "z")]
    I.write_published(graph(spark, known), 0, kg, 8)
    for rows, want in (
        ([("a", "p", "x")], {known[0], known[2], known[3]}),
        ([("a", None, "x"), (None, "q", "a")], {known[1], known[2], known[3], known[5]}),
        ([(None, "p", None)], set()),
    ):
        got = I.read_known(spark, kg, graph(spark, rows), 1, 8).select(*T.SPO).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
