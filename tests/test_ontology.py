"""Rules over deltas, hierarchy operations and components."""

import random

import pytest
from pyspark.sql import functions as F

from kgspark import schemas
from kgspark.operators import hierarchy as H
from kgspark.operators import ontology as O
from kgspark.operators.incremental import build_incremental
from kgspark.plans.star import make_ontology
from kgspark.skew import SkewPolicy, running_total
from kgspark.storage import local_table

TINY = SkewPolicy(min_rows=2, rows_per_split=1, sample=1.0)


def delta(spark, classes=(), relations=(), objects=(), data=()):
    onto = make_ontology(spark, "delta", list(classes), list(relations), list(objects), list(data))

    def shift(df, by):
        return df.withColumn("seq", F.col("seq") + by)

    return O.Ontology("delta", shift(onto.classes, 1000), shift(onto.subclass_of, 1000),
                      shift(onto.object_properties, 1000), shift(onto.data_properties, 1500))


DELTAS = [
    (dict(classes=["person"]), ["class_already_exists"]),
    (dict(classes=["city"]), ["class_name_not_uppercase"]),
    (dict(relations=[("Ghost", "Thing")]), ["subclass_not_found"]),
    (dict(relations=[("Person", "Ghost")]), ["superclass_not_found"]),
    (dict(relations=[("Writer", "Place")]), ["subclass_already_has_superclass"]),
    (dict(classes=["City"], relations=[("City", "City")]), ["subclass_equals_superclass", "superclass_not_found"]),
    (dict(relations=[("Thing", "Person")]), ["circular_subclass_relation"]),
    (dict(classes=["City"]), ["superclass_not_found"]),
    (dict(objects=[("bornIn", ["Person"], ["Place"])]), ["property_already_exists"]),
    (dict(data=[("hasAge", ["Ghost"])]), ["domain_classes_not_found"]),
    (dict(objects=[("sees", ["Person"], ["Ghost"])]), ["range_classes_not_found"]),
    (dict(classes=["A", "B"], relations=[("A", "B"), ("B", "A")]), []),
    (dict(classes=["City"], relations=[("City", "Place")], data=[("hasMayor", ["city"])]), []),
    (dict(data=[("hasAge", ["Person"]), ("hasAge", ["Person"])]), ["property_already_exists"]),
    (dict(classes=["City", "city"]), ["class_already_exists"]),
]


@pytest.mark.parametrize("i", range(len(DELTAS)))
def test_delta_rules(spark, base, scratch, i):
    parts, expected = DELTAS[i]
    for policy in ((SkewPolicy(), TINY) if i in (4, 14) else (SkewPolicy(),)):
        result = O.try_add_concepts(base, delta(spark, **parts), scratch, policy=policy)
        assert sorted(r["code"] for r in result.issues.collect()) == sorted(expected)
        assert result.valid is (not expected)
        grown = len(parts.get("classes", ())) if result.valid else 0
        assert result.ontology.classes.count() == 5 + grown


def test_two_tops_without_a_root(spark, scratch):
    empty = O.empty_ontology(spark)
    result = O.try_add_concepts(empty, delta(spark, classes=["A", "B"]), scratch)
    issues = {(r["code"], r["path"], r["context"]) for r in result.issues.collect()}
    assert issues == {("multiple_classes_without_superclass", f"class:{c}", "2 such classes") for c in "AB"}
    assert O.try_add_concepts(empty, delta(spark, classes=["A"]), scratch).valid


def test_root_and_lookups(base):
    assert O.root_class(base).first()["name"] == "Writer"
    assert {r["name"] for r in O.top_classes(base).collect()} == {"Thing"}
    supers = {r["class_name"]: set(r["supers"]) for r in O.superclass_sets(base).collect()}
    assert supers["Writer"] == {"Writer", "Person"} and supers["Thing"] == {"Thing"}


def test_transitive_supers(base, scratch):
    pairs = {tuple(r) for r in O.transitive_superclass_pairs(base, scratch).collect()}
    assert ("Writer", "Thing") in pairs and ("Thing", "Writer") not in pairs


def edges_of(spark, pairs):
    return local_table(spark, [(a, b) for a, b in pairs], "a string, b string")


@pytest.mark.parametrize("policy", [SkewPolicy(), TINY])
def test_components_equal_union_find(spark, scratch, policy):
    rng = random.Random(2)
    pairs = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(45)]
    pairs += [(f"c{i:02}", f"c{i + 1:02}") for i in range(20)] + [("x", "x")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    expected = {x: find(x) for x in parent}
    found = H.connected_components(edges_of(spark, pairs), scratch, policy=policy)
    assert {r["node"]: r["component"] for r in found.collect()} == expected


SPLIT = [("A", "R"), ("B", "R"), ("C", "S"), ("D", "T")]


def split_ontology(spark):
    return make_ontology(
        spark, "split", ["A", "B", "C", "D", "R", "S", "T"], SPLIT,
        [("p", ["D", "A", "A"], ["T", "R"]), ("q", ["D"], ["T"])], [("d", ["T"])],
    )


def ops(spark, rows):
    return local_table(spark, [
        (i, op, idx, [{"subclass": a, "superclass": b} for a, b in rel], cls)
        for i, (op, idx, rel, cls) in enumerate(rows)
    ], schemas.OPS)


def test_clusters(spark, base, scratch):
    found = H.find_isolated_clusters(split_ontology(spark), scratch)
    assert {(r["class_name"], r["cluster_index"]) for r in found.collect()} == {
        ("A", 1), ("B", 1), ("R", 1), ("C", 2), ("S", 2), ("D", 3), ("T", 3),
    }
    assert H.find_isolated_clusters(base, scratch).isEmpty()
    assert H.find_isolated_clusters(O.empty_ontology(spark), scratch).isEmpty()


@pytest.mark.parametrize("op,error", [
    (("merge", [1, 2], [("S", "R")], []), None),
    (("merge", [1, 2], [("Nope", "R")], []), "unknown_class"),
    (("merge", [1, 9], [("S", "R")], []), "unknown_cluster"),
    (("merge", [1, 2], [("A", "B")], []), "clusters_not_reduced"),
    (("bridge", [2, 3], [("S", "X"), ("T", "X")], []), None),
    (("merge", [1], [("S", "R")], []), "wrong_arity"),
    (("prune", [1, 2], [], ["D"]), "wrong_arity"),
    (("prune", [3], [], ["D", "T"]), None),
])
def test_operations(spark, scratch, op, error):
    onto = split_ontology(spark)
    clusters = H.find_isolated_clusters(onto, scratch)
    row = ops(spark, [op]).first()
    assert H.operation_error(onto, row, clusters, scratch) == error


def test_prune_cleans_properties(spark, scratch):
    row = ops(spark, [("prune", [3], [], ["D", "T"])]).first()
    out = H.apply_operation(split_ontology(spark), row)
    assert {tuple(r)[:2] for r in out.subclass_of.select("subclass", "superclass").collect()} == set(SPLIT[:3])
    left = {r["name"]: (r["domain"], r["range"]) for r in out.object_properties.collect()}
    assert left == {"p": (["A", "A"], ["R"])}  # repeats and order stay
    assert out.data_properties.isEmpty() and out.classes.count() == 7
    assert H.apply_prune(split_ontology(spark), local_table(spark, [("D",)], "class_name string"),
                         drop_class=True).classes.count() == 6


def test_fix_makes_one_piece(spark, scratch):
    fixed, history = H.fix_ontology(split_ontology(spark), scratch)
    assert H.find_isolated_clusters(fixed, scratch).isEmpty() and history.count() == 2
    scripted = ops(spark, [("merge", [1, 9], [("S", "R")], []), ("merge", [1, 2], [("S", "R")], []),
                           ("prune", [2], [], ["D", "T"])])
    fixed, history = H.fix_ontology(split_ontology(spark), scratch, scripted)
    assert [r["error"] for r in history.orderBy("op_seq").collect()] == ["unknown_cluster", None, None]
    assert H.find_isolated_clusters(fixed, scratch).isEmpty()


def test_fix_prunes_small_clusters(spark, scratch):
    onto = split_ontology(spark)
    sizes = {r["cluster_index"]: r["count"] for r in H.find_isolated_clusters(onto, scratch).groupBy("cluster_index").count().collect()}
    fixed, history = H.fix_ontology(onto, scratch, prune_below=max(n for i, n in sizes.items() if i > 1))
    assert {r["op"] for r in history.collect()} == {"prune"} and history.count() == len(sizes) - 1
    assert H.find_isolated_clusters(fixed, scratch).isEmpty()
    assert fixed.subclass_of.count() < onto.subclass_of.count()


def test_catalog_ontology(spark):
    tables = {
        "nation": spark.createDataFrame([], "n_nationkey int, n_name string, n_regionkey int"),
        "region": spark.createDataFrame([], "r_regionkey int, r_opened timestamp"),
    }
    onto = O.ontology_from_tables(spark, tables, {("nation", "n_regionkey"): "region"})
    assert {r["name"] for r in onto.classes.collect()} == {"Thing", "Nation", "Region"}
    assert [(r["domain"], r["range"]) for r in onto.object_properties.collect()] == [(["Nation"], ["Region"])]
    assert {r["name"]: r["range"] for r in onto.data_properties.collect()}["r_opened"] == "xsd:dateTime"


def random_batches(spark, seed, n=9):
    """Batches over few names in both cases, so that verdicts hang on each other."""
    rng = random.Random(seed)
    names = [a + b for a in "ABCDEF" for b in ("", "x")] + ["Thing"]
    some = lambda: (lambda w: w.lower() if rng.random() < 0.06 else w)(rng.choice(names))
    rows = []
    for batch in range(n):
        for k in range(rng.randint(1, 3 if batch else 2)):
            name, at = some(), batch * 100 + k * 3
            rows.append((batch, at, "class", (name, None, None), None, None, None))
            if rng.random() < 0.8:
                above = "Thing" if rng.random() < 0.5 else some()
                rows.append((batch, at + 1, "subclass_relation", None, (some() if rng.random() < 0.2 else name, above), None, None))
        if rng.random() < 0.3:
            p = (f"p{rng.randrange(4)}", None, [some()], [some()] if rng.random() < 0.7 else [], [], None)
            rows.append((batch, batch * 100 + 60, "object_property", None, None, p, None))
        if rng.random() < 0.3:
            p = (f"p{rng.randrange(4)}", None, [some(), some()], "xsd:string", [], None)
            rows += [(batch, batch * 100 + 70, "data_property", None, None, None, p)] * rng.randint(1, 2)
    return spark.createDataFrame(
        rows, f"batch_id long, seq long, kind string, class {schemas.CLASS}, subclass_relation {schemas.RELATION}, "
        f"object_property {schemas.OBJECT_PROPERTY}, data_property {schemas.DATA_PROPERTY}")


@pytest.mark.parametrize("seed, given", [(2, False), (3, True)])
def test_batches_at_once_equal_one_by_one(spark, scratch, seed, given):
    onto = O.empty_ontology(spark)
    if given:
        onto = make_ontology(spark, "given", ["Thing", "A", "Bx"], [("A", "Thing"), ("Bx", "Thing"), ("Bx", "A")], [("p0", ["A"], ["Bx"])], [("p1", ["A"])])
        # The one-by-one rule takes rows in the order of seq, so the given ones come first.
        onto = O.Ontology("given", *[
            t.withColumn("seq", F.col("seq") - 10_000) for t in (onto.classes, onto.subclass_of, onto.object_properties, onto.data_properties)
        ])
    batches = random_batches(spark, seed)
    want, want_log = O.build_step_by_step(onto, batches, scratch)
    got, log = build_incremental(onto, batches, scratch)
    flat = lambda df: sorted(map(str, df.collect()))
    assert flat(log.select("batch_id", "valid", "n_issues")) == flat(want_log)
    for table in ("classes", "subclass_of", "object_properties", "data_properties"):
        assert flat(getattr(got, table).drop("seq")) == flat(getattr(want, table).drop("seq"))
    valid = [r["valid"] for r in log.collect()]
    assert any(valid) and not all(valid)


def test_no_batches_and_hot_keys(spark, scratch):
    none, log = build_incremental(O.empty_ontology(spark), random_batches(spark, 1).limit(0), scratch)
    assert log.isEmpty() and none.classes.isEmpty()
    batches = random_batches(spark, 5, 4)
    plain = build_incremental(O.empty_ontology(spark), batches, scratch)[1]
    split = build_incremental(O.empty_ontology(spark), batches, scratch, policy=TINY)[1]
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))


def test_running_total(spark, scratch):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 AS k", "id % 5 - 2 AS v").repartition(5)
    got = {r["k"]: r["total"] for r in running_total(rows, "k", "v", "total", scratch).collect()}
    values, total = {r["k"]: r["v"] for r in rows.collect()}, 0
    for k in sorted(values):
        total += values[k]
        assert got[k] == total
    assert running_total(rows.limit(0), "k", "v", "total", scratch).count() == 0


def test_delta_is_ordered_after_the_ontology(spark):
    first = make_ontology(spark, "a", ["Thing", "Other"], [("Other", "Thing")], [], [])
    delta = make_ontology(spark, "b", ["Alpha"], [("Alpha", "Thing")], [], [])
    both = O.extend(first, delta)
    assert [r["name"] for r in both.classes.orderBy("seq").collect()] == ["Thing", "Other", "Alpha"]
    assert both.classes.select("seq").distinct().count() == 3


def test_every_column_becomes_a_property(spark):
    table = spark.sql("select 1 as id, cast(1 as decimal(9,2)) as price, array(1) as tags, map('a', 1) as m, binary('x') as raw")
    onto = O.ontology_from_tables(spark, {"thing": table}, {})
    got = {r["name"]: r["range"] for r in onto.data_properties.collect()}
    assert got == {"id": "xsd:integer", "price": "xsd:float", "tags": "xsd:string", "m": "xsd:string", "raw": "xsd:string"}


def test_profile_merges_the_triples_of_an_object_before_its_type_is_asked(spark, scratch, monkeypatch):
    """Counts with copies, null and untyped objects; rows are looked up by subject only."""
    from kgspark.operators import ontology as O

    joined = []
    plain = O.lookup_join
    monkeypatch.setattr(O, "lookup_join", lambda left, right, key, *a, **k: joined.append(key) or plain(left, right, key, *a, **k))
    triples = spark.createDataFrame(
        [("a", "likes", "hub")] * 3 + [("b", "likes", "hub"), ("c", "likes", "a"), ("a", "named", "A"), ("b", "named", None), ("x", "likes", "hub")],
        "subject string, predicate string, object string",
    )
    types = spark.createDataFrame([("a", "P"), ("b", "P"), ("c", "Q"), ("hub", "H")], "subject string, class_name string")
    for distinct, n in ((False, 4), (True, 2)):
        rows = {tuple(r) for r in O.induced_properties(triples, types, scratch, distinct).collect()}
        assert rows == {("likes", "P", "H", n), ("likes", "Q", "P", 1), ("named", "P", None, 2)}
    assert joined == ["subject", "subject"]


def test_no_join_of_the_batches_is_broadcast(spark, scratch):
    """Their tables grow with the batches and the joins are many, so that broadcasts would add up in the driver."""
    from kgspark.operators.incremental import _Facts

    batches = scratch.save(random_batches(spark, 2, 4), "batches")
    facts = _Facts(O.empty_ontology(spark), batches, scratch, SkewPolicy())
    state = scratch.save(facts.ids.select("batch_id", F.lit(True).alias("valid")), "state")
    judged = facts.judge(facts.states(state), None)
    again = facts.judge(facts.states(state), facts.ids)
    for df in (judged, again, facts.added(facts.classes, state)):
        assert "SortMergeJoin" in plan_of(df) and "Broadcast" not in plan_of(df)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
