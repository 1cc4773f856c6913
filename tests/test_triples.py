"""Validation against the hand fixtures and a sequential restatement of the rules."""

import random
import re

import pytest

from kgspark.operators import triples as T
from kgspark.plans.star import make_ontology
from kgspark.skew import SkewPolicy
from kgspark.sources import mapping as M
from kgspark.storage import local_table, path_exists

COLUMNS = "subject string, predicate string, object string, batch_id long, seq long"
CLEAN = [
    ("jane", "isA", "Writer"), ("paris", "isA", "Place"), ("emma", "isA", "Book"),
    ("emma", "hasAuthor", "jane"), ("jane", "bornIn", "paris"), ("emma", "hasTitle", "Emma"),
]


def frame(spark, batches):
    rows = [(s, p, o, b, q) for b, batch in batches.items() for q, (s, p, o) in enumerate(batch)]
    return local_table(spark, rows, COLUMNS)


def codes(judged):
    return {(r["batch_id"], r["seq"]): r["error_code"] for r in judged.collect()}


CASES = [
    ([("jane", "isA", "Place")], ["isa_reclassified"]),
    ([("Bad", "isA", "Writer"), ("Bad", "isA", "Place")], [None, "isa_not_snake_case"]),
    ([("rex", "isA", "Dog")], ["isa_unknown_class"]),
    ([("person", "isA", "Thing")], ["isa_subject_is_class"]),
    ([("emma", "likes", "jane")], ["unknown_property"]),
    ([("ghost", "bornIn", "paris")], ["subject_untyped"]),
    ([("emma", "hasTitle", "Place")], ["object_is_class"]),
    ([("Bad", "isA", "Writer"), ("Bad", "bornIn", "paris")], [None, "subject_not_snake_case"]),
    ([("jane", "bornIn", "nowhere")], ["object_untyped"]),
    ([("jane", "bornIn", "emma")], ["domain_range_mismatch"]),
    ([("Oslo", "isA", "Place"), ("jane", "bornIn", "Oslo")], [None, "object_not_snake_case"]),
    ([("tom", "isA", "Person"), ("tom", "isA", "Writer")], [None, None]),
    ([("sam", "isA", "person"), ("sam", "isA", "person")], [None, "isa_reclassified"]),
    ([("emma", "hasTitle", "Emma")], [None]),
]


def own_world(batch, i):
    """The entities of a batch under names of their own; class names stay."""
    mine = {"jane", "paris", "emma", "rex", "ghost", "tom", "sam", "Bad", "Oslo", "nowhere"}
    name = lambda x: f"{x}_{i}" if x in mine else x
    return [(name(s), p, name(o)) for s, p, o in batch]


@pytest.mark.parametrize("mode", ["row", "batch"])
def test_every_rule_code(spark, base, scratch, mode):
    batches = {}
    for i, (case, _) in enumerate(CASES):
        batches[2 * i], batches[2 * i + 1] = own_world(CLEAN, i), own_world(case, i)
    rows = frame(spark, batches)
    if mode == "row":
        judged = T.validate(rows, base, scratch)
    else:
        judged, verdicts = T.accept_batches(rows, base, scratch)
        expected = {2 * i: True for i in range(len(CASES))}
        expected |= {2 * i + 1: all(c is None for c in codes) for i, (_, codes) in enumerate(CASES)}
        assert {r["batch_id"]: r["accepted"] for r in verdicts.collect()} == expected
    found = codes(judged)
    for i, (case, expected) in enumerate(CASES):
        assert [found[(2 * i + 1, q)] for q in range(len(case))] == expected, case
        assert all(found[(2 * i, q)] is None for q in range(len(CLEAN)))


def test_typed_class_as_subject(spark, base, scratch):
    prior = frame(spark, {0: [("Book", "isA", "Book")]})
    judged = T.validate(frame(spark, {1: [("Book", "hasTitle", "x")]}), base, scratch, prior)
    assert codes(judged) == {(1, 0): "subject_is_class"}


def test_known_triples_are_not_judged(spark, base, scratch):
    prior = frame(spark, {0: CLEAN})
    again = frame(spark, {1: CLEAN + [("jane", "bornIn", "emma")]})
    assert codes(T.validate(again, base, scratch, prior)) == {(1, 6): "domain_range_mismatch"}


def test_no_ontology_accepts_all(spark, scratch):
    rows = frame(spark, {0: [("X", "y", "Z")]})
    assert codes(T.validate(rows, None, scratch)) == {(0, 0): None}


def test_transitive_closure_is_wider(spark, base, scratch):
    from dataclasses import replace

    from kgspark.plans.star import make_ontology

    wide = make_ontology(spark, "w", [], [], [("near", ["Thing"], ["Thing"])], []).object_properties
    onto = replace(base, object_properties=wide)
    rows = frame(spark, {0: [("jane", "isA", "Writer"), ("bob", "isA", "Person"), ("jane", "near", "bob")]})
    assert codes(T.validate(rows, onto, scratch))[(0, 2)] == "domain_range_mismatch"
    assert codes(T.validate(rows, onto, scratch, closure="transitive"))[(0, 2)] is None


# ------------------------------------------------- sequential restatement

CLASSES = ["Thing", "Person", "Writer", "Place", "Book"]
PARENTS = {"Person": "Thing", "Writer": "Person", "Place": "Thing", "Book": "Thing"}
LINKS = {"hasAuthor": ({"Book"}, {"Person"}), "bornIn": ({"Person"}, {"Place"})}


def is_class(name):
    return name.lower() in {c.lower() for c in CLASSES}


def up(name):
    return {name, PARENTS.get(name, name)} if name in CLASSES else set()


def snake(name):
    return re.fullmatch(r"[a-z0-9]+(_[a-z0-9]+)*", name) is not None


def isa_verdict(s, o, typed):
    if s in typed:
        return None if typed[s] in up(o) else "isa_reclassified" if snake(s) else "isa_not_snake_case"
    return "isa_unknown_class" if not is_class(o) else "isa_subject_is_class" if is_class(s) else None


def fact_verdict(s, p, o, typed):
    tests = [
        ("unknown_property", p not in LINKS and p != "hasTitle"),
        ("subject_untyped", s not in typed),
        ("subject_is_class", is_class(s)),
        ("object_is_class", is_class(o)),
        ("subject_not_snake_case", not snake(s)),
    ]
    if p in LINKS:
        domain, rng = LINKS[p]
        tests += [
            ("object_untyped", o not in typed),
            ("domain_range_mismatch", not (up(typed.get(s, "")) & domain and up(typed.get(o, "")) & rng)),
            ("object_not_snake_case", not snake(o)),
        ]
    return next((code for code, fails in tests if fails), None)


def sequential(batches, whole):
    """Judge batches in order; ``whole`` rejects a batch with any error."""
    kg, first_type, verdicts, accepted = set(), {}, {}, {}
    for b in sorted(batches):
        rows = [(q, t) for q, t in enumerate(batches[b]) if t not in kg]
        typed = dict(first_type)
        for q, (s, p, o) in rows:
            if p == "isA":
                verdicts[(b, q)] = isa_verdict(s, o, typed)
                if verdicts[(b, q)] is None:
                    typed.setdefault(s, o)
        for q, (s, p, o) in rows:
            if p != "isA":
                verdicts[(b, q)] = fact_verdict(s, p, o, typed)
        good = [t for q, t in rows if verdicts[(b, q)] is None]
        accepted[b] = len(good) == len(rows)
        if accepted[b] or not whole:
            kg.update(good)
            first_type = typed
    return kg, verdicts, accepted


def random_batches(rng, n_batches):
    names = ["a", "b", "c", "d_e", "Bad", "person", "Book"]
    objects = ["Person", "Writer", "Place", "Book", "Thing", "writer", "Dog"]

    def triple():
        if rng.random() < 0.45:
            return rng.choice(names), "isA", rng.choice(objects)
        return rng.choice(names), rng.choice(["hasAuthor", "bornIn", "hasTitle", "likes"]), rng.choice(names)

    return {b: [triple() for _ in range(rng.randint(1, 3))] for b in range(n_batches)}


def worlds(seed, count, n_batches):
    """Independent random graphs in one table: names carry the world's number."""
    rng = random.Random(seed)
    return [random_batches(rng, n_batches) for _ in range(count)]


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(min_rows=2, rows_per_split=1, sample=1.0)])
def test_equals_sequential(spark, base, scratch, whole, policy):
    rules = T.prepare_rules(base, scratch)
    for world in worlds(3 if whole else 5, 1, 40):
        kg, verdicts, accepted = sequential(world, whole)
        rows = frame(spark, world)
        if whole:
            judged, batches = T.accept_batches(rows, rules, scratch, policy=policy)
            assert {r["batch_id"]: r["accepted"] for r in batches.collect()} == accepted
            got = T.accepted_batch_triples(judged, batches)
        else:
            judged = T.validate(rows, rules, scratch, policy=policy)
            found = codes(judged)
            assert {k: found[k] for k in verdicts} == verdicts
            got = T.accumulate(T.accepted(judged))
        assert {tuple(r) for r in got.collect()} == kg


def test_batches_are_settled_on_few_rows(spark, base, scratch, monkeypatch):
    """Uses of entities that one batch defines come down to that batch; no table of all rows is written."""
    people = [(f"p_{i}", "isA", "Writer") for i in range(5)]
    batches = {0: people, 1: [("nobody", "isA", "Dog"), ("paris", "isA", "Place")]}
    for b in range(2, 5):
        books = [(f"book_{b}", "isA", "Book")] + [(f"book_{b}", "hasAuthor", f"p_{i % 5}") for i in range(60)]
        batches[b] = books + ([("p_1", "bornIn", "paris")] if b == 3 else [])
    written = []
    save = type(scratch).save
    monkeypatch.setattr(type(scratch), "save", lambda self, df, name="t": written.append(save(self, df, name)) or written[-1])
    _, verdicts = T.accept_batches(frame(spark, batches), base, scratch)
    assert {r["batch_id"]: r["accepted"] for r in verdicts.collect()} == {0: True, 1: False, 2: True, 3: False, 4: True}
    assert max(t.count() for t in written if path_exists(spark, t._scratch_path)) < 60


def test_batches_without_ids_or_entities(spark, base, scratch):
    rows = [
        ("jane", "isA", "Writer", 0, 0), ("emma", "isA", "Book", 0, 1), (None, "isA", "Book", 1, 0),
        (None, "hasAuthor", "jane", 1, 1), (None, "hasAuthor", "jane", 2, 0), ("paris", "isA", "Place", None, 0),
        ("emma", "hasAuthor", "paris", None, 1), ("emma", None, "jane", 3, 0),
    ]
    _, verdicts = T.accept_batches(local_table(spark, rows, COLUMNS), base, scratch)
    assert {r["batch_id"]: r["accepted"] for r in verdicts.collect()} == {0: True, 1: False, 2: False, None: False}


def test_accepted_graph_validates_again(spark, base, scratch):
    rows = frame(spark, worlds(11, 1, 40)[0])
    kept = T.accepted(T.validate(rows, base, scratch))
    assert T.rejected(T.validate(kept, base, scratch)).isEmpty()


def test_accumulate_is_idempotent_and_free_of_order(spark):
    rows = frame(spark, worlds(5, 1, 20)[0])
    once = {tuple(r) for r in T.accumulate(rows).collect()}
    assert once == {tuple(r) for r in T.accumulate(rows, rows.orderBy("object")).collect()}
    assert T.accumulate(rows, rows).count() == len(once)


def test_digraph_keeps_last_label(spark):
    rows = frame(spark, {0: [("a", "p1", "b")], 1: [("a", "p2", "b"), ("b", "p1", "a")]})
    got = {tuple(r) for r in T.to_digraph_edges(rows).collect()}
    assert got == {("a", "b", "p2"), ("b", "a", "p1")}


def test_parse_replies(spark):
    replies = spark.createDataFrame([
        (1, '[{"subject":"a","predicate":"p","object":"b"},{"subject":"c","predicate":"p","object":"d"}]'),
        (2, "[]"), (3, "null"), (4, '[{"subject":"a"'), (5, '[{"subject":"a","predicate":"p"}]'), (6, None),
    ], "request_id long, response string")
    rows, bad = T.parse_triples(replies)
    assert [tuple(r) for r in rows.orderBy("seq").collect()] == [("a", "p", "b", 1, 0), ("c", "p", "d", 1, 1)]
    assert {r["request_id"] for r in bad.collect()} == {4, 5, 6}


def test_epochs_stop_when_nothing_is_new(spark, base, scratch):
    seen = []

    def extract(kg, epoch):
        seen.append(kg.count())
        return frame(spark, {0: CLEAN[: 3 if epoch == 0 else 6]})

    kg, progress = T.run_epochs(extract, frame(spark, {}), base, scratch, epochs=9)
    assert seen == [0, 3, 6] and kg.count() == 6
    totals = {(r["epoch"], r["new_triples"], r["total"]) for r in T.epoch_totals(progress).collect()}
    assert totals == {(0, 3, 3), (1, 3, 6)}


@pytest.mark.parametrize("mode", ["row", "batch"])
def test_epochs_reject_rows_or_batches(spark, base, scratch, mode):
    """A bad row takes its batch along in batch mode; the total counts up by batch."""
    def extract(kg, epoch):
        bad = ("rex", "isA", "Dog")
        return frame(spark, {0: CLEAN[:2], 1: [("mia", "isA", "Person"), bad], 2: [("ann", "isA", "Person")]})

    kg, progress = T.run_epochs(extract, frame(spark, {}), base, scratch, epochs=2, mode=mode)
    mia = 0 if mode == "batch" else 1
    got = {(r["batch_id"], r["new_triples"], r["total"]) for r in progress.where("epoch = 0").collect()}
    assert got == {(0, 2, 2), (1, mia, 2 + mia), (2, 1, 3 + mia)}
    assert kg.count() == 3 + mia


def test_type_of_first_epoch_stays(spark, scratch):
    onto = make_ontology(
        spark, "o", ["Thing", "Person", "Employee", "Manager"],
        [("Person", "Thing"), ("Employee", "Person"), ("Manager", "Person")], [], [],
    )
    steps = [{5: [("x", "isA", "Person")]}, {0: [("x", "isA", "Employee")]}, {0: [("x", "isA", "Manager")]}]
    kg, _ = T.run_epochs(lambda kg, e: frame(spark, steps[e]), frame(spark, {}), onto, scratch)
    assert {r["object"] for r in kg.collect()} == {"Person", "Employee", "Manager"}


def test_text_rules_give_rows_to_validate(spark, base, scratch):
    docs = spark.createDataFrame([(1, "by Jane Roe and by Max", '{"title": "x", "year": "1"}'), (2, "none", None)], "id long, text string, props string")
    people = M.triples_from_pattern(docs, "concat('book_', id)", "text", "hasAuthor", "by ([A-Z][a-z]+)", "id")
    props = M.triples_from_json(docs, "concat('book_', id)", "props", "id")
    rows = M.triples_from_tables([people, props])
    assert {tuple(r) for r in rows.collect()} == {
        ("book_1", "hasAuthor", "jane", 1, 0), ("book_1", "hasAuthor", "max", 1, 1),
        ("book_1", "hasTitle", "x", 1, 0), ("book_1", "hasYear", "1", 1, 1),
    }
    prior = frame(spark, {0: [("book_1", "isA", "Book"), ("jane", "isA", "Person")]})
    judged = T.validate(rows, base, scratch, prior=prior).collect()
    assert {(r["object"], r["error_code"]) for r in judged} == {
        ("jane", None), ("max", "object_untyped"), ("x", None), ("1", "unknown_property"),
    }


def test_a_stopped_run_goes_on_behind_its_last_pass(spark, base, scratch, tmp_path):
    """Stopped while a pass is extracted, and while one is published; committed passes are not asked again."""
    steps = [{0: [("jane", "isA", "Writer")]}, {1: [("emma", "isA", "Book")]}, {2: [("emma", "hasAuthor", "jane")]}, {}]
    asked, path = [], str(tmp_path / "run")

    def extract(kg, epoch, fail_at=None):
        asked.append((epoch, kg.count()))
        if epoch == fail_at:
            raise RuntimeError("stopped")
        return frame(spark, steps[epoch])

    run = lambda fail_at=None: T.run_epochs(
        lambda kg, e: extract(kg, e, fail_at), frame(spark, {}), base, scratch, epochs=9, path=path)
    with pytest.raises(RuntimeError):
        run(fail_at=2)
    assert asked == [(0, 0), (1, 1), (2, 2)]
    # The third pass is there in part: its triples are written, its progress is not.
    frame(spark, {7: [("half", "isA", "Book")]}).write.parquet(f"{path}/epoch=2")
    asked.clear()
    kg, progress = run()
    assert asked == [(2, 2), (3, 3)]
    whole, whole_progress = T.run_epochs(lambda kg, e: frame(spark, steps[e]), frame(spark, {}), base, scratch, epochs=9)
    flat = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert flat(kg) == flat(whole) and flat(progress) == flat(whole_progress)
    assert flat(spark.read.parquet(path).where("epoch >= 0")) == flat(whole.where("epoch >= 0"))
    asked.clear()
    again, _ = run()  # a finished run only reads
    assert asked == [] and flat(again) == flat(whole)


@pytest.mark.parametrize("hot", [False, True])
def test_packed_join_carries_keys_once_and_nulls_are_equal(spark, hot):
    from kgspark.skew import NO_HOT_KEYS, SkewPolicy, packed_join

    policy = SkewPolicy(min_rows=2, rows_per_split=1, sample=1.0)
    left = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1), (4, None, 1), (5, "c", 2)], "id long, k string, b long")
    right = spark.createDataFrame([("a", None, "x"), (None, 1, "y"), ("c", 3, "z")], "k string, b long, v string")
    with_hot = None if hot else NO_HOT_KEYS
    met = packed_join(left, right, ["k", "b"], policy=policy, hot=with_hot)
    assert met.columns == ["id", "k", "b", "v"]
    assert {(r["id"], r["k"], r["b"], r["v"]) for r in met.collect()} == {
        (1, "a", None, "x"), (2, "a", None, "x"), (3, "b", 1, None), (4, None, 1, "y"), (5, "c", 2, None),
    }
    rest = packed_join(left, right.select("b", "k"), ["k", "b"], "left_anti", policy, with_hot)
    assert rest.columns == left.columns and {r["id"] for r in rest.collect()} == {3, 5}


def test_a_graph_that_is_a_set_is_not_merged_again(spark, scratch, monkeypatch):
    """Passes ask for new triples without merging copies in the graph; other callers' graphs may have some."""
    known = [("a", "isA", "Place"), ("b", "p", "x")]
    rows = frame(spark, {0: known + [("c", "p", "x"), ("c", "p", "x")]})
    for is_set, kg in ((True, known), (False, known * 2)):
        fresh = T.new_triples(rows, frame(spark, {0: kg}), is_set=is_set)
        assert [r["subject"] for r in fresh.collect()] == ["c", "c"]
    told = []
    plain = T.new_triples
    monkeypatch.setattr(T, "new_triples", lambda *a: told.append(a[3]) or plain(*a))
    start = frame(spark, {0: known * 2})
    for empty in (start.limit(0), start):
        T.run_epochs(lambda kg, epoch: rows, empty, None, scratch, epochs=3)
    # Begun empty: the second pass. Begun with a graph that has copies: both passes.
    assert told == [True, False, False]


def test_only_predicates_of_the_graph_are_asked_for(spark, monkeypatch):
    """Rows with another predicate are new and not joined; nulls are equal; many predicates are asked for as a whole."""
    rows = [("a", "p", "b"), ("a", "p", "b"), ("c", "p", "b"), ("a", "q", "b"), ("a", None, "b"), (None, "p", None)]
    graphs = [[("a", "p", "b")], [("a", None, "b"), (None, "p", None)], [("a", None, "b")], []]
    joined, plain = [], T.packed_join
    monkeypatch.setattr(T, "packed_join", lambda left, *a: joined.append(left.count()) or plain(left, *a))
    for most in (1000, 0):
        monkeypatch.setattr(T, "MANY_PREDICATES", most)
        for known in graphs:
            fresh = T.new_triples(frame(spark, {0: rows}), frame(spark, {0: known}))
            assert sorted(map(str, fresh.select(*T.SPO).collect())) == sorted(
                str(r) for r in frame(spark, {0: [r for r in rows if r not in known]}).select(*T.SPO).collect())
    assert joined == [4, 5, 1, 0, 6, 6, 6, 0]


@pytest.mark.parametrize("mode", ["row", "batch"])
def test_a_pass_leaves_only_what_it_found(spark, base, scratch, monkeypatch, mode):
    """Tables of a pass go with it, a written input is not written again, and batches need no verdict of each row."""
    raw = scratch.save(frame(spark, {0: CLEAN[:2], 1: [("mia", "isA", "Person"), ("rex", "isA", "Dog")], 2: CLEAN[2:6]}), "raw")
    written, save = [], type(scratch).save
    monkeypatch.setattr(
        type(scratch), "save", lambda self, df, name="t": written.append((name, save(self, df, name))) or written[-1][1])
    kg, progress = T.run_epochs(lambda kg, epoch: raw, raw.limit(0), base, scratch, epochs=3, mode=mode)
    left = {name for name, table in written if path_exists(spark, table._scratch_path)}
    assert left == {"kg", "found", "progress", "names", "properties", "supers"}
    assert "candidates" not in {name for name, _ in written} and raw.count() == 8
    assert ("judged" in {name for name, _ in written}) == (mode == "row")
    assert kg.count() == (6 if mode == "batch" else 7) and progress.where("epoch = 0").count() == 3
