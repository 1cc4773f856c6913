"""Operators on texts against plain restatements, on awkward small tables."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from kgspark.llm import (
    anchors, decontaminate, host_rules, near_dup, suffix_automaton, suffix_tree, toxicity,
)

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "tid string, key string, spans string, items string, `_key` int, host int, words int"
)


def frame(spark, rows, schema=SCHEMA):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(i, t, "en", None if i is not None and i % 7 == 3 else "h", 0, "x", "x", "x", "x", 1, 2, 3) for i, t in rows],
        schema,
    )


def awkward(seed=1, n=60):
    """Texts with shared passages, copies, repeats, runs of one word, nulls and a long text."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["Été", "ß", "日本", "a#b", "&"]
    some = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passages = [some(rng.randint(8, 60)) for _ in range(5)]
    rows = [(0, None), (1, ""), (2, "  \t\n "), (3, "one"), (4, "One"), (5, "a " * 90), (6, some(6000))]
    for i in range(7, n):
        parts = [some(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), some(rng.randint(0, 12))]
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    rows += [(n, rows[10][1]), (n + 1, rows[10][1]), (n + 2, rows[12][1] + " end")]
    return rows


def collect(df, columns):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_decontamination(spark, scratch, block_bytes):
    rows = awkward()
    words = rows[8][1].split()
    items = [(1, " ".join(words[3:30])), (2, rows[9][1]), (2, rows[9][1]), (30, "ONE"), (4, None), (5, ""), (6, "w1 w2 w3")]
    items += [(7, "W3, w4; w5"), (8, " ".join(words[3:30]))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.find_contamination(frame(spark, rows), benchmark, scratch, block_bytes=block_bytes)
    want = sorted(brute.contaminated(rows, items))
    assert collect(decontaminate.digest(found), "doc_id n_words n_hit n_items items_sha256 contaminated".split()) == want
    assert sum(w[5] for w in want) > 3


def test_decontamination_of_empty_tables(spark, scratch):
    none = spark.createDataFrame([], "item_id bigint, text string")
    found = decontaminate.find_contamination(frame(spark, [(1, "a b"), (None, "c")]), none, scratch)
    assert {(r["doc_id"], r["n_words"], r["n_hit"]) for r in found.collect()} == {(1, 2, 0), (None, 1, 0)}
    assert decontaminate.find_contamination(frame(spark, []), none, scratch).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=60), st.lists(st.integers(1, 6), min_size=1, max_size=4))
def test_wu_manber_finds_all(text, sizes):
    text = [w.encode() for w in text]
    for m in sizes:
        searcher = decontaminate.WuManber(m)
        strings = {tuple(text[i:i + m]) for i in range(0, len(text) - m + 1, 3)} | {(b"z",) * m}
        for s in strings:
            searcher.add(list(s), [str(s)])
        want = [(i, [str(tuple(text[i:i + m]))]) for i in range(len(text) - m + 1) if tuple(text[i:i + m]) in strings]
        assert sorted(searcher.find(text)) == want


@pytest.mark.parametrize("max_group", [8192, 2])
def test_byte_dedup(spark, scratch, max_group):
    rows = awkward(2)
    got = suffix_tree.dedup_bytes(frame(spark, rows), scratch, window=100, max_group=max_group)
    want = sorted(brute.dedup_bytes(rows, 100))
    assert collect(suffix_tree.digest(got), "doc_id n_bytes n_removed n_spans kept_sha256".split()) == want
    assert any(0 < w[2] < w[1] for w in want)


@pytest.mark.parametrize("max_group", [8192, 2])
def test_word_dedup(spark, scratch, max_group):
    rows = awkward(3)
    got = suffix_automaton.dedup_words(frame(spark, rows), scratch, window=12, max_group=max_group)
    want = sorted(brute.dedup_words(rows, 12))
    assert collect(suffix_automaton.digest(got), "doc_id n_words n_removed kept_sha256".split()) == want
    assert any(0 < w[2] < w[1] for w in want)


def test_hot_passage_is_split(spark, scratch):
    """One passage in many different surroundings: a hot anchor, split until groups are small."""
    rng = random.Random(5)
    passage = " ".join("p%d" % rng.randrange(1000) for _ in range(20))
    other = lambda k: " ".join("x%d" % rng.randrange(100000) for _ in range(k))
    rows = [(i, f"{other(rng.randint(0, 15))} {passage} {other(rng.randint(0, 15))}") for i in range(120)]
    got = suffix_automaton.dedup_words(frame(spark, rows), scratch, window=12, max_group=10)
    assert collect(suffix_automaton.digest(got), "doc_id n_words n_removed kept_sha256".split()) == sorted(brute.dedup_words(rows, 12))


def test_dedup_of_empty_table_and_null_ids(spark, scratch):
    assert suffix_automaton.dedup_words(frame(spark, []), scratch).count() == 0
    rows = [(None, "a b c d"), (None, "a b c d"), (1, "a b c")]
    got = suffix_tree.dedup_bytes(frame(spark, rows), scratch, window=5)
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got.collect()) == [("1", 5), ("None", 7), ("None", 7)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=6), st.text("ab", min_size=1, max_size=6)), min_size=2, max_size=9, unique=True))
def test_interval_tree_covers_what_pairs_share(contexts):
    """Spans by the tree equal spans by all pairs of members."""
    contexts = [(a.encode(), b.encode()) for a, b in contexts]
    window = 4

    def covered(spans):
        return {(i, at) for i, left, right in spans for at in range(-left, right)}

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    want = []
    for i, (a, b) in enumerate(contexts):
        for j, (c, d) in enumerate(contexts):
            left, right = common(a[::-1], c[::-1]), common(b, d)
            if i != j and right and left + right >= window:
                want.append((i, left, right))
    got = [(i, left, right) for left, right, members in suffix_tree.maximal_repeats(contexts, window) if right for i in members]
    assert covered(got) == covered(want)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", max_size=12), min_size=1, max_size=4))
def test_automaton_counts(texts):
    sequences = [[c.encode() for c in t] for t in texts]
    automaton = suffix_automaton.SuffixAutomaton(sequences)
    for s in sequences:
        runs = dict((end, start) for start, end in automaton.repeated(s, 1))
        for end in range(1, len(s) + 1):
            best = next((a for a in range(end) if sum(
                q[k:k + end - a] == s[a:end] for q in sequences for k in range(len(q) - (end - a) + 1)) > 1), None)
            assert runs.get(end) == best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=12, max_size=80), st.integers(1, 10))
def test_equal_windows_have_one_anchor(symbols, gram):
    units = anchors.mix(np.array(symbols, np.uint64) + np.uint64(9))
    seen, windows = {}, 0
    for keys, places, first, last in anchors.anchors(units, 12, gram):
        for key, at, a, b in zip(keys.tolist(), places.tolist(), first.tolist(), last.tolist()):
            for start in range(a, b + 1):
                windows += 1
                assert seen.setdefault(tuple(symbols[start:start + 12]), (key, at - start)) == (key, at - start)
    assert windows == len(symbols) - 11


def test_quality_figures(spark, scratch):
    rows = awkward(4) + [(90, "a b c d e a b c d e f g\n\nx\nx\n x\n"), (91, "#*$ %& |<> ok"), (92, "é" * 30)]
    got = host_rules.judge(frame(spark, rows), scratch)
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert collect(got, columns) == sorted(brute.quality(rows))
    assert not [r for r in got.collect() if r["base_failed"] and r["kept"]]


def test_host_verdicts(spark, scratch):
    """A host that mostly fails takes its good documents along; one bad document of a small host does not."""
    good = "these are ten different good words for one whole text"
    rows = [(i, good if i % 10 == 0 else "x", "bad") for i in range(200)]
    rows += [(200 + i, "x" if i % 10 == 0 else good, "good") for i in range(200)]
    rows += [(500, "x", "tiny"), (501, good, "tiny"), (502, good, "tiny"), (600, good, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r["doc_id"] for r in host_rules.judge(docs, scratch).where("kept").collect()}
    assert kept == {200 + i for i in range(200) if i % 10} | {501, 502, 600}
    assert host_rules.judge(docs.limit(0), scratch).count() == 0


def test_near_duplicates(spark, scratch, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rng = random.Random(6)
    rows = awkward(5)
    for base in range(6):
        words = ["b%d_%d" % (base, i) for i in range(rng.randint(5, 90))]
        for k in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "c%d" % rng.randrange(10**6)
            rows.append((100 + base * 20 + k, " ".join(copy).upper() if k == 5 else " ".join(copy)))
    got = near_dup.near_duplicates(frame(spark, rows), scratch)
    want = sorted(brute.near_duplicates(rows))
    assert collect(got, "doc_id n_shingles component_id kept".split()) == want
    assert sum(not w[3] for w in want) > 30


def test_near_duplicates_of_awkward_rows(spark, scratch):
    rows = [(None, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, "A B c d e"), (4, None), (5, "")]
    got = near_dup.near_duplicates(frame(spark, rows), scratch).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [
        ("2", "2", True), ("2", "2", True), ("3", "2", False), ("4", "4", True), ("5", "5", True), ("None", "None", True),
    ]
    assert near_dup.near_duplicates(frame(spark, []), scratch).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.integers(20, 400), st.integers(0, 200), st.integers(0, 1000))
def test_estimate_never_excludes_similar_sets(n, changed, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    keep = a[: max(1, len(a) - min(changed, n // 10))]
    b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, len(a) - len(keep), dtype=np.uint64)]))
    if near_dup.similar(a, b, 80):
        assert near_dup.may_reach(near_dup.registers(a), near_dup.registers(b), len(a), len(b), 80)


def toxic_rows():
    """Insults are toxic; a mild word is so only next to a group's name."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        words = ["n%d" % rng.randrange(60) for _ in range(rng.randint(5, 30))]
        kind = i % 5
        if kind == 0:
            words.insert(rng.randrange(len(words)), "Insult" + rng.choice(["", "ing", "er"]))
        words += {1: ["mild", "group"], 2: ["mild"], 3: ["group"]}.get(kind, [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(kind in (0, 1))))
    return rows


def test_toxicity_learns_words_and_pairs(spark):
    rows = toxic_rows()
    docs = frame(spark, [r[:2] for r in rows] + [(5000, None), (5001, ""), (None, "insult")])
    labels = spark.createDataFrame(
        [(i, 1 if i % 4 else t, t) for i, _, t in rows] + [(None, 1, 1), (77777, 0, 1)], "doc_id bigint, quality int, toxic int"
    )
    got = {r["doc_id"]: r for r in toxicity.judge(docs, labels).collect()}
    right = [got[i]["predicted"] == t for i, _, t in rows if got[i]["held_out"]]
    assert len(right) > 150 and sum(right) / len(right) > 0.97
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[5000]["score"] == got[5001]["score"] and got[None]["predicted"] == 1


def test_toxicity_learns_rare_pairs():
    """Two words of 2 % of the documents each, whose own shares of toxic documents say nothing."""
    rng = random.Random(11)
    base, rows, labels = ["n%d" % i for i in range(300)], [], []
    for i in range(3000):
        words = rng.sample(base, rng.randint(20, 60))
        kind = i % 100
        words += {0: ["mild", "group"], 1: ["mild"], 2: ["group"]}.get(kind, [])
        toxic = kind == 0 or 3 <= kind < 50 and rng.random() < 0.9
        rows.append(np.array([t for w in words + ["insult"] * (toxic and kind > 0) for t in toxicity.terms(w.encode())], np.int32))
        labels.append(int(toxic))
    labels = np.array(labels, np.int8)
    place = lambda w: toxicity.terms(w.encode())[0]
    for word in ("mild", "group"):
        has = np.array([place(word) in r for r in rows])
        share = labels.mean()
        assert has.mean() == 0.02 and abs(labels[has].sum() - has.sum() * share) < 4 * (has.sum() * share * (1 - share)) ** 0.5
    machine = toxicity.fit(rows, labels, labels.mean())
    table = machine.table().astype(float)

    def chance(text):
        w, squares, *s = table[[t for x in text.split() for t in toxicity.terms(x.encode())]].sum(0)
        return 1 / (1 + np.exp(-(machine.bias + w + 0.5 * (sum(f * f for f in s) - squares))))

    assert chance("n1 n2 mild group") > 0.5 > toxicity.THRESHOLD > max(chance("n1 n2 mild"), chance("n1 n2 group"))


def test_toxicity_ignores_held_out_labels(spark):
    rows = toxic_rows()[:300]
    docs = frame(spark, [r[:2] for r in rows])
    marked = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int")
    held = {r["doc_id"] for r in docs.where(toxicity.held_out()).collect()}
    other = spark.createDataFrame([(i, 1 - t if i in held else t) for i, _, t in rows], "doc_id bigint, toxic int")
    a, b = toxicity.train(docs, marked), toxicity.train(docs, other)
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.vectors == b.vectors).all()


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.judge(frame(spark, [(1, "a")]), none).collect()
    assert got[0]["predicted"] == 0 and toxicity.judge(frame(spark, []), none).count() == 0
