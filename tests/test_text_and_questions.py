import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kgspark.operators import sampling as Q
from kgspark.operators.generate import number_chunks
from kgspark.operators import similarity
from kgspark.operators import text as X
from kgspark.operators.hierarchy import connected_components
from kgspark.rows import over_rows
from kgspark.skew import SkewPolicy, dense_index, hot_keys, lookup_join
from kgspark.storage import local_table, path_exists


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_chunks_keep_all_words(spark):
    text = " ".join(f"w{i}" for i in range(1030)) + "  \n "
    got = X.chunk_text(docs(spark, [text, "  ", "one"])).orderBy("id", "pos").collect()
    assert [(r["id"], len(r["text"].split())) for r in got] == [(0, 512), (0, 512), (0, 6), (2, 1)]
    assert " ".join(r["text"] for r in got if r["id"] == 0).split() == text.split()


def test_custom_tokenizer(spark):
    def halves(text, size):
        return [text[i : i + size] for i in range(0, len(text), size)]

    got = X.chunk_text(docs(spark, ["abcdef", "x    "]), chunk_size=4, tokenizer=halves)
    assert [(r["id"], r["text"]) for r in got.orderBy("id", "pos").collect()] == [(0, "abcd"), (0, "ef"), (1, "x   ")]


def test_gate_is_strict(spark):
    fits, over = "a " * 1024, "a " * 1024 + "b"
    counts = X.chunk_gate(docs(spark, [fits, over])).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in counts} == {0: 1, 1: 3}
    assert X.chunk_gate(docs(spark, [fits])).first()["text"] == fits


def test_batches_join_in_order(spark):
    got = X.batch_texts(docs(spark, list("abcde")), "id", "text", 2).orderBy("batch_id").collect()
    assert [r["text"] for r in got] == ["a\nb", "c\nd", "e"]


def test_texts_are_cut_once_before_they_are_numbered(spark, scratch):
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    texts = ["a " * 1024 + "b", "one", " ", "two"]
    rows = docs(spark, texts).select("id", F.udf(read).asNondeterministic()("text").alias("text"))
    got = number_chunks(rows, "id", "text", scratch, 512).orderBy("request_id").collect()
    assert [(r["request_id"], r["doc"], r["pos"]) for r in got] == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 0), (4, 3, 0)]
    assert " ".join(r["text"] for r in got).split() == " ".join(texts).split()
    assert seen.value == len(texts)


@pytest.mark.parametrize("n,rounds", [(1, 0), (6, 1), (7, 2), (36, 2), (37, 3)])
def test_merge_rounds(n, rounds):
    assert X.merge_rounds(n) == rounds


def test_tree_merge_equals_line_table(spark, scratch):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(37)]
    rows = docs(spark, texts).withColumn("g", F.lit("x"))
    rows = rows.unionByName(docs(spark, ["only"]).withColumn("g", F.lit("y")))
    merge = lambda parts: "\n".join(dict.fromkeys(line for p in parts for line in p.split("\n")))
    merged = {r["g"]: (r["text"], r["rounds"]) for r in X.tree_merge(rows, "g", "id", "text", merge, scratch).collect()}
    lines = X.merge_distinct_lines(rows, "g", "id", "text").where("g = 'x'").orderBy("doc_seq", "line_no")
    assert merged["x"] == ("\n".join(r["line"] for r in lines.collect()), 3)
    assert merged["y"] == ("only", 0)


def test_line_merge_holds_no_document(spark, scratch):
    rng = random.Random(2)
    texts = ["\n".join(f"{rng.randrange(9000):0100d}" for _ in range(90)) for _ in range(37)] + ["", None, "a\n"]
    rows = docs(spark, texts).withColumn("g", F.lit("x"))
    rows = rows.unionByName(docs(spark, ["only\nonly"]).withColumn("g", F.lit("y")))
    rows = rows.unionByName(docs(spark, [None, None]).withColumn("g", F.lit("z")))

    def merge(documents):
        lines, n = {}, 0
        for document in documents:
            lines.update(dict.fromkeys(document))
            n += 1
        assert 1 < n <= 6
        return iter(lines)

    pieces = X.tree_merge_lines(rows, "g", "id", "text", merge, scratch)
    merged = "\n".join(dict.fromkeys(line for t in texts if t is not None for line in t.split("\n")))
    big = pieces.where("g = 'x'").orderBy("pos").collect()
    assert [r["pos"] for r in big] == list(range(len(big))) and len(big) > 2 and {r["rounds"] for r in big} == {3}
    assert max(len(r["text"]) for r in big) < X.PIECE + 100 and "\n".join(r["text"] for r in big) == merged
    got = {r["g"]: (r["digest"], r["rounds"]) for r in X.joined_md5(pieces, "g", "pos", "text").collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == {"x": (md5(merged), 3), "y": (md5("only\nonly"), 0), "z": (None, 1)}


def test_quarantines(spark):
    kept, short = X.check_min_length(docs(spark, ["x" * 100, "x" * 99, None]), "text")
    assert kept.count() == 1 and short.count() == 2
    lists = spark.createDataFrame([(["a"],), ([],), (None,)], "items array<string>")
    kept, empty = X.check_non_empty_list(lists, "items")
    assert kept.count() == 1 and empty.count() == 2


def test_quota(spark):
    groups = spark.createDataFrame([("a", "high"), ("b", "low"), ("c", "medium")], "g string, priority string")
    slots = Q.expand_quota(groups).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in slots} == {"a": 3, "b": 1, "c": 2}
    quotas = Q.expand_quota(groups).select("g", "quota").distinct()
    replies = spark.createDataFrame(
        [("a", 1, i, f"p{i}") for i in range(9)] + [("c", 2, 0, "late"), ("c", 1, 5, "early")],
        "g string, round int, seq int, name string",
    )
    members, shortfall = Q.fill_quota(quotas, replies, "g")
    assert {r["name"] for r in members.collect()} == {"p0", "p1", "p2", "late", "early"}
    assert {tuple(r) for r in shortfall.collect()} == {("b", 1)}


def test_quota_of_any_size(spark):
    groups = spark.createDataFrame([("a", 5), ("b", 1)], "g string, quota int")
    replies = spark.createDataFrame([("a", 1, i, f"p{i}") for i in range(10)], "g string, round int, seq int, name string")
    members, shortfall = Q.fill_quota(groups, replies, "g")
    assert {r["name"] for r in members.collect()} == {"p0", "p1", "p2", "p3", "p4"}
    assert {tuple(r) for r in shortfall.collect()} == {("b", 1)}


def test_shuffle_is_a_stable_permutation(spark, scratch):
    rows = spark.range(500).withColumnRenamed("id", "k")
    once = {r["k"]: r["position"] for r in Q.seeded_shuffle(rows, "k", scratch).collect()}
    again = {r["k"]: r["position"] for r in Q.seeded_shuffle(rows.repartition(7), "k", scratch).collect()}
    assert once == again and sorted(once.values()) == list(range(500))
    with pytest.raises(ValueError):
        Q.sample_k(rows, "k", 501)
    assert Q.sample_k(rows, "k", 5).count() == 5


def test_dense_index_of_nothing(spark, scratch):
    assert dense_index(spark.range(0), ["id"], "n", scratch).count() == 0


LONG = "what are the main parts of a small red engine in old cars"  # 13 distinct words


def test_near_duplicates(spark, scratch):
    texts = [
        LONG,
        LONG.replace("red", "blue"),                     # one word differs: Jaccard 12/14
        LONG.replace("red", "blue").replace("old", "new"),  # linked through the second
        LONG + " today too",                             # more specific: no duplicate, 12 of 16 with the second
        "Small RED engine? What are the main parts of a, in old cars",  # same words
        "what is x", "what is y",                        # too short for one word to differ
    ]
    rows = docs(spark, texts)
    groups = Q.near_dup_groups(rows, "id", "text", scratch)
    assert {tuple(r) for r in groups.collect()} == {(0, 0), (0, 1), (0, 2), (0, 4)}


def brute_groups(sets, threshold):
    """(group, member) of sets by all pairs; a set that holds all of another is no duplicate of it."""
    near = lambda a, b: bool(a) and (a == b or (
        len(a & b) / len(a | b) >= threshold and not a < b and not b < a
    ))
    label = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if label[i] != label[j] and near(a, b):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {(g, i) for i, g in enumerate(label) if label.count(g) > 1}


def similar_sets(seed, n=140):
    """Families of sets at all distances, with common words, subsets, copies and empty sets."""
    rng = random.Random(seed)
    sets = [frozenset(), frozenset(), frozenset({"x"}), frozenset({"x", "y"})]
    for _ in range(6):
        base = [f"c{i}" for i in range(rng.randint(0, 8))] + [f"b{rng.randint(0, 400)}" for _ in range(rng.randint(3, 40))]
        for _ in range(n // 6):
            words = set(base)
            for _ in range(rng.randint(0, 6)):
                if rng.random() < 0.7 and words:
                    words.discard(rng.choice(sorted(words)))
                if rng.random() < 0.7:
                    words.add(f"u{rng.randint(0, 30)}")
            sets.append(frozenset(words))
    return sets


@pytest.mark.parametrize("threshold, limit", [(0.3, 3), (0.6, 1024), (0.8, 3), (1.0, 3)])
def test_near_duplicate_links_equal_brute_force(spark, scratch, threshold, limit):
    """A low limit cuts every group by further words and every cluster to blocks."""
    sets = similar_sets(4)
    rows = docs(spark, [" ".join(sorted(s)) for s in sets])
    links = Q.near_dup_links(rows, "id", "text", scratch, threshold, limit)
    got = {(r["component"], r["node"]) for r in connected_components(scratch.save(links), scratch).collect()}
    assert got == brute_groups(sets, threshold)


def test_near_duplicates_beyond_one_word(spark, scratch):
    words = [f"w{i}" for i in range(100)]
    texts = [
        " ".join(words), " ".join(words[5:] + [f"x{i}" for i in range(5)]),  # 95 of 105
        " ".join(words[1:] + ["y1", "y2"]),                                   # 99 of 102
        " ".join(words + ["more"]),                                           # more specific
        " ".join(words[:40]), None, "", "?!",
    ]
    assert {tuple(r) for r in Q.near_dup_groups(docs(spark, texts), "id", "text", scratch).collect()} == {
        (0, 0), (0, 1), (0, 2), (0, 3)  # 3 is no duplicate of 0, but 99 of its 101 words are those of 2
    }
    assert Q.near_dup_groups(docs(spark, [texts[0], texts[3], texts[4]]), "id", "text", scratch).count() == 0
    assert Q.near_dup_groups(docs(spark, []), "id", "text", scratch).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**63 - 1), min_size=1, max_size=60), st.sets(st.integers(0, 2**63 - 1), max_size=20), st.integers(0, 30))
def test_bitmaps_never_exclude_similar_sets(base, more, gone):
    a, b = sorted(base), sorted((set(sorted(base)[gone:]) | more) or {1})
    pack = lambda s: len(s).to_bytes(8) + similarity.bitmap(np.array(s, np.uint64), similarity._bits_of(len(s))).tobytes()
    for threshold in (0.3, 0.6, 0.8):
        both = len(set(a) & set(b))
        if both / (len(a) + len(b) - both) >= threshold:
            assert similarity._may_be_similar(threshold)([pack(a), pack(b)])(pack(b), np.array([0, 1])).all()


def test_a_group_of_one_block_sends_each_class_once(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(similarity, "over_rows", lambda df, fn, schema: dealt.append(df) or over_rows(df, fn, schema))
    rows = [(7, s, 1 if s < 3 else s, 1, 5, 3) for s in range(1, 6)]
    members = local_table(spark, rows, "grp long, sid long, component long, main long, size long, outer long")
    payload = local_table(spark, [(s, bytes([s])) for s in range(1, 6)], "sid long, payload binary")
    seen = lambda payloads: lambda data, at: np.array([payloads[k][0] + data[0] in (5, 9) for k in at])
    for limit, n in ((10, 5), (2, 19)):  # else each of 5 in two blocks, and 3 outer ones with three
        pairs = {tuple(sorted(r)) for r in similarity._blocks(members, payload, seen, limit).collect()}
        assert pairs == {(1, 4), (2, 3), (4, 5)}
        assert dealt[-1].count() == n


def test_apply_duplicate_ids(spark):
    rows = spark.createDataFrame([(i, f"q{i % 5}") for i in range(6)], "idx long, text string")
    groups = spark.createDataFrame([(0, 0), (0, 5), (0, 3), (2, 2), (2, 99), (77, 4)], "group_idx long, idx long")
    kept, stray = Q.apply_duplicate_ids(rows, groups)
    assert {r["text"] for r in kept.collect()} == {"q0", "q1", "q2", "q4"}
    assert {tuple(r) for r in stray.select("group_idx", "idx").collect()} == {(2, 99), (77, 4)}


def test_apply_duplicates(spark):
    rows = spark.createDataFrame([(i, f"q{i}") for i in range(5)], "idx long, text string")
    groups = Q.explode_duplicates(
        spark.createDataFrame([("q0", [0, 3]), ("new", [4, 99])], "question string, indexes array<long>")
    )
    kept, stray = Q.apply_duplicates(rows, groups)
    assert {r["text"] for r in kept.collect()} == {"q0", "q1", "q2", "new"}
    assert [tuple(r) for r in stray.select("idx", "question").collect()] == [(99, "new")]


def test_salted_join_equals_plain_join(spark):
    policy = SkewPolicy(min_rows=50, rows_per_split=20, sample=1.0)
    left = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 100)) AS key")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "key string, v int")
    assert [(r["hot_key"], r["splits"]) for r in hot_keys(left, "key", policy).collect()] == [("hot", 17)]
    for how in ("left", "inner"):
        salted = lookup_join(left, right, "key", how, policy).select("id", "key", "v")
        plain = left.join(right, "key", how).select("id", "key", "v")
        assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    for how in ("left_semi", "left_anti"):
        salted = lookup_join(left, right.select("key"), "key", how, policy).select("id")
        plain = left.join(right, "key", how).select("id")
        assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))


def test_near_duplicates_leave_no_tables_of_the_join(spark, scratch, monkeypatch):
    """Within the join a round's tables go when the next one's are there; behind it only the links stay."""
    written, save = [], type(scratch).save
    monkeypatch.setattr(
        type(scratch), "save", lambda self, df, name="t": written.append((name, save(self, df, name))) or written[-1][1])
    rows = docs(spark, [" ".join(sorted(s)) for s in similar_sets(4)])
    stay = lambda: {name for name, table in written if path_exists(spark, table._scratch_path)}
    Q.near_dup_links(rows, "id", "text", scratch, 0.8, 4).count()
    assert {"stars", "open", "prefixes"} <= {name for name, _ in written} and not {"stars", "open", "prefixes"} & stay()
    written.clear()
    groups = Q.near_dup_groups(rows, "id", "text", scratch)
    assert not {"sets", "classes", "shared", "components", "clusters", "members"} & stay() and "links" in stay()
    assert groups.count() > 0
