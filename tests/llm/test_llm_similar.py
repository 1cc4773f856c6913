"""Fingerprints, spelling variants and whitening against brute force, on awkward small tables."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from test_llm_text import awkward, collect, frame

from kgspark.llm import sim_hash, spelling, whitening


# ------------------------------------------------------------------ SimHash

def test_simhash(spark, scratch):
    rng = random.Random(3)
    rows = awkward(7)
    for base in range(4):
        words = ["b%d_%d" % (base, i) for i in range(300)]
        for k in range(10):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "c%d" % rng.randrange(10**6)
            rows.append((100 + base * 20 + k, " ".join(copy).upper() if k == 5 else "\t".join(copy)))
    got = sim_hash.digest(sim_hash.near_duplicates(frame(spark, rows), scratch))
    want = sorted(brute.sim_hash(rows))
    assert collect(got, "doc_id fingerprint component_id".split()) == want
    assert {w[2] for w in want if w[0] in (0, 1, 2)} == {0}  # no words: zero, and linked
    assert sum(w[0] != w[2] for w in want) > 15


def test_simhash_of_awkward_rows(spark, scratch):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (7, "quite other words than those"), (9, "A b\nc d"), (10, None)]
    got = sim_hash.near_duplicates(frame(spark, rows), scratch).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [
        ("10", "10"), ("7", "7"), ("7", "7"), ("7", "7"), ("9", "7"), ("None", "None"),
    ]
    assert sim_hash.near_duplicates(frame(spark, []), scratch).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_crowded_buckets_are_cut(spark, scratch, radius):
    """Fingerprints that agree in most bits fill buckets beyond the limit on several levels."""
    rng = random.Random(radius)
    values = {rng.getrandbits(64) for _ in range(50)} | {0xABCDEF << 40 | x for x in range(900)}
    values |= {0xABCDEF << 40 | rng.getrandbits(20) << 20 | 5 for _ in range(600)}
    prints = dict(enumerate(sorted(values)))
    table = spark.createDataFrame([(sim_hash._signed(x),) for x in prints.values()], "print bigint")
    joined = sim_hash.forest(table, scratch, radius, limit=256).collect()
    place = {sim_hash._signed(x): i for i, x in prints.items()}
    a, b = np.array([(place[r["a"]], place[r["b"]]) for r in joined], np.int64).reshape(-1, 2).T
    assert sim_hash.least_of(len(prints), a, b).tolist() == list(brute.nearest(prints, radius).values())
    assert radius > 2 or len(joined) < 60 * len(prints)  # trees, not pairs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 63), max_size=5), min_size=1, max_size=150), st.integers(0, 5), st.integers(0, 2**64 - 1))
def test_bit_planes_count_differences(flips, radius, base):
    values = sorted({base ^ sum(1 << b for b in set(f)) for f in flips})
    buckets = [np.array(values, np.uint64), np.array(values[::2], np.uint64)]
    a, b = sim_hash.links(buckets, radius)
    first = -(-len(values) // 64) * 64
    want = {
        (at + i, at + j) for at, xs in ((0, values), (first, values[::2]))
        for i, x in enumerate(xs) for j, y in enumerate(xs) if i < j and (x ^ y).bit_count() <= radius
    }
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_fingerprint_of_a_very_long_text():
    words = ["w%d" % (i % 70000) for i in range(100_000)]
    assert brute.sim_hash([(1, " ".join(words))])[0][1] == "%016x" % sim_hash.fingerprint(" ".join(words).encode())


# ------------------------------------------------------- spelling variants

def misspelt(seed=2):
    rng = random.Random(seed)
    letters = "abcdeéÿß"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 11))) for _ in range(40)] + ["x" * 3000]
    def change(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:], w[:i] + rng.choice(letters) + w[i:]])
    words = [w for w in base for _ in range(40)] + ["chainword"] * 200 + ["chainwor"] * 30 + ["chainwo"] * 5
    for w in base:
        for _ in range(4):
            v = change(w)
            words += [v] * rng.randint(3, 9) + [change(v)] * rng.choice([1, 5])
    rng.shuffle(words)
    rows, at, doc = [(0, None), (1, ""), (2, "12 short")], 0, 3
    while at < len(words):
        n = rng.randint(1, 60)
        rows.append((doc, rng.choice([" ", "-", "7"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words[at:at + n])))
        at, doc = at + n, doc + 1
    return rows + [(None, "Abcdef abcdef " * 4), (5, "abcdef × ÷")]


@pytest.mark.parametrize("limit", [64, 1, 0])
def test_spelling_variants(spark, scratch, limit):
    rows = misspelt()
    got = spelling.group_variants(frame(spark, rows), scratch, limit)
    want = brute.variants(brute.variant_words(rows))
    columns = "word form root n n_near form_n".split()
    key = lambda r: r[0]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted(want, key=key)
    assert sum(w[1] is not None for w in want) > 20
    assert any(w[2] not in (w[0], w[1]) for w in want)  # a chain of two forms


def test_spelling_of_empty_tables(spark, scratch):
    assert spelling.group_variants(frame(spark, []), scratch).count() == 0
    assert spelling.group_variants(frame(spark, [(1, None), (2, "few short words")]), scratch).count() == 0


def test_roots_of_a_long_chain(spark, scratch):
    chain = spark.createDataFrame([("w%03d" % i, "w%03d" % (i + 1)) for i in range(100)], "word string, form string")
    assert {r["root"] for r in spelling.roots(chain, scratch).collect()} == {"w100"}


@settings(max_examples=100, deadline=None)
@given(st.text("abzéÿ", min_size=1, max_size=7))
def test_neighbourhoods_are_full(word):
    for alphabet in (spelling.REDUCED, spelling.WHOLE):
        own = tuple(spelling.symbols(word, alphabet).tolist())
        every = sorted(set(alphabet.tolist()))
        want = {own} | {own[:i] + own[i + 1:] for i in range(len(own))}
        want |= {own[:i] + (c,) + own[i + 1:] for i in range(len(own)) for c in every}
        want |= {own[:i] + (c,) + own[i:] for i in range(len(own) + 1) for c in every}
        got = spelling.neighbourhood(np.array(own), alphabet)
        assert set(got.tolist()) == {spelling.key_of(np.array(w, np.int64)) for w in want} and len(got) == len(want)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_one_edit(a, b):
    edits = {a[:i] + a[i + 1:] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "ab"}
    edits |= {a[:i] + c + a[i + 1:] for i in range(len(a)) for c in "ab"} - {a}
    assert spelling.one_edit(a, b) == (b in edits)


# ------------------------------------------------------------------ whitening

VECTORS = "vec_id bigint, embedding array<float>, label int, x double, component int, n string"


def vector_rows(dim, n=300, seed=1, scale=0.2):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((dim, dim)) * scale
    return [(i, [float(v) for v in np.float32(rng.standard_normal(dim) @ mix + 0.3)]) for i in range(n)]


def check_whitening(spark, rows, kept, wanted=32):
    table = spark.createDataFrame([(i, v, 1, 0.5, 9, "n") for i, v in rows], VECTORS)
    got = whitening.whiten(table, wanted).collect()
    x = np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1000000 for c in v] for _, v in kept], object)
    n, sums = len(x), x.sum(0)
    centred = ((n * x - sums) / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(wanted, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == n * k
    exact = sorted((i, int(d)) for (i, _), d in zip(kept, ((n * x - sums) ** 2).sum(1)))
    assert sorted((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == exact
    for c in range(k):
        part = sorted((r["vec_id"], r["whitened"]) for r in got if r["component"] == c + 1)
        want = sorted((i, w) for (i, _), w in zip(kept, centred @ vectors[:, c] / np.sqrt(values[c])))
        a, b = np.array([w for _, w in part]), np.array([w for _, w in want])
        assert [i for i, _ in part] == [i for i, _ in want] and min(abs(a - b).max(), abs(a + b).max()) < 1e-6
        share = next(r["explained"] for r in got if r["component"] == c + 1)
        assert abs(share - values[c] / values.sum()) < 1e-10
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-8


@pytest.mark.parametrize("dim", [1, 5, 40])
def test_whitening(spark, dim):
    rows = vector_rows(dim)
    bad = [(900, None), (901, [None] * dim), (902, [float("nan")] * dim), (903, [0.0] * (dim - 1) + [float("-inf")]), (904, [0.1] * (dim + 1))]
    check_whitening(spark, bad + rows, rows)


def test_whitening_of_repeated_rows_and_null_ids(spark):
    rows = vector_rows(6, 60)
    rows = rows + rows[:20]
    check_whitening(spark, rows, rows, wanted=3)


def test_whitening_without_variance(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    assert make([]).count() == 0 and make([(1, [0.5, 0.1])]).count() == 0 and make([(1, []), (2, [])]).count() == 0
    assert make([(1, [0.5, 0.1]), (2, [0.5, 0.1])]).count() == 0
    flat = make([(i, [0.5, 0.1 * (i % 4)]) for i in range(8)] + [(None, [0.5, 0.4])])
    assert flat.count() == 9 and flat.select("component").distinct().count() == 1
    huge = make([(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 1.0])])
    assert {r["deviation"] for r in huge.collect()} >= {None}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1e-6, 0.5, 1.0, 1.0 + 1e-9, 2.0, 7.0, 100.0]), min_size=1, max_size=40), st.integers(1, 40))
def test_components_with_clusters(spectrum, wanted):
    """Equal, close, tiny and zero eigenvalues; the count says none are missed."""
    rng = np.random.default_rng(len(spectrum))
    q, _ = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))
    matrix = (q * spectrum) @ q.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.components(matrix, wanted)
    real = [v for v in sorted(spectrum, reverse=True) if v > 0][:wanted]
    assert len(values) == len(real) and np.allclose(values, real, atol=1e-12 * max(spectrum, default=1))
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max(initial=0) <= 1e-12 * max(spectrum)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=9), st.integers(-4, 4), st.integers(0, 99))
def test_inertia_counts(spectrum, half, seed):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))
    assert whitening.above((q * np.array(spectrum, float)) @ q.T, half + 0.5) == sum(v > half + 0.5 for v in spectrum)
    # A matrix without any diagonal needs pivots of two rows.
    n = len(spectrum)
    swap = np.zeros((n, n))
    swap[np.arange(n), np.arange(n)[::-1]] = 1.0
    np.fill_diagonal(swap, 0)
    assert whitening.above(swap, 0.0) == n // 2
