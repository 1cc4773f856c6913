"""Toxicity score: a factorization machine over hashed terms.

A document's terms are its distinct words (A-Z lower-cased) and the first 4 to 7
letters of each, hashed into 2^18 places. The score is the logistic function of

    bias + sum of w_t + sum over pairs t < u of <v_t, v_u>

so besides linear weights it has one for every pair of terms, through vectors of
8 numbers; that lets an insult weigh more next to a group mention than alone.

The model is fitted to a bounded sample of labelled documents: at most
``SAMPLE_PER_CLASS`` rows of each label, those with the least hash of the id. Their
term numbers (bounded by the number of places per document) come to the driver,
where numpy fits the machine by Adam steps on the whole sample, the linear
weights first. These are for terms of at least ``MIN_DOCS`` sample documents whose share of
toxic documents lies beyond ``SURE`` standard deviations of the sample's, and for frequent
terms. Weights and vectors then are for these and for all terms of a pair that is
toxic more or less often than the linear weights say, whatever the share of each term
alone: pairs are tested by blocks of matrix products, with a limit that holds for all of
them together (``beyond_linear``). The bias is then moved from the
sample's label balance to that of all training labels. Weights are a table of
fixed size and go to the tasks as a broadcast; scoring shuffles nothing. As every
word adds fixed numbers to the sums, these are kept per word in a worker.

Defined results: a null or empty text has the score of the bias alone; labels with
a null id or null mark, and ids without document, are not learned from; several labels of an id
count as toxic if one does; without any label of one of the two classes the score is the
rate of toxic labels (0 without labels); other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from kgspark.llm.common import map_rows, utf8
from kgspark.llm.decontaminate import words

PLACES = 1 << 18
FACTORS = 8
SAMPLE_PER_CLASS = 4096
MIN_DOCS = 3
SURE = 4.0  # standard deviations
PRIOR = 1.0  # what a weight of 1 costs, in documents
PAIR_PRIOR = 10.0
PAIR_RATE = 0.02
FREQUENT = 0.25
STEPS = 60
THRESHOLD = 0.3
KEPT_WORDS = 150_000
UNSURE = 0.02  # no linear score is trusted beyond this
CHANCE = 0.05  # that any pair passes by chance
PAIR_BLOCK = 1024


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms(word: bytes) -> list[int]:
    """Places of a word and of its beginnings, in letters, not bytes."""
    letters = word.decode("utf-8", "replace")
    parts = [b"w" + word, *(f"{k}{letters[:k]}".encode() for k in (4, 5, 6, 7) if len(letters) >= k)]
    return [zlib.crc32(p) % PLACES for p in parts]


@dataclass
class Machine:
    """bias, linear weights and vectors; ``table`` has them per place, with v squared."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def table(self) -> np.ndarray:
        return np.column_stack([self.weights, (self.vectors ** 2).sum(1), self.vectors]).astype(np.float32)


def sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sum rows of sorted groups."""
    out = np.zeros((n, *values.shape[1:]), np.float32)
    first = np.flatnonzero(np.diff(groups, prepend=-1))
    if len(first):
        out[groups[first]] = np.add.reduceat(values, first, axis=0)
    return out


@dataclass
class _Sample:
    """Term numbers of documents, for the places in use: document, term and count, sorted by document."""

    used: np.ndarray
    n: int
    doc: np.ndarray
    term: np.ndarray
    x: np.ndarray

    @staticmethod
    def of(rows: list[np.ndarray], used: np.ndarray) -> _Sample:
        at = np.full(PLACES, -1, np.int32)
        at[used] = np.arange(len(used))
        parts = [np.unique(found[found >= 0], return_counts=True) for found in (at[row] for row in rows)]
        doc = np.repeat(np.arange(len(rows)), [len(t) for t, _ in parts])
        x = np.concatenate([c for _, c in parts]).astype(np.float32)
        return _Sample(used, len(rows), doc, np.concatenate([t for t, _ in parts]), x)

    def descend(self, params: list[np.ndarray], rates: list[float], target: np.ndarray, steps: int) -> list[np.ndarray]:
        """Adam steps of bias, linear weights and vectors, each with its rate; no vectors, no pairs."""
        doc, term, x, n, m = self.doc, self.term, self.x, self.n, len(self.used)
        by_term = np.argsort(term, kind="stable")
        moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            v = params[2] if len(params) > 2 else None
            raw, s = self.raw(params)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - target) / n
            e = error[doc] * x
            grads = [error.sum(keepdims=True), sums(e[by_term], term[by_term], m) + PRIOR * params[1] / n]
            if v is not None:
                grad_v = (e[:, None] * (s[doc] - v[term]))[by_term]
                grads.append(sums(grad_v, term[by_term], m) + PAIR_PRIOR * v / n)
            for k, grad in enumerate(grads):
                moment[k] = 0.9 * moment[k] + 0.1 * grad
                square[k] = 0.99 * square[k] + 0.01 * grad ** 2
                move = moment[k] / (1 - 0.9 ** step) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)
                params[k] = params[k] - rates[k] * move
        return params

    def raw(self, params: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
        """Scores before the logistic function, and the documents' sums of vectors."""
        doc, term, x = self.doc, self.term, self.x
        raw = params[0] + sums(x * params[1][term], doc, self.n)
        if len(params) < 3:
            return raw, None
        v = params[2]
        xv = x[:, None] * v[term]
        s = sums(xv, doc, self.n)
        return raw + 0.5 * ((s ** 2).sum(1) - sums((xv * v[term]).sum(1), doc, self.n)), s


def beyond_linear(rows: list[np.ndarray], labels: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Places that together with another one are toxic more or less often than linear weights say.

    ``p`` has their probabilities. All pairs of places are tested that meet in enough
    documents on the wrong side of 1/2 to tell them from chance, by the likelihood ratio of
    their documents' labels; the limit is that of ``CHANCE`` over all pairs together.
    """
    p = np.clip(p, UNSURE, 1 - UNSURE).astype(np.float32)
    out = np.zeros(PLACES, bool)
    for mark in (1, 0):
        missed = (labels == mark) & ((p >= 0.5) != mark)
        often = np.zeros(PLACES, np.int64)
        for row in (rows[i] for i in np.flatnonzero(missed)):
            often[np.unique(row)] += 1
        places = np.flatnonzero(often >= MIN_DOCS)
        limit = np.log(max(1.0, len(places) * (len(places) - 1.0)) / CHANCE)
        # Pairs of fewer such documents cannot reach the limit.
        least = max(MIN_DOCS, int(np.ceil(limit / np.log(1 / UNSURE))))
        places = np.flatnonzero(often >= least)
        if len(places) < 2:
            continue
        sample = _Sample.of(rows, places)
        by_term = np.argsort(sample.term, kind="stable")
        term, doc = sample.term[by_term], sample.doc[by_term]
        toxic = labels == 1

        def block(start: int) -> np.ndarray:
            at = slice(*np.searchsorted(term, [start, start + PAIR_BLOCK]))
            dense = np.zeros((len(rows), min(PAIR_BLOCK, len(places) - start)), np.float32)
            dense[doc[at], term[at] - start] = 1
            return dense

        for start in range(0, len(places), PAIR_BLOCK):
            a = block(start)
            weighed, a_toxic, a_missed = a * p[:, None], a[toxic], a[missed]
            for other in range(start, len(places), PAIR_BLOCK):
                b = a if other == start else block(other)
                met = a_missed.T @ b[missed] >= least
                if other == start:
                    np.fill_diagonal(met, False)
                i, j = np.nonzero(met)
                if not len(i):
                    continue
                got, n, want = (a_toxic.T @ b[toxic])[i, j], (a.T @ b)[i, j], (weighed.T @ b)[i, j]
                gain = sum(
                    np.where(k > 0.5, k * np.log(np.maximum(k, 0.5) / of), 0) for k, of in ((got, want), (n - got, n - want))
                )
                sure = (gain >= limit) & ((got > want) == mark)
                out[places[start + i[sure]]] = out[places[other + j[sure]]] = True
    return np.flatnonzero(out)


def fit(rows: list[np.ndarray], labels: np.ndarray, rate: float, steps: int = STEPS, seed: int = 7) -> Machine:
    """Fit to term numbers (with repeats) and 0/1 labels; ``rate`` is the rate of ones to assume."""
    weights = np.zeros(PLACES, np.float32)
    vectors = np.zeros((PLACES, FACTORS), np.float32)
    share = labels.mean() if len(labels) else 0.0
    if not 0 < share < 1:
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        return Machine(float(np.log(rate / (1 - rate))), weights, vectors)
    # Document by document, as all terms of the sample together take much memory.
    seen, toxic = np.zeros(PLACES, np.int64), np.zeros(PLACES, np.int64)
    for row, label in zip(rows, labels):
        once = np.unique(row)
        seen[once] += 1
        toxic[once] += label
    # Terms whose toxic documents are too many or too few for chance, and frequent ones, get a weight.
    excess = toxic - seen * share
    beyond_chance = np.abs(excess) >= SURE * np.sqrt(seen * share * (1 - share))
    alone = np.flatnonzero((seen >= MIN_DOCS) & beyond_chance | (seen >= FREQUENT * len(rows)))
    target = labels.astype(np.float32)
    sample = _Sample.of(rows, alone)
    start = [np.zeros(1, np.float32), np.zeros(len(alone), np.float32)]
    bias, linear = sample.descend(start, [0.05, 0.05], target, steps)
    # A term whose own share is that of all documents may still matter next to another one.
    paired = beyond_linear(rows, labels, 1 / (1 + np.exp(-np.clip(sample.raw([bias, linear])[0], -30, 30))))
    used = np.union1d(alone, paired)
    weights[alone] = linear
    start = np.random.default_rng(seed).normal(0, 0.005, (len(used), FACTORS)).astype(np.float32)
    # The vectors learn what linear weights leave to pairs.
    bias, linear, pairs = _Sample.of(rows, used).descend([bias, weights[used], start], [0.05, 0.05, PAIR_RATE], target, steps)
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    moved = float(bias[0]) + np.log(rate / (1 - rate)) - np.log(share / (1 - share))
    weights[used], vectors[used] = linear, pairs
    return Machine(float(moved), weights, vectors)


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Machine:
    """Fit to labelled documents that are not held out; see the module's text for the sample."""
    marks = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    total, toxic = marks.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    parts = [
        marks.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)
    ]
    # At most 2 * per_class rows of two numbers: small enough to be sent to all tasks.
    sample = docs.select("doc_id", utf8()).join(F.broadcast(parts[0].unionAll(parts[1])), "doc_id")

    def places(rows):
        for doc_id, text, mark in rows:
            found = [t for w in set(words(text)) for t in terms(w)]
            yield doc_id, mark, np.array(found, np.int32).tobytes()

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = map_rows(sample.select("doc_id", "text", "toxic"), places, f"doc_id {kind}, toxic int, places binary").collect()
    got.sort(key=lambda r: (str(r["doc_id"]), r["places"]))
    return fit(
        [np.frombuffer(r["places"], np.int32) for r in got], np.array([r["toxic"] for r in got], np.int8),
        (toxic or 0) / total if total else 0.0,
    )


class _Words:
    """Sums that each word adds, kept in a growing array of bounded size."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((1024, self.table.shape[1]), np.float32)

    def sums(self, text: bytes) -> np.ndarray:
        found = set(words(text))
        if len(self.at) > KEPT_WORDS:
            self.clear()
        at = self.at
        new = [w for w in found if w not in at]
        if new:
            while len(at) + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            places = [terms(w) for w in new]
            owner = np.repeat(np.arange(len(new)), [len(p) for p in places])
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            values = self.table[[t for p in places for t in p]]
            self.rows[len(at):len(at) + len(new)] = np.add.reduceat(values, first, axis=0)
            at.update(zip(new, range(len(at), len(at) + len(new))))
        return self.rows[[at[w] for w in found]].sum(0, dtype=np.float64)


def score(docs: DataFrame, machine: Machine, name: str = "toxic_score") -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1) under a name that ``docs`` does not use."""
    table = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.table()))
    names = docs.columns
    at = names.index("text")

    def run(rows):
        bias, weights = table.value
        known = _Words(weights)
        for row in rows:
            w, squares, *s = known.sums((row[at] or "").encode())
            raw = bias + w + 0.5 * (sum(f * f for f in s) - squares)
            yield *row, float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_rows(docs, run, f"{fields}, `{name}` double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    machine = train(docs, labels)
    scored = score(docs.select("doc_id", F.col("text")), machine)
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= threshold).cast("int").alias("predicted"),
    )
