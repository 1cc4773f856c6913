"""Spelling variants by one-edit neighbourhoods in a reduced alphabet.

Words are counted over all texts: within a text equal runs are one, so a run's checksum
is computed once per text, and counts are added up in the task before they are
shuffled. One occurrence class in 199 loses a letter by its checksum (the rule of the
query), which plants misspellings.

Near words, those one inserted, deleted or replaced code point apart: letters are hashed
to a few symbols, so words become reduced words, and two near words have reduced words
that are equal or one edit apart. Each reduced word makes its full one-edit
neighbourhood (as 64-bit hashes, by prefix and suffix sums, so long words cost no
long strings), which is joined with the reduced vocabulary; the words of each pair of
reduced words that meets are verified on the original strings. A pair of reduced
words is compared once, from its lesser key.

A reduced word of more than ``LIMIT`` words would make all pairs of its words, so its words
take another way: their neighbourhood over the whole alphabet, whose keys belong to one word
each, is joined with all words. Every pair with such a word is found there, all others
above, and no group of words grows without bound.

The form of a word is its most frequent near word, if it is ``TIMES`` times as frequent.
Forms are more frequent than their words, so following them ends; roots are found by
pointer doubling, in rounds that grow with the logarithm of the longest chain.

Defined results: null and empty texts have no words; a null id counts as an empty one in the
checksum; rows repeated in full count each; runs of any length are whole words;
ties between forms go to the least in code-point order; other columns are ignored.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from kgspark.llm.common import map_rows, utf8
from kgspark.skew import lookup_join
from kgspark.storage import Scratch

# Fixed values of the query's rule.
LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH = 6
LEAST_COUNT = 5
TIMES = 5
DROP_EVERY = 199

SYMBOLS = 8  # of the reduced alphabet
LIMIT = 64  # words of a reduced word that are compared with each other
COUNTS = 100_000  # words whose counts a task holds
CHARS = 8 << 20  # and their letters

_RUN = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")


# -------------------------------------------------------------------- counts

def altered(run: str, prefix: int) -> str:
    """The run, less one letter if its checksum says so; ``prefix`` is the checksum of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % DROP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    def count(rows):
        counts, chars = Counter(), 0
        for doc_id, text in rows:
            prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            # Only A-Z are lower-cased, as bytes know no other letters.
            for run, n in Counter(_RUN.findall(text.lower().decode())).items():
                word = altered(run, prefix)
                if len(word) >= LEAST_LENGTH:
                    chars += len(word) if word not in counts else 0
                    counts[word] += n
            if len(counts) >= COUNTS or chars >= CHARS:
                yield from counts.items()
                counts, chars = Counter(), 0
        yield from counts.items()

    rows = map_rows(docs.select("doc_id", utf8()), count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ------------------------------------------------------------ reduced words

def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
_PLACE = np.zeros(256, np.int64)
_PLACE[_LETTERS] = np.arange(len(_LETTERS))
#: Symbol of each letter: reduced, and every letter for itself.
REDUCED = (_mix(np.arange(1, len(_LETTERS) + 1, dtype=np.uint64)) % np.uint64(SYMBOLS)).astype(np.int64)
WHOLE = np.arange(len(_LETTERS))
_VALUES = _mix(np.arange(1000, 1000 + len(_LETTERS), dtype=np.uint64)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.append(np.uint64(1), np.full(2 * n, np.uint64(_BASE))), dtype=np.uint64)
    return _POWERS[:n]


def symbols(word: str, alphabet: np.ndarray) -> np.ndarray:
    return alphabet[_PLACE[np.frombuffer(word.encode("latin-1"), np.uint8)]]


def _keys(sums: np.ndarray, length: int) -> np.ndarray:
    return _mix(sums ^ np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64))).ravel()


def key_of(sym: np.ndarray) -> int:
    """The signed 64-bit key of a reduced word."""
    total = (_VALUES[sym] * _powers(len(sym))).sum(dtype=np.uint64)
    return int(_keys(np.array([total]), len(sym)).view(np.int64)[0])


def neighbourhood(sym: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Keys of a reduced word and of all words one edit away; none twice."""
    n = len(sym)
    values = _VALUES[np.unique(alphabet)]
    power = _powers(n + 1)
    own = _VALUES[sym]
    before = np.append(np.uint64(0), np.cumsum(own * power[:n], dtype=np.uint64))
    total = before[-1]
    replaced = total + (values[None, :] - own[:, None]) * power[:n, None]
    deleted = before[:-1] + (total - before[1:]) * _BACK
    inserted = before[:, None] + values[None, :] * power[:, None] + ((total - before) * np.uint64(_BASE))[:, None]
    return np.unique(np.concatenate([_keys(replaced, n), _keys(deleted, n - 1), _keys(inserted, n + 1)])).view(np.int64)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(map(operator.ne, a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) != 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1:]


# ---------------------------------------------------------------- near words

PAIR = "word string, n bigint, near string, near_n bigint"


def _cold_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """Both directions of all near pairs of words, given (word, n, reduced)."""
    members = F.collect_list(F.struct("word", "n"))
    lists = scratch.save(words.groupBy("reduced").agg(members.alias("m")).select(
        "reduced", F.col("m.word").alias("words"), F.col("m.n").alias("counts")
    ), "lists")

    def neighbours(rows):
        for key, names in rows:
            # Reduced words whose hashes collide share a key; each makes its own neighbourhood.
            forms = {symbols(w, REDUCED).tobytes() for w in names}
            keys = np.unique(np.concatenate([neighbourhood(np.frombuffer(f, np.int64), REDUCED) for f in forms]))
            for other in keys[keys >= key].tolist():
                yield key, other

    met = map_rows(lists.select("reduced", "words"), neighbours, "a bigint, b bigint")
    left = lists.select(F.col("reduced").alias("a"), F.col("words").alias("a_words"), F.col("counts").alias("a_counts"))
    right = lists.select(F.col("reduced").alias("b"), F.col("words").alias("b_words"), F.col("counts").alias("b_counts"))
    pairs = scratch.save(met.join(right.select("b"), "b"), "met")

    def verify(rows):
        for same, a_words, a_counts, b_words, b_counts in rows:
            for i, (a, n) in enumerate(zip(a_words, a_counts)):
                for b, m in list(zip(b_words, b_counts))[i + 1 if same else 0:]:
                    if one_edit(a, b):
                        yield a, n, b, m
                        yield b, m, a, n

    both = pairs.join(left, "a").join(right, "b")
    return map_rows(both.select(F.col("a") == F.col("b"), "a_words", "a_counts", "b_words", "b_counts"), verify, PAIR)


def _hot_pairs(words: DataFrame, hot: DataFrame, scratch: Scratch) -> DataFrame:
    """Both directions of the near pairs with at least one word of ``hot``, given (word, n) of each."""
    def own_key(rows):
        for word, n, is_hot in rows:
            yield word, n, is_hot, key_of(symbols(word, WHOLE))

    def neighbours(rows):
        for number, word in rows:
            for key in neighbourhood(symbols(word, WHOLE), WHOLE).tolist():
                yield number, key

    marked = words.select("word", "n").join(
        hot.select("word", F.lit(True).alias("is_hot")), "word", "left"
    ).select("word", "n", F.coalesce("is_hot", F.lit(False)).alias("is_hot"))
    keyed = map_rows(marked, own_key, "word string, n bigint, is_hot boolean, key bigint")
    keyed = scratch.save(keyed.select(F.monotonically_increasing_id().alias("number"), "*"), "keyed")
    asked = map_rows(keyed.where("is_hot").select("number", "word"), neighbours, "number bigint, key bigint")
    met = scratch.save(
        asked.join(keyed.select("key", F.col("number").alias("other")), "key").where("number != other").select("number", "other"),
        "met",
    )
    one = keyed.select("number", "word", "n")
    two = keyed.select(F.col("number").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"), "is_hot")

    def verify(rows):
        for a, n, b, m, both_hot in rows:
            if one_edit(a, b):
                yield a, n, b, m
                if not both_hot:
                    yield b, m, a, n

    full = met.join(one, "number").join(two, "other").select("word", "n", "near", "near_n", "is_hot")
    return map_rows(full, verify, PAIR)


def near_pairs(words: DataFrame, scratch: Scratch, limit: int = LIMIT) -> DataFrame:
    """(word, n, near, near_n): all pairs of near words of a table (word, n), in both directions."""
    def reduce(rows):
        for word, n in rows:
            yield word, n, key_of(symbols(word, REDUCED))

    keyed = scratch.save(map_rows(words.select("word", "n"), reduce, "word string, n bigint, reduced bigint"), "reduced")
    crowded = scratch.save(
        keyed.groupBy("reduced").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit).select("reduced"),
        "crowded",
    )
    if crowded.isEmpty():
        return _cold_pairs(keyed, scratch)
    hot = scratch.save(keyed.join(crowded, "reduced", "left_semi").select("word"), "hot")
    cold = keyed.join(crowded, "reduced", "left_anti")
    return _cold_pairs(cold, scratch).unionAll(_hot_pairs(keyed, hot, scratch))


# --------------------------------------------------------------------- forms

def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of words that have a form, given (word, form)."""
    now = scratch.save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        n = now.count()
        next_up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        step = scratch.save(
            lookup_join(now, next_up, "root", rows=n).select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")),
            "roots",
        )
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        scratch.drop(now)
        now = scratch.save(step.select("word", "root"), "roots")


def group_variants(docs: DataFrame, scratch: Scratch, limit: int = LIMIT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word."""
    words = scratch.save(word_counts(docs), "words")
    pairs = near_pairs(words, scratch, limit)
    best = scratch.save(pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"), F.first("n").alias("n")
    ).select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n")), "best")
    is_form = F.col("near_n") >= TIMES * F.col("n")
    forms = best.where(is_form).select("word", F.col("near").alias("form"), F.col("near_n").alias("form_n"))
    found = roots(forms, scratch)
    return (
        words.join(best.select("word", "n_near"), "word", "left").join(forms, "word", "left").join(found, "word", "left")
        .select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n",
        )
    )
