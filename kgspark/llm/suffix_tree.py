"""Suffix-array dedup: repeated byte strings from an interval tree of common prefixes.

Every byte that a string of ``window`` bytes covers goes, if the string also starts
anywhere else. Candidates are found as ``kgspark.llm.repeats`` tells. For the
contexts of an anchor, the suffixes that start at the anchor are sorted, with the
lengths of the prefixes that neighbours share: an enhanced suffix array, sparse as
it has the anchors' suffixes only. A stack scan over these lengths gives the tree
of common-prefix intervals: each is a set of contexts that share so many bytes to
the right. What stands to the left decides whether an interval is a maximal
repeat: the members are taken in the order of their reversed left sides, where
the shared lengths of neighbours give a second scan; the groups of this scan
differ at their left end, so none can be extended, and they hold all occurrences.

Defined results: a null text is empty; texts shorter than a window keep all;
copies of a text go as a whole if they have a window; rows with a null id are
judged and returned like others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from kgspark.llm.repeats import Alphabet, remove_repeats
from kgspark.llm.anchors import mix
from kgspark.storage import Scratch

WINDOW = 400
GRAM = 64
BYTE_HASHES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax())


def suffix_order(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order, and the common prefix of each string with the one before it (0 first)."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    return order, [0, *(_shared(strings[a], strings[b]) for a, b in zip(order, order[1:]))]


def intervals(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of two or more, inner ones first."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(shared) + 1):
        length, first = (shared[i] if i < len(shared) else -1), i - 1
        while stack and stack[-1][0] > length:
            top, first = stack.pop()
            yield top, first, i - 1
        if not stack or stack[-1][0] < length:
            stack.append((length, first))


def maximal_repeats(contexts: list[tuple[bytes, bytes]], window: int) -> Iterator[tuple[int, int, list[int]]]:
    """(units to the left, units to the right, members) of repeats of ``window`` bytes or more.

    Within an interval of the right sides, only groups are given that add a member
    or a length over those within them; every occurrence is in its longest group.
    """
    order, shared = suffix_order([right for _, right in contexts])
    left_order, left_shared = suffix_order([left[::-1] for left, _ in contexts])
    rank = np.empty(len(contexts), np.int64)
    rank[left_order] = np.arange(len(contexts))
    left_shared, by_rank = np.array(left_shared), np.array(left_order)
    ordered = rank[order]
    most = max(map(len, (left for left, _ in contexts)))
    for right, first, last in intervals(shared):
        if right + most < window:
            continue
        ranks = np.sort(ordered[first:last + 1])
        # Common left side of neighbours within the interval: least of the lengths between them.
        between = np.minimum.reduceat(left_shared[:ranks[-1] + 1], ranks[:-1] + 1)
        members = by_rank[ranks]
        done = np.zeros(len(ranks), bool)
        for left, a, b in intervals([0, *between.tolist()]):
            if left + right >= window and not done[a:b + 1].all():
                done[a:b + 1] = True
                yield left, right, members[a:b + 1].tolist()


def _kernel(contexts: list[tuple[bytes, bytes]], window: int) -> Iterator[tuple[int, int, int]]:
    for left, right, members in maximal_repeats(contexts, window):
        for i in members:
            yield i, left, right


def alphabet(window: int = WINDOW, gram: int = GRAM) -> Alphabet:
    return Alphabet(
        window, min(gram, window), bytes, lambda t: BYTE_HASHES[np.frombuffer(t, np.uint8)], bytes, bytes, _kernel
    )


def dedup_bytes(docs: DataFrame, scratch: Scratch, window: int = WINDOW, max_group: int = 8192) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept); ``kept`` is null if nothing goes."""
    found = remove_repeats(docs, alphabet(window), scratch, max_group)
    return found.withColumnRenamed("n_units", "n_bytes")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept_sha256"))
