"""Substring dedup on words by suffix automata.

Every word that a window of ``window`` words covers goes, if the window's words
also start anywhere else. Candidates are found as ``kgspark.llm.repeats`` tells. The
distinct contexts around an anchor are a reference shard: they make one suffix
automaton, whose states know how often their words end in the shard. Each context
is then streamed through it for matching statistics: at every word, the longest
run of words that ends there and occurs twice or more. Maximal runs at or above
the threshold are spans to remove.

A shard is as small as its anchor's contexts and is built in the task that gets
them. The automata are not broadcast: the shards grow with the corpus, and a
document needs only those of its own anchors.

Defined results: a null text has no words; texts of fewer words than a window keep
all; copies of a text go as a whole if they have a window; rows with a null id
are judged and returned like others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from kgspark.llm.repeats import Alphabet, remove_repeats
from kgspark.llm.anchors import mix
from kgspark.storage import Scratch

WINDOW = 35
GRAM = 6


class SuffixAutomaton:
    """Automaton of several word sequences, with the number of ends of each state."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [0]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] += self.ends[state]

    def _state(self, length: int, following: dict[bytes, int], link: int, ends: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(ends)
        return len(self.length) - 1

    def _clone(self, p: int, word: bytes, q: int) -> int:
        """A state for the words of ``q`` that are at most one longer than ``p``."""
        new = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], 0)
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:  # known from another sequence
            if self.length[q] != self.length[last] + 1:
                q = self._clone(last, word, q)
            self.ends[q] += 1
            return q
        new, p = self._state(self.length[last] + 1, {}, 0, 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return new

    def repeated(self, sequence: list[bytes], least: int) -> Iterator[tuple[int, int]]:
        """(start, end) of runs of ``least`` words or more that end twice or more, one per last word."""
        state, length = 0, 0
        for i, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            s, n = state, length
            while s and self.ends[s] < 2:
                s = self.link[s]
                n = self.length[s]
            if n >= least:
                yield i + 1 - n, i + 1


def _kernel(contexts: list[tuple[list[bytes], list[bytes]]], window: int) -> Iterator[tuple[int, int, int]]:
    sequences = [left + right for left, right in contexts]
    automaton = SuffixAutomaton(sequences)
    for i, (left, _) in enumerate(contexts):
        spans: list[list[int]] = []
        for start, end in automaton.repeated(sequences[i], window):
            if spans and start <= spans[-1][0]:
                spans[-1] = [min(start, spans[-1][0]), end]
            else:
                spans.append([start, end])
        for start, end in spans:
            yield i, len(left) - start, end - len(left)


def _hashes(words: list[bytes]) -> np.ndarray:
    # PySpark fixes the seed of hash() for all workers of a session.
    return mix(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))


def alphabet(window: int = WINDOW, gram: int = GRAM) -> Alphabet:
    return Alphabet(window, min(gram, window), bytes.split, _hashes, b" ".join, bytes.split, _kernel)


def dedup_words(docs: DataFrame, scratch: Scratch, window: int = WINDOW, max_group: int = 8192) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256, kept): ``kept`` has the words that stay, joined by
    one space, and is null if nothing goes."""
    found = remove_repeats(docs, alphabet(window), scratch, max_group)
    return found.withColumnRenamed("n_units", "n_words")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
