"""Benchmark decontamination: a Wu-Manber search of many word windows at once.

Texts are lower-cased (A-Z) and cut to words. Every run of ``window`` words of a
benchmark item is a test string; an item of fewer words is one test string. Test
strings of one length form a searcher with three tables: the shift table tells
for a block of two words how far the search may jump, the suffix table gives the
test strings that end in a block, by their first block, and a direct comparison
of the words confirms an occurrence.

The test strings reach the tasks as a broadcast table. Their total size is
measured first and they are cut into blocks of a fixed number of bytes by a hash;
one pass over the documents searches one block, so the broadcast table does not
grow with the benchmark. One block is the rule.

Defined results: a null or empty text has no words and no hits; items without
words are never found; an item with a null id still marks words but is not
listed; repeated items and repeated documents are each reported; other columns of
both tables are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from kgspark.llm.common import map_rows, utf8
from kgspark.storage import Scratch

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLOCK_BYTES = 16 << 20
WINDOW = 10


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class WuManber:
    """Search for word sequences of one length ``m``."""

    def __init__(self, m: int):
        self.m = m
        self.block = min(2, m)
        self.jump = m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.suffix: dict[bytes, dict[bytes, list[tuple[list[bytes], list[str]]]]] = {}

    def add(self, sequence: list[bytes], items: list[str]) -> None:
        m, size = self.m, self.block
        for end in range(size, m + 1):
            block = b" ".join(sequence[end - size:end])
            self.shift[block] = min(self.shift.get(block, self.jump), m - end)
        first = b" ".join(sequence[:size])
        last = b" ".join(sequence[m - size:])
        self.suffix.setdefault(last, {}).setdefault(first, []).append((sequence, items))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, items) of each occurrence, by start."""
        m, size, jump, shift = self.m, self.block, self.jump, self.shift.get
        i, n = m, len(text)  # i is the end of the window that is looked at
        while i <= n:
            block = text[i - 2] + b" " + text[i - 1] if size == 2 else text[i - 1]
            step = shift(block, jump)
            if step:
                i += step
                continue
            first = b" ".join(text[i - m:i - m + size])
            for sequence, items in self.suffix[block].get(first, ()):
                if text[i - m:i] == sequence:
                    yield i - m, items
            i += 1


def test_strings(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, item_id): the distinct word windows of each item."""
    def cut(rows):
        for item, text in rows:
            found = words(text)
            m = min(window, len(found))
            for sequence in {b" ".join(found[i:i + m]) for i in range(len(found) - m + 1)} if m else ():
                yield sequence, item

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), utf8())
    return map_rows(items, cut, "window binary, item_id string").distinct()


def _search(block: list[tuple[bytes, str | None]], docs: DataFrame) -> DataFrame:
    """Add the occurrences of one block of test strings to (doc_id, text, spans, items)."""
    items: dict[bytes, list[str]] = {}
    for sequence, item in block:
        found = items.setdefault(sequence, [])
        if item is not None:
            found.append(item)
    table = docs.sparkSession.sparkContext.broadcast(items)

    def run(rows):
        searchers: dict[int, WuManber] = {}
        for joined, ids in table.value.items():
            sequence = joined.split(b" ")
            searchers.setdefault(len(sequence), WuManber(len(sequence))).add(sequence, ids)
        for doc_id, text, spans, ids in rows:
            found, marks, seen = words(text), [tuple(s.values()) for s in spans], set(ids)
            for m, searcher in searchers.items():
                for start, names in searcher.find(found):
                    marks.append((start, start + m))
                    seen.update(names)
            yield doc_id, text, len(found), _merged(marks), sorted(seen)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text", "spans", "items"), run, f"doc_id {kind}, text binary, {FOUND}")


FOUND = "n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"


def _merged(marks: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for start, end in sorted(marks):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [{"start": a, "end": b} for a, b in out]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) of each document.

    ``spans`` are the merged runs of hit words, ``items`` the ids of the items with
    an occurring test string, sorted as strings.
    """
    strings = scratch.save(test_strings(benchmark, window), "test_strings")
    size = strings.agg(F.sum(F.length("window") + F.coalesce(F.length("item_id"), F.lit(0)) + 64)).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    found = docs.select(
        "doc_id", utf8(), F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    ).withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
    for b in range(n_blocks):
        block = strings.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(n_blocks)) == b).collect()
        found = _search([(bytes(r["window"]), r["item_id"]) for r in block], found)
        if b + 1 < n_blocks:
            found = scratch.save(found, "hits")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def digest(found: DataFrame) -> DataFrame:
    """The result of the registered query: counts and a digest of the item ids."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
