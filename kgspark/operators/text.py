"""Chunking, batching and merging of texts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kgspark.rows import over_rows
from kgspark.skew import dense_index, hot_ends, lookup_join
from kgspark.storage import Scratch

# Defaults of the text steps.
CHUNK_SIZE = 512
CHARACTERS_PER_TOKEN = 4
FAN_IN = 6
MIN_SCOPE_LENGTH = 100
PIECE = 1 << 16  # characters after which a piece of a merged document ends


def _word_chunks(text: Column, k: int) -> Column:
    """Pieces of at most k whitespace-separated words; blank pieces are left out."""
    words = F.array_remove(F.split(text, r"(?U)\s+"), "")
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(words) - 1) / k), F.lit(0)).cast("int"))
    chunks = F.transform(starts, lambda i: F.array_join(F.slice(words, i * k + 1, k), " "))
    return F.filter(chunks, lambda c: c != "")


def chunk_text(
    docs: DataFrame, text: str = "text", chunk_size: int = CHUNK_SIZE,
    tokenizer: Callable[[str, int], list[str]] | None = None,
) -> DataFrame:
    """One row per chunk: the columns of ``docs`` with ``pos`` and the chunk text.

    Tokens are words. Another tokenizer plugs in as a function (text, size) ->
    pieces, which runs on Arrow batches; blank pieces are dropped all the same.
    """
    if tokenizer is None:
        pieces = _word_chunks(F.col(text), chunk_size)
    else:
        pieces = _custom_chunks(tokenizer, chunk_size)(F.col(text))
    return _explode_chunks(docs, text, pieces)


def _custom_chunks(tokenizer: Callable[[str, int], list[str]], chunk_size: int):
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        def pieces(value: str | None) -> list[str]:
            found = [] if value is None else tokenizer(value, chunk_size)
            found = [found] if isinstance(found, str) else found
            return [p for p in found if p.strip()]

        return texts.map(pieces)

    return split


def _explode_chunks(docs: DataFrame, text: str, pieces: Column) -> DataFrame:
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.posexplode(pieces).alias("pos", text))


def chunk_gate(docs: DataFrame, text: str = "text", chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Chunk only texts of more than 4 characters per token; others pass whole."""
    long = F.length(text) > CHARACTERS_PER_TOKEN * chunk_size
    return _explode_chunks(
        docs, text, F.when(long, _word_chunks(F.col(text), chunk_size)).otherwise(F.array(F.col(text)))
    )


def drop_empty(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.where(F.col(text).isNotNull() & (F.col(text) != ""))


def batch_texts(docs: DataFrame, seq: str, text: str, batch_size: int = 1) -> DataFrame:
    """(batch_id, n_texts, text): consecutive texts joined by line breaks.

    ``seq`` counts the texts 0, 1, 2..; a group holds at most ``batch_size`` texts.
    """
    return docs.groupBy(F.floor(F.col(seq) / batch_size).cast("long").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq), F.col(text)))), lambda x: x[text]), "\n"
        ).alias("text"),
    )


def chunk_rows(df: DataFrame, seq: str, n: int) -> DataFrame:
    """Add ``group_id`` and ``pos``: consecutive groups of n rows, no shuffle."""
    return df.withColumn("group_id", F.floor(F.col(seq) / n).cast("long")).withColumn(
        "pos", (F.col(seq) % n).cast("int")
    )


def merge_rounds(n: int, fan_in: int = FAN_IN) -> int:
    """Rounds that bring n documents down to one."""
    rounds = 0
    while n > 1:
        n = math.ceil(n / fan_in)
        rounds += 1
    return rounds


def merge_distinct_lines(docs: DataFrame, group: str, seq: str, text: str) -> DataFrame:
    """(group, line, doc_seq, line_no): first occurrence of every line of a group.

    Merging documents by keeping first occurrences is associative, so all rounds
    of a merge tree collapse into one aggregate. The merged document stays a
    table of lines, as it has no size bound; order by (doc_seq, line_no) to read.
    """
    lines = docs.select(
        group, F.col(seq).alias("doc_seq"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")
    )
    return lines.groupBy(group, "line").agg(F.min(F.struct("doc_seq", "line_no")).alias("at")).select(
        group, "line", F.col("at.doc_seq").alias("doc_seq"), F.col("at.line_no").alias("line_no")
    )


def tree_merge(
    docs: DataFrame, group: str, seq: str, text: str,
    merge: Callable[[list[str]], str], scratch: Scratch, fan_in: int = FAN_IN,
) -> DataFrame:
    """(group, text, rounds): one document per group by a user's merge function.

    Each round merges ``fan_in`` consecutive documents, so a call never sees more
    than that many; a group of one passes through unmerged. ``seq`` counts the
    documents of a group 0, 1, 2... The size of a merged document is up to the
    merge function (a summary is bounded, a concatenation is not); to keep all
    lines of many documents use ``tree_merge_lines`` or ``merge_distinct_lines``,
    whose results are tables.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    state = docs.select(
        F.col(group).alias("g"), F.col(seq).cast("long").alias("s"), F.col(text).alias("t"), F.lit(0).alias("rounds")
    )
    state = scratch.save(state, "merge")

    def merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        merged = pdf["t"].iloc[0] if len(pdf) == 1 else merge(list(pdf["t"]))
        return pd.DataFrame({
            "g": [pdf["g"].iloc[0]], "s": [int(pdf["s"].iloc[0]) // fan_in], "t": [merged],
            "rounds": [int(pdf["rounds"].max()) + 1],
        })

    while True:
        counts = state.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
        counts = scratch.save(counts, "open")
        if counts.isEmpty():
            return state.select(F.col("g").alias(group), F.col("t").alias(text), "rounds")
        # Finished groups stay as they are; open ones are merged by (group, six).
        hot = hot_ends(state, ["g"], scratch)["g"]
        finished = lookup_join(state, counts, "g", "left_anti", hot=hot)
        merged = (
            lookup_join(state, counts, "g", "left_semi", hot=hot)
            .groupBy("g", F.floor(F.col("s") / fan_in).alias("six"))
            .applyInPandas(lambda pdf: merge_group(pdf), state.schema)
        )
        after = scratch.save(finished.select(state.columns).unionByName(merged), "merge")
        scratch.drop(state)
        state = after


def _pieces(lines: Iterator[str]) -> Iterator[str | None]:
    """The lines as texts of bounded length, but for longer lines; a single null if there are none."""
    held, size, ended = [], 0, False
    for line in lines:
        held.append(line)
        size += len(line) + 1
        if size >= PIECE:
            yield "\n".join(held)
            held, size, ended = [], 0, True
    if held:
        yield "\n".join(held)
    elif not ended:
        yield None


def tree_merge_lines(
    docs: DataFrame, group: str, seq: str, text: str,
    merge: Callable[[Iterator[Iterator[str]]], Iterator[str]], scratch: Scratch, fan_in: int = FAN_IN,
) -> DataFrame:
    """(group, pos, text, rounds): ``tree_merge`` of documents without a bound, line by line.

    ``merge`` gets ``fan_in`` consecutive documents, each as an iterator over its lines,
    and yields the lines of the merged one. No document is held whole: it is a table of
    pieces, which joined by line breaks in order of ``pos`` are its text. A null text has no
    lines; a document without lines is one null piece.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    state = scratch.save(docs.select(
        F.col(group).alias("g"), F.col(seq).cast("long").alias("s"), F.lit(0).cast("long").alias("pos"),
        F.col(text).alias("t"), F.lit(0).alias("rounds"),
    ), "merge")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)

    def merge_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
        def lines(pieces):
            for _, _, _, _, t, _ in pieces:
                if t is not None:
                    yield from t.split("\n")

        for (g, six), document in groupby(rows, itemgetter(0, 1)):
            first = next(document)
            if (second := next(document, None)) is None:  # passes unmerged
                yield g, six, 0, first[4], first[5] + 1
                continue
            every = chain((first, second), document)
            merged = merge(lines(pieces) for _, pieces in groupby(every, itemgetter(2)))
            for pos, piece in enumerate(_pieces(merged)):
                yield g, six, pos, piece, first[5] + 1

    while True:
        counts = state.where("pos = 0").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
        counts = scratch.save(counts, "open")
        if counts.isEmpty():
            return state.select(F.col("g").alias(group), "pos", F.col("t").alias(text), "rounds")
        hot = hot_ends(state, ["g"], scratch)["g"]
        finished = lookup_join(state, counts, "g", "left_anti", hot=hot)
        dealt = lookup_join(state, counts, "g", "left_semi", hot=hot).select(
            "g", F.floor(F.col("s") / fan_in).alias("six"), "s", "pos", "t", "rounds"
        ).repartition("g", "six").sortWithinPartitions("g", "six", "s", "pos")
        after = scratch.save(finished.select(state.columns).unionByName(over_rows(dealt, merge_rows, columns)), "merge")
        scratch.drop(state)
        state = after


def joined_md5(pieces: DataFrame, group: str, pos: str, text: str) -> DataFrame:
    """(group, .., digest): MD5 of each group's pieces joined by line breaks, of which no more than one is held.

    Further columns are those of the first piece. Null if that piece is null.
    """
    others = [c for c in pieces.columns if c not in (group, pos, text)]
    rows = pieces.select(group, pos, text, *others).repartition(group).sortWithinPartitions(group, pos)
    kinds = [(c, pieces.schema[c].dataType.simpleString()) for c in [group, *others]]

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        for g, document in groupby(rows, itemgetter(0)):
            _, _, t, *rest = next(document)
            digest = None if t is None else hashlib.md5(t.encode())
            for _, _, t, *_ in document:
                digest.update(b"\n" + t.encode())
            yield g, *rest, digest and digest.hexdigest()

    return over_rows(rows, digests, ", ".join(f"`{c}` {kind}" for c, kind in kinds) + ", digest string")


def check_min_length(df: DataFrame, text: str, minimum: int = MIN_SCOPE_LENGTH) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantine): texts below the minimum length, or null, are set apart."""
    good = F.coalesce(F.length(text) >= minimum, F.lit(False))
    return df.where(good), df.where(~good)


def check_non_empty_list(df: DataFrame, items: str) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantine): replies without items are set apart."""
    good = F.coalesce(F.size(items) > 0, F.lit(False))
    return df.where(good), df.where(~good)


def number_rows(df: DataFrame, order: list, scratch: Scratch, name: str = "seq") -> DataFrame:
    """Dense row numbers from 0 in a total order, without a global window."""
    return dense_index(df, order, name, scratch)
