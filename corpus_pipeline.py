"""A training corpus in five stages; registered as query ``pipeline``.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read as the next stage's ``docs``. All but the last return the columns
of ``documents``:

toxicity          documents with a score at or above the limit go
near_dedup        of each group of near duplicates (0.8 of shingles of five words) the one
                  with the least id stays
substring_dedup   words in repeated windows go from the texts; texts that lose words
                  have the others joined by one space, the others stay as they are
decontamination   documents that hold a test string of the benchmark go
sentencepiece     ids of each text

Defined results: rows are told apart by a number of their own, not by their ids. Of rows
repeated in full one stays; of different texts under one id each is judged by itself; of
a group of near duplicates the row with the least id stays (null ids last, ties by row).
Texts that are null or have no words have no copies and stay. Columns beyond those of
``documents`` are kept up to the last stage, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from kgspark.llm import decontaminate, near_dup, pieces, suffix_automaton, toxicity
from kgspark.storage import Scratch

NEAR = near_dup.NearDup(size=5)  # the four words of op5 are that query's contract
ORACLE_SQL = None  # the fitted score and the ids cannot be expressed in SQL


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """The rows with a number of their own, written once so that it stays, and its name."""
    name = _free(docs, "_row")
    return scratch.save(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def _texts(rows: DataFrame, number: str) -> DataFrame:
    """(doc_id, text) with the number as id: rows are told apart, whatever their ids."""
    return rows.select(F.col(number).alias("doc_id"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.train(docs, labels)
    name = _free(docs, "_toxic_score")
    return toxicity.score(docs, machine, name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    rows, number = _numbered(docs, scratch)
    found = near_dup.near_duplicates(_texts(rows, number), scratch, NEAR)
    ids = rows.select(F.col(number).alias("number"), F.col("doc_id").alias("id"))
    # Null ids stand behind all others.
    first = F.min(F.struct(F.col("id").isNull(), "id", "number"))
    kept = ids.join(found, ids["number"] == found["doc_id"]).groupBy("component_id").agg(first.alias("first"))
    kept = kept.select(F.col("first.number").alias(number))
    return rows.join(kept, number, "left_semi").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    rows, number = _numbered(docs, scratch)
    found = suffix_automaton.dedup_words(_texts(rows, number), scratch)
    rest = _free(docs, "_rest")
    cut = found.where("n_removed > 0").select(F.col("doc_id").alias(number), F.col("kept").cast("string").alias(rest))
    met = rows.join(cut, number, "left")
    columns = {"text": F.coalesce(F.col(rest), F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.coalesce(F.length(rest).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return met.select([columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, number = _numbered(docs, scratch)
    found = decontaminate.find_contamination(_texts(rows, number), benchmark, scratch)
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias(number))
    return rows.join(hit, number, "left_anti").select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, public_tokenizers.path(pieces.VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; each stage's result is written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs
