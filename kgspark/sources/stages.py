"""A graph of stages that goes on where a stopped run has ended.

A stage is one or several tables below ``root/<stage>/<key>``. The key is a hash of the
stage's name and parameters and of the *contents* of its inputs, so a changed source, a
changed parameter or a changed result before it gives another key, and a stage whose
inputs came out the same is not run again, whatever was rewritten upstream. A stage is
finished when its mark is there: one small file, renamed into place after all tables
are written. Tables without a mark are of a run that broke off, and are written anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kgspark.storage import hadoop_path, path_exists

Tables = dict[str, DataFrame]


def content_fingerprint(df: DataFrame) -> str:
    """Hash of a table's rows and schema, whatever their order and files.

    Rows are hashed one by one with their nulls, and summed up: one pass without a
    shuffle of rows. Repeated rows count.
    """
    columns = sorted(df.columns)
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}))
    found = df.select(row.alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")
    ).first()
    types = [(f.name, f.dataType.simpleString()) for f in sorted(df.schema, key=lambda f: f.name)]
    return hashlib.sha256(json.dumps([types, found["n"], found["x"], str(found["s"])]).encode()).hexdigest()[:24]


class Stages:
    """The stages of one run; ``reused`` tells which of them were there already."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables: dict[str, Tables] = {}
        self.prints: dict[str, str] = {}
        self.reused: dict[str, bool] = {}

    def source(self, name: str, df: DataFrame) -> None:
        """A table from outside, known by its content."""
        self.tables[name] = {name: df}
        self.prints[name] = content_fingerprint(df)

    def run(self, name: str, inputs: list[str], compute: Callable[..., Tables], params: object = None) -> Tables:
        """The tables of a stage: loaded if finished, else those of ``compute(*inputs)``.

        ``compute`` gets the tables of each input as a dict, and returns a dict. What it
        depends on besides its inputs (a threshold, a model's version) goes into ``params``.
        """
        given = {i: self.prints[i] for i in inputs}
        key = hashlib.sha256(json.dumps([name, params, given], sort_keys=True).encode()).hexdigest()[:24]
        folder = f"{self.root}/{name}/{key}"
        mark = f"{folder}/done.json"
        self.reused[name] = path_exists(self.spark, mark)
        if not self.reused[name]:
            prints = {}
            for table, df in compute(*[self.tables[i] for i in inputs]).items():
                df.write.mode("overwrite").parquet(f"{folder}/{table}")
                prints[table] = content_fingerprint(self.spark.read.parquet(f"{folder}/{table}"))
            self._commit(mark, {"inputs": given, "tables": prints})
        prints = json.loads(self.spark.read.text(mark, wholetext=True).first()["value"])["tables"]
        self.tables[name] = {t: self.spark.read.parquet(f"{folder}/{t}") for t in prints}
        self.prints[name] = hashlib.sha256(json.dumps(prints, sort_keys=True).encode()).hexdigest()[:24]
        return self.tables[name]

    def _commit(self, mark: str, content: dict) -> None:
        fs, target = hadoop_path(self.spark, mark)
        _, draft = hadoop_path(self.spark, f"{mark}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not fs.rename(draft, target) and not fs.exists(target):
            raise OSError(f"cannot commit {mark}")
