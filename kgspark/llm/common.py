"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS_AT_ONCE = 256
ITEM_BYTES = 40  # of a number in a list


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Run ``rows`` over each partition: an iterator of tuples in, one out.

    Rows travel as Arrow batches; only ``ROWS_AT_ONCE`` rows are Python objects at
    a time, and output is sent on in batches of a bounded number of rows or bytes.
    """
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values():
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(at, ROWS_AT_ONCE)
                    yield from zip(*(c.to_pylist() for c in part.columns))

        out, size = [], 0
        for row in rows(values()):
            out.append(row)
            size += sum(
                len(v) * (ITEM_BYTES if isinstance(v, list) else 1) for v in row if isinstance(v, (bytes, str, list))
            )
            if len(out) >= 8192 or size > 8 << 20:
                yield _batch(out, arrow)
                out, size = [], 0
        if out:
            yield _batch(out, arrow)

    return df.mapInArrow(run, struct)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def utf8(name: str = "text"):
    """A text column as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias(name)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def runs(rows: Iterator[tuple], key: Callable[[tuple], object]) -> Iterator[tuple[object, list[tuple]]]:
    """Groups of adjacent rows with equal keys; one group is in memory at a time."""
    now, group = None, []
    for row in rows:
        k = key(row)
        if group and k != now:
            yield now, group
            group = []
        now = k
        group.append(row)
    if group:
        yield now, group


class Recent:
    """Values of keys seen lately, at most twice ``size``: when one generation is full, it
    becomes the old one, and keys that are asked for again move to the new one."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def turn(self) -> None:
        """Start a new generation if the young one is full."""
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}

    def missing(self, keys: set) -> list:
        """Keys that are not known; those that are known are young from now on."""
        young, old, out = self.young, self.old, []
        for key in keys.difference(young):
            value = old.get(key)
            if value is None:
                out.append(key)
            else:
                young[key] = value
        return out
