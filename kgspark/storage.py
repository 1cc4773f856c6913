"""Shared scratch storage: the one place where lineage is cut.

Loops and results that are read more than once are written as parquet tables
below the folder the cluster names in ``spark.checkpoint.dir``. The tables
outlive lost executors, and their file sizes let Catalyst decide on its own
whether a side is small enough to broadcast. What was shuffled to write a table
is deleted when the table is there.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for scratch tables; a local temp folder only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that all executors share"
        )
    folder = tempfile.mkdtemp(prefix="kgspark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path and the path itself, for exists and delete."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = hadoop_path(spark, path)
    return fs.exists(jpath)


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job started within go when it ends, not when the driver collects garbage.

    Spark deletes those of one query at a time, so no other query loses any.
    """
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


class Scratch:
    """A folder of scratch tables that belongs to one job.

    It is deleted by ``close``, at the end of a ``with`` block, or else when the
    driver's JVM ends, as a result may be read until then.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/kgspark-{uuid.uuid4().hex}"
        self._count = 0

    def new_path(self, name: str = "t") -> str:
        if not self._count:
            fs, jpath = hadoop_path(self.spark, self.path)
            fs.mkdirs(jpath)
            fs.deleteOnExit(jpath)
        self._count += 1
        return f"{self.path}/{name}-{self._count}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write a frame once and read it back: later uses do not recompute it."""
        path = self.new_path(name)
        with shuffles_freed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def close(self) -> None:
        """Delete the folder with all tables; nothing that reads them may be used later."""
        fs, jpath = hadoop_path(self.spark, self.path)
        fs.delete(jpath, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def pin(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Save a frame unless it is a scratch table already."""
        return df if hasattr(df, "_scratch_path") else self.save(df, name)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of finished loop rounds."""
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path and path.startswith(self.path):
                fs, jpath = hadoop_path(self.spark, path)
                fs.delete(jpath, True)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-sized table whose exact size Catalyst knows.

    Passed as an Arrow table it becomes a local relation; a plain list would
    become an RDD of unknown size, and joins with it would shuffle both sides.
    """
    struct = T.StructType.fromDDL(schema)
    data = [dict(zip(struct.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=to_arrow_schema(struct)), struct)
