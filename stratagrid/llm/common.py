"""Plumbing that the training-data operators share: shared scratch tables and Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Most bytes of one Arrow batch that goes to a Python worker; a longer single row still goes whole.
BATCH_BYTES = 16 << 20
#: Whether shuffle files go with the write that made them, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where nothing but this machine runs.

    RuntimeError on a cluster that names none: executors would each write to a disk of their own.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='stratagrid-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def make_dir(spark: SparkSession, path: str) -> None:
    """Makes the folder, which no task would make for an empty table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


class Scratch:
    """Tables of one operator call in the shared folder; they cut lineage and outlive lost executors.

    They go when the application ends, as results read them until then.
    """

    def __init__(self, spark: SparkSession, name: str, within: str | None = None):
        self.spark, self.root = spark, f"{within or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        store, root = self._at(self.root)
        store.mkdirs(root)
        store.deleteOnExit(root)

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df once and returns the written table; shuffle files of the write go at its end."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        store, at = self._at(self.path(name))
        store.delete(at, True)

    def below(self, name: str) -> Scratch:
        """Tables of a step, in a folder of their own that goes with this one."""
        return Scratch(self.spark, name, self.root)

    def clear(self) -> None:
        """Deletes all tables, once nothing reads them any more."""
        store, at = self._at(self.root)
        store.delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], column: str | int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `most` bytes of the column at most, one row at least."""
    for batch in batches:
        if (batch.num_rows <= 1) or batch.column(column).nbytes <= most:
            if batch.num_rows:
                yield batch
            continue
        step = max(1, int(batch.num_rows * most / batch.column(column).nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def holdout(column: str = "doc_id"):
    """crc32 of the id as text, mod 4, is 2 (a null id counts as an empty text)."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4) == 2


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores behind it if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
