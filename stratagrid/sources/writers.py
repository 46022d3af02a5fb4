"""Writing cubes, predictions and reports, and tables that are kept by the digest of their configuration."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import plan_key


def write_by_year(df: DataFrame, path: str, time: str = "time", by_month: bool = False) -> None:
    """Parquet partitioned by year (and month), zstd; only the years that df holds are replaced."""
    parts = {"year": F.year(time)} | ({"month": F.month(time)} if by_month else {})
    df.withColumns(parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*parts).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header, in one file: reports have a few rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def kept(spark: SparkSession, folder: str, config: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table made for an equal configuration before, or made now and kept."""
    path = f"{folder}/{plan_key(config)}"
    store, at = _fs(spark, f"{path}/_SUCCESS")
    if not store.exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def kept_months(spark: SparkSession, folder: str, config: dict, months: list[tuple[int, int]], make: Callable[[list[tuple[int, int]]], DataFrame], time: str = "time") -> DataFrame:
    """Rows of (year, month) pairs of the table of this configuration; `make` is asked for the months not kept yet.

    A month is marked as kept after it is written, one without rows too, so that neither is made again and a run
    that stops in between leaves nothing half done.
    """
    path = f"{folder}/{plan_key(config)}"
    months = sorted(set(months))
    mark = lambda y, m: _fs(spark, f"{path}/_months/{y}-{m:02d}")
    lacking = [p for p in months if not (at := mark(*p))[0].exists(at[1])]
    store, schema_at = _fs(spark, f"{path}/_schema.json")
    if lacking:
        made = make(lacking).withColumns({"kept_year": F.year(time), "kept_month": F.month(time)})
        wanted = made.where((F.col("kept_year") * 100 + F.col("kept_month")).isin([y * 100 + m for y, m in lacking]))
        wanted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("kept_year", "kept_month").parquet(path)
        if not store.exists(schema_at):
            _put(store, schema_at, made.schema.json())
        for p in lacking:
            _put(*mark(*p), "")
    schema = StructType.fromJson(json.loads(_text(spark, store, schema_at)))
    found = spark.read.schema(schema).parquet(path)
    return found.where((F.col("kept_year") * 100 + F.col("kept_month")).isin([y * 100 + m for y, m in months])).drop("kept_year", "kept_month")


def _put(store, at, text: str) -> None:
    out = store.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _text(spark: SparkSession, store, at) -> str:
    found = store.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
    finally:
        found.close()


def evict(spark: SparkSession, folder: str, most_bytes: int) -> list[str]:
    """Deletes the kept tables that were written longest ago until the rest fits; the paths deleted."""
    store, at = _fs(spark, folder)
    found = sorted(((s.getModificationTime(), store.getContentSummary(s.getPath()).getLength(), s.getPath()) for s in store.listStatus(at)), key=lambda x: x[0])
    total, gone = sum(n for _, n, _ in found), []
    for _, n, path in found:
        if total <= most_bytes:
            break
        store.delete(path, True)
        gone.append(path.toString())
        total -= n
    return gone


def add_missing(old: DataFrame, wanted: list[str], keys: list[str], make: Callable[[list[str]], DataFrame]) -> DataFrame:
    """old with the wanted columns that it lacks, made only for these and joined by key."""
    lacking = [c for c in wanted if c not in old.columns]
    return old.join(make(lacking).select(*keys, *lacking), keys) if lacking else old
