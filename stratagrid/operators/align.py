"""Alignment joins: nearest times and grid points, quantised keys, outside labels, first rows of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .axes import nearest_map


def nearest_time(df: DataFrame, features: DataFrame, left: str, right: str, tolerance_seconds: float | None = 43_200, on: list[str] | None = None) -> DataFrame:
    """df with the features of the nearest time within the tolerance; of two equally near ones the later one.

    Times are matched on the two axes, then df meets the features in equi-joins. Rows without a match go.
    """
    mapped = nearest_map(df.select(left), features.select(right), left, right, tolerance_seconds, "larger")
    return df.join(mapped, left).join(features, [right, *(on or [])])


def nearest_grid(df: DataFrame, features: DataFrame, columns: dict[str, str], tolerance: float | None = 0.6, how: str = "left", ties: str = "larger", on: list[str] | None = None, wanted: DataFrame | None = None, offered: DataFrame | None = None) -> DataFrame:
    """df with the features of the nearest coordinate on each axis; columns: {df's coordinate: features' one}.

    ties `larger` is the nearest-index rule of sorted axes, `smaller` that of the first least distance. wanted and
    offered hold the coordinates of df and of the features where a cheaper plan than these has them.
    """
    wanted, offered = df if wanted is None else wanted, features if offered is None else offered
    for left, right in columns.items():
        df = df.join(nearest_map(wanted.select(left), offered.select(right), left, right, tolerance, ties), left, "left")
    return df.join(features, [*columns.values(), *(on or [])], how)


def first_of(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def quantised_lookup(df: DataFrame, table: DataFrame, time: str, lat: str, lon: str, value: str, order: list[Column | str], default: float | None = 0.0, steps: int = 100) -> DataFrame:
    """df with table's value of the same date and coordinates to 1/steps, the first by order; default where there is none."""
    from ..functions import coordinate_key

    key = {"_d": F.to_date(time), "_a": coordinate_key(F.col(lat), steps), "_o": coordinate_key(F.col(lon), steps)}
    right = first_of(table.withColumns(key), list(key), order).select(*key, F.col(value))
    joined = df.withColumns(key).join(right, list(key), "left").drop(*key)
    return joined if default is None else joined.withColumn(value, F.coalesce(value, F.lit(default)))


def outside_labels(df: DataFrame, labels: DataFrame, time: str, cell: list[str], label: str) -> DataFrame:
    """df with `label` (0 where the labels lack the row) and `valid` (whether they have it); labels: (date, cell, label)."""
    right = first_of(labels.select(F.to_date("date").alias("_d"), *cell, F.col(label)), ["_d", *cell], [F.col(label)]).withColumn("_has", F.lit(True))
    joined = df.withColumn("_d", F.to_date(time)).join(right, ["_d", *cell], "left")
    return joined.withColumns({label: F.coalesce(label, F.lit(0)), "valid": F.coalesce("_has", F.lit(False))}).drop("_d", "_has")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; a column that a frame lacks is NULL in its rows."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def common(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Inner join of all frames on their positions."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(frame, keys)
    return out


def merged(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of all frames on their positions; of a variable that several have, the first value there is."""
    out = frames[0]
    for frame in frames[1:]:
        both = [c for c in frame.columns if c not in keys and c in out.columns]
        other = frame.withColumnsRenamed({c: f"_next_{c}" for c in both})
        out = out.join(other, keys, "full").withColumns({c: F.coalesce(c, f"_next_{c}") for c in both}).drop(*(f"_next_{c}" for c in both))
    return out
