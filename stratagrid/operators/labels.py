"""Labels: binarising, weights, relaxed matching and smoothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .axes import KEYS, Keys


def binarised(c: Column, threshold: float, mode: str) -> Column:
    """1 where an event: under -threshold (`cold`) or over threshold (`heat`); NULL and NaN are none."""
    over = c < -threshold if mode == "cold" else (c > threshold) & ~F.isnan(c)
    return F.coalesce(over, F.lit(False)).cast("int")


def binarised_against(c: Column, normal: Column, margin: float, mode: str) -> Column:
    """1 where the value is more than the margin under (`cold`) or over (`heat`) the normal."""
    return F.coalesce(c < normal - margin if mode == "cold" else c > normal + margin, F.lit(False)).cast("int")


def tier_weight(anomaly: Column, weights: tuple[float, float, float, float] = (1.0, 2.0, 5.0, 10.0), cuts: tuple[float, float, float] = (5.0, 10.0, 15.0)) -> Column:
    """Weight by the size of the anomaly: the last tier whose cut it reaches."""
    size = F.abs(anomaly)
    return F.when(size >= cuts[2], weights[3]).when(size >= cuts[1], weights[2]).when(size >= cuts[0], weights[1]).otherwise(weights[0])


def confusion_code(truth: Column, predicted: Column) -> Column:
    """0 true negative, 1 true positive, 2 false positive, 3 false negative."""
    return F.when((truth == 1) & (predicted == 1), 1).when((truth == 0) & (predicted == 1), 2).when((truth == 1) & (predicted == 0), 3).otherwise(0)


def relaxed(df: DataFrame, columns: list[str], keys: Keys = KEYS) -> DataFrame:
    """{c}_relaxed: 1 if the column is 1 in the row before, this one or the next one of the cell."""
    w = keys.series()
    return df.withColumns({f"{c}_relaxed": F.greatest(F.col(c), F.lag(c).over(w), F.lead(c).over(w)) for c in columns})


def gaussian(sigma: float, radius: int) -> list[float]:
    """Weights of -radius to radius that sum to 1."""
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def _convolve(column: str, along: WindowSpec, ends: WindowSpec, weights: list[float]) -> Column:
    """Weighted sum over neighbours; beyond an end of the axis the end's value goes on."""
    r = len(weights) // 2
    first, last = F.first(column).over(ends), F.last(column).over(ends)
    parts = [F.lit(w) * (F.col(column) if k == 0 else F.coalesce(F.lag(column, -k).over(along), first) if k < 0 else F.coalesce(F.lead(column, k).over(along), last)) for k, w in zip(range(-r, r + 1), weights, strict=True)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def smoothed(df: DataFrame, label: str, name: str = "smooth", temporal: tuple[float, int] = (1.0, 2), spatial: tuple[float, int] = (1.0, 1), least: float = 0.0, most: float = 1.0, chunk: list[str] | None = None, keys: Keys = KEYS) -> DataFrame:
    """Gaussian smoothing in time, then over the grid, never under the label itself, clipped to [least, most].

    (sigma, radius) in rows of the dense grid; missing values count as 0. The kernel over the grid is separable.
    chunk: columns such as year and month that smoothing in time doesn't cross.
    """
    chunk = chunk or []
    every = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("_s", F.coalesce(F.col(label).cast("double"), F.lit(0.0)))
    passes = [(Window.partitionBy(*chunk, *keys.cell).orderBy(keys.time), temporal), (Window.partitionBy(keys.time, keys.lon).orderBy(keys.lat), spatial), (Window.partitionBy(keys.time, keys.lat).orderBy(keys.lon), spatial)]
    for along, (sigma, radius) in passes:
        if radius > 0 and sigma > 0:
            df = df.withColumn("_s", _convolve("_s", along, every(along), gaussian(sigma, radius)))
    best = F.greatest(F.col("_s"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)))
    return df.withColumn(name, F.least(F.greatest(best, F.lit(least)), F.lit(most))).drop("_s")


def smooth_weight(smooth: Column, label: Column, base: float = 1.0, most: float = 5.0) -> Column:
    """Weight by how undecided a smoothed label is; events have the most."""
    return F.when(label == 1, F.lit(most)).otherwise(F.lit(base) + F.lit(most - base) * F.lit(4.0) * smooth * (F.lit(1.0) - smooth))
