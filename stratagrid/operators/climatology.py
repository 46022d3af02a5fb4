"""Climatologies, anomalies and domain-wide statistics: aggregates joined back by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .axes import KEYS, Keys
from .temporal import known

_STATS = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}


def doy_climatology(df: DataFrame, variables: list[str], time: str, cell: list[str]) -> DataFrame:
    """(dayofyear, cell, variables): means by day of the year, 366 included."""
    return df.groupBy(F.dayofyear(time).alias("dayofyear"), *cell).agg(*(F.avg(v).alias(v) for v in variables))


def doy_anomaly(df: DataFrame, variables: list[str], time: str, cell: list[str], climatology: DataFrame | None = None) -> DataFrame:
    """{v}_anom: value less its climatology, by default that of df itself. NULL where the climatology has no day.

    Combined before its shuffle and small beside df, the climatology is joined, not computed over a window.
    """
    base = doy_climatology(df, variables, time, cell) if climatology is None else climatology
    base = base.select(F.col("dayofyear").alias("_doy"), *cell, *(F.col(v).alias(f"_c_{v}") for v in variables))
    joined = df.withColumn("_doy", F.dayofyear(time)).join(base, ["_doy", *cell], "left")
    return joined.withColumns({f"{v}_anom": F.col(v) - F.col(f"_c_{v}") for v in variables}).drop("_doy", *(f"_c_{v}" for v in variables))


def mean_anomaly(df: DataFrame, variables: list[str], reference: DataFrame | None = None, keys: Keys = KEYS) -> DataFrame:
    """{v}_anom: value less the cell's mean over all time, of df or of a reference."""
    variables = known(df, variables, "anomaly")
    means = (df if reference is None else reference).groupBy(*keys.cell).agg(*(F.avg(v).alias(f"_c_{v}") for v in variables))
    return df.join(means, keys.cell, "left").withColumns({f"{v}_anom": F.col(v) - F.col(f"_c_{v}") for v in variables}).drop(*(f"_c_{v}" for v in variables))


def regional(df: DataFrame, variables: list[str], stats: list[str], keys: Keys = KEYS) -> DataFrame:
    """{v}_global_{stat} of each time step over all cells, on every row. Only one row for a step is shuffled."""
    variables = known(df, variables, "regional")
    made = df.groupBy(keys.time).agg(*(_STATS[s](v).alias(f"{v}_global_{s}") for v in variables for s in stats if s in _STATS))
    return df.join(made, keys.time, "left")


def climatology_lookup(df: DataFrame, climatology: DataFrame, time: str, cell: list[str], variable: str, name: str) -> DataFrame:
    """df with the climatology's value of min(day of year, 365) and the cell; climatology: (dayofyear, cell, variable)."""
    base = climatology.where("dayofyear <= 365").select(F.col("dayofyear").cast("int").alias("_doy"), *cell, F.col(variable).alias(name))
    return df.withColumn("_doy", F.least(F.dayofyear(time), F.lit(365))).join(base, ["_doy", *cell], "left").drop("_doy")
