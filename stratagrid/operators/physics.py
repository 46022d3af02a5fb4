"""Derived physical quantities."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from .axes import KEYS, Keys
from .spatial import differentiate
from .temporal import known


def wind_speed_direction(df: DataFrame, u: str, v: str, prefix: str = "wind10", eps: float = 1e-6) -> DataFrame:
    """{prefix}_speed, {prefix}_dir_sin, {prefix}_dir_cos."""
    if len(known(df, [u, v], "wind")) < 2:
        return df
    df = df.withColumn(f"{prefix}_speed", fn.wind_speed(F.col(u), F.col(v)))
    speed = F.col(f"{prefix}_speed")
    return df.withColumns({f"{prefix}_dir_sin": fn.wind_direction(F.col(v), speed, eps), f"{prefix}_dir_cos": fn.wind_direction(F.col(u), speed, eps)})


def divergence_vorticity(df: DataFrame, u: str, v: str, prefix: str = "wind10") -> DataFrame:
    """{prefix}_div, {prefix}_vort from the gradients of both components; without these nothing is added."""
    need = [f"{x}_grad_{d}" for x in (u, v) for d in ("lat", "lon")]
    if missing := [c for c in need if c not in df.columns]:
        warnings.warn(f"divergence: no columns {missing}", stacklevel=2)
        return df
    g = lambda x, d: F.col(f"{x}_grad_{d}")
    return df.withColumns({f"{prefix}_div": g(u, "lon") + g(v, "lat"), f"{prefix}_vort": g(v, "lon") - g(u, "lat")})


def wind_chill(df: DataFrame, temperature: str, u: str, v: str, name: str = "wind_chill_index") -> DataFrame:
    """Wind chill; temperatures whose mean is over 200 count as Kelvin. The mean is one row, joined to all."""
    if len(known(df, [temperature, u, v], "wind chill")) < 3:
        return df
    mean = df.agg(F.avg(temperature).alias("_mean"))
    celsius = F.when(F.col("_mean") > 200, F.col(temperature) - 273.15).otherwise(F.col(temperature))
    return df.crossJoin(F.broadcast(mean)).withColumn(name, fn.wind_chill(celsius, fn.wind_speed(F.col(u), F.col(v)))).drop("_mean")


def advection(df: DataFrame, temperature: str, u: str, v: str, latitude: str, longitude: str, name: str = "temp_advection", keys: Keys = KEYS) -> DataFrame:
    """Transport of temperature by wind, with derivatives by the signed coordinates."""
    if len(known(df, [temperature, u, v], "advection")) < 3:
        return df
    across, down = Window.partitionBy(keys.time, keys.lat).orderBy(longitude), Window.partitionBy(keys.time, keys.lon).orderBy(latitude)
    df = df.withColumn("_dx", differentiate(F.col(temperature), F.col(longitude), across)).withColumn("_dy", differentiate(F.col(temperature), F.col(latitude), down))
    return df.withColumn(name, fn.advection(F.col(u), F.col(v), F.col("_dx"), F.col("_dy"), F.col(latitude))).drop("_dx", "_dy")
