"""Filters and reshaping of cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite


def region(df: DataFrame, lat: str, lon: str, lat_range: tuple[float, float] | None, lon_range: tuple[float, float] | None) -> DataFrame:
    """Rows within both ranges, ends included, in whatever order they are named."""
    for c, r in ((lat, lat_range), (lon, lon_range)):
        if r is not None:
            df = df.where(F.col(c).between(min(r), max(r)))
    return df


def years_between(df: DataFrame, time: str, first: int, last: int) -> DataFrame:
    """Whole years, the last one's final hours included."""
    return df.where((F.col(time) >= F.lit(f"{first}-01-01").cast("timestamp_ntz")) & (F.col(time) < F.lit(f"{last + 1}-01-01").cast("timestamp_ntz")))


def of_years(df: DataFrame, time: str, years: list[int], months: list[int] | None = None) -> DataFrame:
    """Rows of these years (and months). The years' range is a filter that reaches the scan; years in it that aren't named go after."""
    df = years_between(df, time, min(years), max(years)).where(F.year(time).isin(years)) if years else df.where(F.lit(False))
    return df.where(F.month(time).isin(months)) if months else df


def finite_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(finite(F.col(target).cast("double")))


def complete(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def times_with_data(df: DataFrame, time: str, variables: list[str]) -> DataFrame:
    """Without the times at which every variable is NULL in every row."""
    some = df.groupBy(time).agg(F.max(F.coalesce(*(F.col(v).isNotNull() for v in variables)) if len(variables) == 1 else F.greatest(*(F.col(v).isNotNull() for v in variables))).alias("_some")).where("_some").select(time)
    return df.join(some, time, "left_semi")


def time_slice(df: DataFrame, time: str, which: str) -> DataFrame:
    """Rows of the first, middle or last time, or of a date."""
    if which not in ("first", "middle", "last"):
        return df.where(F.to_date(time) == F.lit(which).cast("date"))
    axis = df.select(time).where(F.col(time).isNotNull()).distinct()
    w = Window.orderBy(time)  # distinct times
    axis = axis.select(time, F.row_number().over(w).alias("_k"), F.count("*").over(Window.partitionBy()).alias("_n"))
    at = {"first": F.lit(1), "middle": (F.floor(F.col("_n") / 2) + 1), "last": F.col("_n")}[which]
    return df.join(F.broadcast(axis.where(F.col("_k") == at).select(time)), time, "left_semi")


def unpivot_arrays(df: DataFrame, keys: list[str], array: str, position: str, value: str) -> DataFrame:
    """A row for each element of an array column."""
    return df.select(*keys, F.posexplode(array).alias(position, value))


def fresh_name(name: str, source: str, taken: set[str]) -> str:
    """name, or name_source, or that with a number, whichever is free."""
    if name not in taken:
        return name
    base, k = f"{name}_{source}", 1
    while (out := base if k == 1 else f"{base}_{k}") in taken:
        k += 1
    return out


def add_columns(df: DataFrame, more: DataFrame, on: list[str], source: str) -> DataFrame:
    """df with more's columns, joined by key, under names that don't clash."""
    taken, names = set(df.columns), {}
    for c in more.columns:
        if c not in on:
            names[c] = fresh_name(c, source, taken)
            taken.add(names[c])
    return df.join(more.select(*on, *(F.col(c).alias(n) for c, n in names.items())), on, "left")


def without_hard_target(df: DataFrame, target: str) -> DataFrame:
    return df.drop(f"{target}_hard")


def single_precision(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c, t in df.dtypes if t == "double"})
