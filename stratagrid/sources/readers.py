"""Reading cubes: names of coordinates are made uniform, NaN becomes NULL, filters reach the scan."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import null_nan, year_month_of
from ..operators.reshape import region

#: Names that sources use for the coordinates.
COORDINATES = {"date": "time", "valid_time": "time", "lat": "latitude", "lon": "longitude"}


def uniform_names(df: DataFrame) -> DataFrame:
    """Coordinates under their common names; a source's own column of that name stays."""
    for old, new in COORDINATES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: null_nan(F.col(c)).cast(t) for c, t in df.dtypes if t in ("double", "float")})


def read_cube(spark: SparkSession, path: str | list[str], variables: list[str] | None = None, years: list[int] | None = None, lat_range: tuple[float, float] | None = None, lon_range: tuple[float, float] | None = None, source: str = "parquet") -> DataFrame:
    """A cube from a table with time, latitude, longitude and variables, partitioned by `year` or not.

    Absent variables are left out; absent years give no rows. Any Spark source works, Zarr and NetCDF stores
    through `register_sources` where their libraries are installed.
    """
    df = uniform_names(spark.read.format(source).load(path))
    if years is not None:
        df = df.where(F.col("year").isin(years) if "year" in df.columns else F.year("time").isin(years))
    df = region(df, "latitude", "longitude", lat_range, lon_range)
    if variables is not None:
        df = df.select("time", "latitude", "longitude", *(v for v in variables if v in df.columns))
    return nan_to_null(df)


def target_of(df: DataFrame, name: str | None = None) -> str:
    """The target's column: the one named, else the only variable."""
    rest = [c for c in df.columns if c not in ("time", "latitude", "longitude", "year", "month")]
    if name in rest:
        return name
    if len(rest) == 1:
        return rest[0]
    raise ValueError(f"no target {name} among {rest}")


def sniffed(df: DataFrame, candidates: list[str]) -> str:
    """The first candidate that the table has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {candidates} among {df.columns}")


def read_monthly(spark: SparkSession, path: str, source: str = "parquet") -> DataFrame:
    """Files whose names contain _YYYY_MM_, with columns file_year and file_month.

    A window over the whole table sees the months beside each year, so that no file is read twice.
    """
    df = spark.read.format(source).load(path)
    year, month = year_month_of(F.col("_metadata.file_name"))
    return uniform_names(df.withColumns({"file_year": year, "file_month": month}))


def latest(df: DataFrame, time: str = "time") -> DataFrame:
    """Rows of the last time of a raster that has several."""
    return df.join(F.broadcast(df.agg(F.max(time).alias(time))), time, "left_semi") if time in df.columns else df


def load_config(path: str) -> dict:
    """Configuration file, YAML or JSON; `features` at the top is also put into `data`."""
    text = Path(path).read_text()
    try:
        import yaml

        config = yaml.safe_load(text)
    except ModuleNotFoundError:
        import json

        config = json.loads(text)
    if "features" in config:
        config.setdefault("data", {}).setdefault("features", config["features"])
    return config


def register_sources(spark: SparkSession) -> list[str]:
    """Registers the `gridstore` source for stores that xarray opens, if xarray is installed; the names registered."""
    try:
        import xarray  # noqa: F401
    except ModuleNotFoundError:
        return []
    from ..shipping import ship
    from .gridstore import GridStore

    ship(spark)
    spark.dataSource.register(GridStore)
    return [GridStore.name()]
