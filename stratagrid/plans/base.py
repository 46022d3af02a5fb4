"""Frames that queries start from, over the star-schema tables, and the same frames as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quantised
from ..operators.axes import densify


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, lat_i, lon_i, v, u, n): months by a 5 x 5 grid of nations, mean order price, mean balance, orders."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("int")
    return joined.groupBy(month.alias("t"), F.floor(F.col("c_nationkey") / 5).cast("int").alias("lat_i"), (F.col("c_nationkey") % 5).cast("int").alias("lon_i")).agg(
        F.avg("o_totalprice").alias("v"), F.avg("c_acctbal").alias("u"), F.count("*").alias("n")
    )


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(cube(spark, sf_dir))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(h, x, n): mean value and number of events by the hour."""
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(F.avg("value").alias("x"), F.count("*").alias("n"))


def shown(df: DataFrame, *columns: str, keep: list[str]) -> DataFrame:
    """keep as they are, and columns off their rounding ties."""
    return df.select(*keep, *(quantised(F.col(c).cast("double")).alias(c) for c in columns))


CUBE = (
    "cube AS (SELECT CAST(year(o.o_orderdate) * 12 + month(o.o_orderdate) - 1 AS INT) AS t, CAST(floor(c.c_nationkey / 5) AS INT) AS lat_i, CAST(c.c_nationkey % 5 AS INT) AS lon_i,"
    " avg(o.o_totalprice) AS v, avg(c.c_acctbal) AS u, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2, 3)"
)
DENSE = CUBE + (
    ", dense AS (SELECT a.t, b.lat_i, c.lon_i, k.v, k.u, k.n FROM (SELECT DISTINCT t FROM cube) a CROSS JOIN (SELECT DISTINCT lat_i FROM cube) b CROSS JOIN (SELECT DISTINCT lon_i FROM cube) c"
    " LEFT JOIN cube k ON k.t = a.t AND k.lat_i = b.lat_i AND k.lon_i = c.lon_i)"
)
HOURLY = "hourly AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, avg(value) AS x, count(*) AS n FROM events GROUP BY 1)"


def q(x: str, name: str) -> str:
    """SQL of `quantised`."""
    return f"CAST(floor(({x}) * 1e4 + 5.137e-1) AS DOUBLE) / 1e4 AS {name}"
