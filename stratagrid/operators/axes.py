"""Axes of a cube: integer positions, dense grids, and nearest-neighbour maps between axes.

Nearest joins run on axes (distinct coordinates, few) and not on facts; the facts then meet in an equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Keys:
    """Names of a cube's position columns."""

    time: str = "t"
    lat: str = "lat_i"
    lon: str = "lon_i"

    @property
    def cell(self) -> list[str]:
        return [self.lat, self.lon]

    @property
    def all(self) -> list[str]:
        return [self.time, self.lat, self.lon]

    def series(self) -> WindowSpec:
        """A cell's values in time; all operators share it, so that Spark sorts once."""
        return Window.partitionBy(*self.cell).orderBy(self.time)


KEYS = Keys()


#: Ranges that an axis is cut into before it is numbered or merged with another one.
RANGES = 256
#: How much wider than the tolerance the ranges of a nearest map are, so that rounding can't part two beyond neighbours.
WIDER = 1.01


def _ranged(values: DataFrame, column: str) -> DataFrame:
    """values with `_part`, the number of the range that the column lies in; a sketch of the values cuts the ranges.

    An axis may be as long as the facts (times of events): no window over it then holds it as a whole.
    """
    cuts = values.agg(F.percentile_approx(column, F.array(*(F.lit(k / RANGES) for k in range(1, RANGES))), 4 * RANGES).alias("_cuts"))
    at = F.aggregate("_cuts", F.lit(0), lambda k, c: k + F.when(c < F.col(column), 1).otherwise(0))
    return values.crossJoin(F.broadcast(cuts)).withColumn("_part", F.coalesce(at, F.lit(0))).drop("_cuts")  # one row


def axis(df: DataFrame, column: str, position: str, descending: bool = False) -> DataFrame:
    """(column, position): distinct values, numbered from 0."""
    ranged = _ranged(df.select(column).where(F.col(column).isNotNull()).distinct(), column)
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    numbered = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(column))).join(F.broadcast(sizes), "_part")
    rank = F.col("_before") + F.col("_k") - 1
    return numbered.select(column, (F.col("_all") - 1 - rank if descending else rank).cast("int").alias(position))


def with_positions(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with a position column for each coordinate column, as {coordinate: position}."""
    found = df.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns))  # as long as a grid's sides
    for column, position in columns.items():
        df = df.join(F.broadcast(found.select(F.posexplode(column).alias(position, column))), column)
    return df


def densify(df: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Every combination of the times, latitudes and longitudes that occur; NULL where df had no row.

    One pass finds the three axes; times are then dealt out, and each is filled up with the grid where it lies.
    """
    t, i, j = keys.all
    found = df.agg(F.collect_set(t).alias("_t"), F.collect_set(i).alias("_i"), F.collect_set(j).alias("_j"))  # as long as the axes
    frame = found.select(F.explode("_t").alias(t), "_i", "_j").repartition(t).select(t, F.explode("_i").alias(i), "_j").select(t, i, F.explode("_j").alias(j))
    return frame.join(df, keys.all, "left")


def nearest_map(wanted: DataFrame, offered: DataFrame, left: str, right: str, tolerance: float | None = None, ties: str = "larger") -> DataFrame:
    """(left, right): for each wanted coordinate the nearest offered one, none beyond the tolerance.

    ties: `larger` or `smaller` coordinate of two equally near ones. Both axes are merged in sorted ranges instead
    of being crossed: ranges as wide as the tolerance, so that only those beside one can hold what it lacks, or
    without a tolerance ranges that a sketch cuts.
    """
    both = offered.select(F.col(right).alias("x"), F.lit(0).alias("side")).union(wanted.select(F.col(left).alias("x"), F.lit(1).alias("side"))).where("x IS NOT NULL").distinct()
    own, timed = F.when(F.col("side") == 0, F.col("x")), dict(both.dtypes)["x"].startswith("timestamp")
    number = (lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6) if timed else F.col
    both = _ranged(both, "x") if tolerance is None else both.withColumn("_part", F.floor(number("x") / F.lit(tolerance * WIDER)).cast("long"))
    low = Window.partitionBy("_part").orderBy("x", "side").rowsBetween(Window.unboundedPreceding, 0)
    high = Window.partitionBy("_part").orderBy("x", F.col("side").desc()).rowsBetween(0, Window.unboundedFollowing)
    ends = both.groupBy("_part").agg(F.min(own).alias("_min"), F.max(own).alias("_max"))
    if tolerance is None:
        beside = Window.orderBy("_part")  # RANGES rows at most
        ends = ends.select(
            "_part", F.max("_max").over(beside.rowsBetween(Window.unboundedPreceding, -1)).alias("_under"), F.min("_min").over(beside.rowsBetween(1, Window.unboundedFollowing)).alias("_over")
        )
    else:
        none = F.lit(None).cast(dict(both.dtypes)["x"])
        sent = F.array(*(F.struct((F.col("_part") + step).alias("_part"), under.alias("_under"), over.alias("_over")) for step, under, over in ((1, F.col("_max"), none), (-1, none, F.col("_min")))))
        ends = ends.where("_min IS NOT NULL").select(F.inline(sent)).groupBy("_part").agg(F.max("_under").alias("_under"), F.min("_over").alias("_over"))
    seen = both.withColumn("below", F.last(own, ignorenulls=True).over(low)).withColumn("above", F.first(own, ignorenulls=True).over(high)).where("side = 1")
    seen = seen.join(ends, "_part", "left").withColumns({"below": F.coalesce("below", "_under"), "above": F.coalesce("above", "_over")})
    gap_below, gap_above = (number("x") - number("below"), number("above") - number("x")) if timed else (F.col("x") - F.col("below"), F.col("above") - F.col("x"))
    closer = gap_above <= gap_below if ties == "larger" else gap_above < gap_below
    up = F.col("below").isNull() | (F.col("above").isNotNull() & closer)
    found = seen.select(F.col("x").alias(left), F.when(up, F.col("above")).otherwise(F.col("below")).alias(right), F.when(up, gap_above).otherwise(gap_below).alias("_gap")).where(F.col(right).isNotNull())
    if tolerance is not None:
        found = found.where(F.col("_gap") <= tolerance)
    return found.drop("_gap")
