"""Profiles of tables: statistics, gaps, correlation, histograms, drift, maps."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid_cell
from .evaluate import ratio


def long(df: DataFrame, variables: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep, variable, value): a row for each variable."""
    return df.select(*(keep or []), *(F.col(v).cast("double").alias(v) for v in variables)).unpivot(keep or [], variables, "variable", "value")


#: Ranges that a variable's values are cut into before its quantiles are looked for.
RANGES = 256


def exact_quantiles(df: DataFrame, variables: list[str], levels: list[float]) -> DataFrame:
    """(variable, level, value), exact and linear between neighbours; NULL for a variable without values.

    Equal values are combined first. A sketch cuts each variable into ranges, their counts tell in which ranges
    the ranks lie, and only these are sorted: no task holds a variable.
    """
    values = long(df, variables).where("value IS NOT NULL").groupBy("variable", "value").agg(F.count("*").alias("n"))
    cuts = values.groupBy("variable").agg(F.percentile_approx("value", F.array(*(F.lit(k / RANGES) for k in range(1, RANGES))), 4 * RANGES).alias("cuts"))
    at = F.aggregate("cuts", F.lit(0), lambda k, c: k + F.when(c < F.col("value"), 1).otherwise(0))
    ranged = values.join(F.broadcast(cuts), "variable").select("variable", "value", "n", at.alias("part"))  # a row for a variable
    sums = ranged.groupBy("variable", "part").agg(F.sum("n").alias("size"))
    upto = Window.partitionBy("variable").orderBy("part")  # RANGES rows at most
    sums = sums.withColumn("before", F.sum("size").over(upto) - F.col("size")).withColumn("total", F.sum("size").over(Window.partitionBy("variable")))
    place = F.col("level") * (F.col("total") - 1)
    ranks = sums.select("*", F.explode(F.array(*(F.lit(float(x)) for x in sorted(set(levels))))).alias("level")).withColumn("place", place)
    ranks = ranks.select("*", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank")).where("rank >= before AND rank < before + size")
    wanted = ranks.select("variable", "part", "before").distinct()
    within = Window.partitionBy("variable", "part").orderBy("value")
    placed = ranged.join(F.broadcast(wanted), ["variable", "part"]).select("variable", "part", "value", (F.col("before") + F.sum("n").over(within)).alias("end"), "n")  # two ranges for a level and variable
    found = placed.join(F.broadcast(ranks.select("variable", "part", "level", "place", "rank")), ["variable", "part"]).where("rank >= end - n AND rank < end")
    low, high = F.min_by("value", "rank"), F.max_by("value", "rank")
    made = found.groupBy("variable", "level").agg((low + (F.first("place") - F.min("rank")) * (high - low)).alias("value"))
    every = df.sparkSession.createDataFrame([(v, float(x)) for v in variables for x in levels], "variable string, level double")
    return every.join(made, ["variable", "level"], "left")


def describe(df: DataFrame, variables: list[str]) -> DataFrame:
    """count, nulls, null_pct, min, max, mean, std (population), q1, median, q3 of each variable."""
    made = long(df, variables).groupBy("variable").agg(
        F.count("*").alias("rows"), F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
    )
    at = lambda x: F.max(F.when(F.col("level") == x, F.col("value")))
    quarters = exact_quantiles(df, variables, [0.25, 0.5, 0.75]).groupBy("variable").agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    nulls = F.col("rows") - F.col("n")
    return made.join(quarters, "variable", "left").select("variable", "n", nulls.alias("nulls"), (ratio(nulls, F.col("rows")) * 100).alias("null_pct"), "min", "max", "mean", "std", "q1", "median", "q3")


def quantiles(df: DataFrame, variable: str, levels: list[float]) -> DataFrame:
    """(level, value), exact and linear between neighbours."""
    return exact_quantiles(df, [variable], levels).select("level", "value")


def missing(df: DataFrame, variables: list[str]) -> DataFrame:
    """(variable, rows, nulls, null_pct)."""
    made = long(df, variables).groupBy("variable").agg(F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"))
    return made.withColumn("null_pct", ratio(F.col("nulls"), F.col("rows")) * 100)


def correlations(df: DataFrame, variables: list[str]) -> DataFrame:
    """(a, b, r): Pearson's r of each pair, over rows that have both; one pass for all pairs."""
    pairs = list(itertools.combinations(variables, 2))
    made = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}~{b}") for a, b in pairs))
    parts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}~{b}").alias("r")) for a, b in pairs))
    return made.select(F.inline(parts))


def histogram(df: DataFrame, variable: str, bins: int = 50) -> DataFrame:
    """(bin, low, n): equal bins from the least to the greatest value, which the last one includes."""
    v = F.col(variable).cast("double")
    edge = df.agg(F.min(v).alias("_a"), F.max(v).alias("_b"))
    step = F.nullif((F.col("_b") - F.col("_a")) / bins, F.lit(0.0))  # NULL where all values are equal: one bin
    at = F.least(F.coalesce(F.floor((v - F.col("_a")) / step), F.lit(0)), F.lit(bins - 1))
    made = df.where(v.isNotNull()).crossJoin(F.broadcast(edge)).groupBy(at.cast("int").alias("bin"), "_a", "_b").agg(F.count("*").alias("n"))
    return made.select("bin", (F.col("_a") + F.col("bin") * (F.col("_b") - F.col("_a")) / bins).alias("low"), "n")


def class_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, pct)."""
    made = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return made.withColumn("pct", ratio(F.col("n"), F.sum("n").over(Window.partitionBy())) * 100)


def rate(df: DataFrame, column: str) -> DataFrame:
    """positives, rate and mean, min, max of a label."""
    c = F.col(column)
    return df.agg(F.count_if(c == 1).alias("positives"), ratio(F.count_if(c == 1), F.count(c)).alias("rate"), F.avg(c.cast("double")).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"))


def drift(df: DataFrame, target: Column, variables: list[str]) -> DataFrame:
    """Means and standard deviations outside and inside `target`, and the shift in standard deviations of the former."""
    made = long(df.withColumn("_in", target), variables, ["_in"]).groupBy("variable").agg(
        F.avg(F.when(~F.col("_in"), F.col("value"))).alias("ref_mean"), F.avg(F.when(F.col("_in"), F.col("value"))).alias("target_mean"),
        F.stddev_pop(F.when(~F.col("_in"), F.col("value"))).alias("ref_std"), F.stddev_pop(F.when(F.col("_in"), F.col("value"))).alias("target_std"),
    )
    score = (F.col("target_mean") - F.col("ref_mean")) / F.nullif("ref_std", F.lit(0.0))
    return made.withColumn("drift_score", score).withColumn("abs_drift", F.abs("drift_score")).orderBy(F.col("abs_drift").desc(), "variable")


def gridded(df: DataFrame, lat: str, lon: str, value: str, how: str = "mean", per_unit: int = 4) -> DataFrame:
    """(lat, lon, value) on a grid of 1/per_unit: mean, sum or count; other names mean."""
    agg = {"sum": F.sum(value), "count": F.count(value)}.get(how, F.avg(value))
    return df.groupBy(grid_cell(F.col(lat), per_unit).alias("lat"), grid_cell(F.col(lon), per_unit).alias("lon")).agg(agg.alias("value"))


def cell_errors(df: DataFrame, truth: str, predicted: str, cell: list[str]) -> DataFrame:
    e = F.col(predicted) - F.col(truth)
    return df.groupBy(*cell).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean_error"), F.avg(e * e).alias("mse"))


def cell_recall(df: DataFrame, truth: str, predicted: str, cell: list[str]) -> DataFrame:
    """recall of each cell, NULL without an event; event_pct, the share of events."""
    hit = (F.col(truth) == 1) & (F.col(predicted) == 1)
    return df.groupBy(*cell).agg((F.count_if(hit).cast("double") / F.nullif(F.count_if(F.col(truth) == 1).cast("double"), F.lit(0.0))).alias("recall"), (F.avg(F.col(truth).cast("double")) * 100).alias("event_pct"))


def plot_range(df: DataFrame, variable: str, symmetric: bool = False) -> DataFrame:
    """(low, high): 2nd and 98th percentile, mirrored about zero if symmetric."""
    made = exact_quantiles(df, [variable], [0.02, 0.98]).agg(F.min_by("value", "level").alias("a"), F.max_by("value", "level").alias("b"))
    far = F.greatest(F.abs("a"), F.abs("b"))
    return made.select((-far if symmetric else F.col("a")).alias("low"), (far if symmetric else F.col("b")).alias("high"))


def monthly_maps(df: DataFrame, month: Column, variables: list[str], cell: list[str]) -> DataFrame:
    """(month, cell, variables): means of each cell over all years' days of a month."""
    return df.groupBy(month.alias("month"), *cell).agg(*(F.avg(v).alias(v) for v in variables))


def means_and_peaks(df: DataFrame, by: list[str], variables: list[str]) -> DataFrame:
    """mean_{v} and max_{v} of each variable: by time a series, by cell a map."""
    return df.groupBy(*by).agg(*(f(v).alias(f"{name}_{v}") for v in variables for name, f in (("mean", F.avg), ("max", F.max))))


def pivot_grid(df: DataFrame, lat: str, lon: str, value: str, longitudes: list) -> DataFrame:
    """A row for each latitude, a column lon_{x} for each longitude named."""
    made = df.groupBy(lat).pivot(lon, longitudes).agg(F.first(value))
    return made.select(lat, *(F.col(str(x)).alias(f"lon_{x}") for x in longitudes))


def top(df: DataFrame, by: str, n: int = 20, ties: str | None = None) -> DataFrame:
    return df.orderBy(F.col(by).desc(), *([ties] if ties else [])).limit(n)
