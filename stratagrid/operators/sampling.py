"""Deterministic sampling and splitting. Order comes from a hash of a key, so that any engine draws the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group's ranks come from counts of slices by so many digits of the hash, and from a sort within a slice: 65,536
#: slices, so that 10^12 rows are sorted by 15 million at once. Smaller tables have fewer slices that aren't empty.
SLICE_DIGITS = 4


def draw_key(*columns: str | Column, seed: int = 42) -> Column:
    """Hexadecimal digest that orders the draw."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns)))


def ranked(df: DataFrame, group: list[str], key: str, name: str = "_rank") -> DataFrame:
    """Rank of each row in its group by the key, from 1, without a group's rows in one task.

    The key's leading digits slice the group: ranks within a slice are sorted, ranks of slices are counted.
    """
    df = df.withColumn("_slice", F.substring(key, 1, SLICE_DIGITS))
    counts = df.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(key))
    df = df.withColumn("_within", within)
    on = [df[c].eqNullSafe(counts[c]) for c in [*group, "_slice"]]
    joined = df.join(counts, on, "left") if on else df
    return joined.select(*(df[c] for c in df.columns if c not in ("_slice", "_within")), (df["_within"] + counts["_before"]).cast("long").alias(name))


def uniform(df: DataFrame, n: int, key: str) -> DataFrame:
    """Exactly n rows, or all if there are fewer: those with the least keys."""
    return ranked(df, [], key).where(F.col("_rank") <= n).drop("_rank")


def uniform_share(df: DataFrame, share: float, key: str) -> DataFrame:
    """int(rows * share) rows in a single pass over counts: an exact share without a sort of all rows."""
    return uniform(df, int(df.count() * share), key)


def group_share(df: DataFrame, groups: list[str], share: float, key: str) -> DataFrame:
    """Of each group, round(rows * share) rows, halves to the even number: those with the least keys."""
    counts = df.groupBy(*groups).agg(F.bround(F.count("*") * F.lit(share)).alias("_most"))
    return ranked(df, groups, key).join(counts, groups).where(F.col("_rank") <= F.col("_most")).drop("_rank", "_most")


def tail_preserving(df: DataFrame, value: str, share: float, positive: float, near_miss: float, groups: list[str], key: str, mode: str = "positive_and_near_miss") -> DataFrame:
    """Of each group, all rows at or over a threshold, filled up from the rest to max(int(rows * share), 1) rows."""
    cut = positive if mode == "positive" else near_miss if mode == "near_miss" else min(positive, near_miss)
    keep = F.coalesce(F.col(value) >= cut, F.lit(False))
    df = df.withColumn("_keep", keep)
    counts = df.groupBy(*groups).agg(F.count("*").alias("_n"), F.count_if("_keep").alias("_kept"))
    counts = counts.withColumn("_need", F.greatest(F.greatest(F.floor(F.col("_n") * share), F.lit(1)) - F.col("_kept"), F.lit(0))).drop("_n", "_kept")
    out = ranked(df, [*groups, "_keep"], key).join(counts, groups)
    return out.where(F.col("_keep") | (F.col("_rank") <= F.col("_need"))).drop("_keep", "_rank", "_need")


def undersampled(df: DataFrame, label: str, ratio: int, key: str) -> DataFrame:
    """All positives, and ratio negatives for each of them at most."""
    positives = df.where(F.col(label) == 1).count()
    out = ranked(df.withColumn("_label", F.col(label)), ["_label"], key)
    return out.where((F.col("_label") == 1) | (F.col("_rank") <= ratio * positives)).drop("_label", "_rank")


def split_years(years: list[int], share: float) -> tuple[list[int], list[int]]:
    """(training, validation): the last years by share (under 1: of their number, rounded up; else that many)."""
    years = sorted(set(years))
    if len(years) < 2:
        raise ValueError("a split by time needs two years or more")
    n = max(1, math.ceil(len(years) * share)) if share < 1 else int(share)
    n = min(n, len(years) - 1)
    return years[:-n], years[-n:]


def temporal_split(df: DataFrame, year: Column, share: float) -> tuple[DataFrame, DataFrame]:
    """Rows of the earlier and of the last years; no year is in both."""
    years = [r[0] for r in df.select(year.alias("y")).where("y IS NOT NULL").distinct().collect()]
    train, valid = split_years(years, share)
    return df.where(year.isin(train)), df.where(year.isin(valid))
