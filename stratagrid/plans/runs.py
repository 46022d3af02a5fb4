"""From a whole configuration to the table that a model learns from: sections `data`, `feature_engineering`,
`label_smoothing`, `binarization`, `sample_weights`, `regression_predictions` and `training`.

Order: box and years, the target's nearest times, smoothing by month, finite targets, binary label, weights, sampling
by month; then features of each year with days of context before it, at the nearest grid points, and outside
predictions. Features drop no rows, so that they meet the sampled target only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import align, axes, labels, reshape, sampling
from ..operators.axes import Keys
from .features import build

#: Seconds between the time axes of two years' cubes, over any distance in time within one.
APART = 100_000_000_000
#: Distance between the row numbers of two years' cubes; a latitude axis has fewer values.
ROWS_APART = 100_000
#: Tolerances of the nearest match: seconds, and degrees of latitude and longitude.
SECONDS, DEGREES = 43_200, 0.6

_OWN = Keys(time="_x", lat="_i", lon="_j")


def context_days(config: dict) -> int:
    """Days before a year that its features look back on: the longest lag or period, thrice the longest span, and 5."""
    plan = config.get("feature_engineering") or {}
    if not plan.get("enabled", True):
        return 0
    part = lambda section, values: (plan.get(section) or {}).get(values) or []
    return max([0, *part("lag", "lags"), *(3 * s for s in part("ewm", "spans")), *part("temporal_diff", "periods")]) + 5


def _seconds(time: Column) -> Column:
    """Seconds since 1970 by the calendar, whatever the session's time zone."""
    return F.unix_date(F.to_date(time)).cast("long") * 86_400 + F.hour(time) * 3_600 + F.minute(time) * 60 + F.floor(F.second(time))


def by_years(df: DataFrame, years: list[int], days: int, time: str = "time") -> DataFrame:
    """Rows of the years and of so many days before each, with `_year`: a row in the context of the next year comes twice."""
    start = lambda y: F.lit(f"{y}-01-01").cast("timestamp_ntz")
    back = F.expr(f"INTERVAL {days} DAYS")
    df = df.where((F.col(time) >= start(min(years)) - back) & (F.col(time) < start(max(years) + 1)))
    at = F.array(*(F.when((F.col(time) >= start(y) - back) & (F.col(time) < start(y + 1)), F.lit(y)) for y in sorted(set(years))))
    return df.withColumn("_year", F.explode(F.array_compact(at)))


def _boxed(df: DataFrame, data: dict) -> DataFrame:
    return reshape.region(df, "latitude", "longitude", data.get("latitude_range"), data.get("longitude_range"))


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumn("_x", F.col("_year").cast("long") * APART + _seconds(F.col("time")))


def yearly_features(features: DataFrame, config: dict, years: list[int], climate: DataFrame | None = None, steps: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Features of each year and its context. A year with its context is a cube of its own: positions are set apart by year,
    so that one plan serves all years and no operator reaches from one into another."""
    data = config["data"]
    wanted = config.get("features") or data.get("features")
    df = _boxed(features, data)
    if wanted:
        df = df.select("time", "latitude", "longitude", *(v for v in wanted if v in df.columns))
    df = axes.with_positions(df, {"latitude": "_i", "longitude": "_j"})
    df = _placed(by_years(df, years, context_days(config))).withColumn("_i", F.col("_year") * ROWS_APART + F.col("_i"))
    return build(df, config.get("feature_engineering") or {}, "time", "latitude", "longitude", *steps, climate=climate, keys=_OWN).drop("_i", "_j")


#: Names of the features' coordinates beside the target's.
_SIDE = {"_x": "_fx", "latitude": "_flat", "longitude": "_flon"}


def timed(target: DataFrame, offered: DataFrame) -> DataFrame:
    """The target's rows that have features near enough in time, with `_fx`, that time on the axis of their year."""
    rows = target.withColumn("_x", F.year("time").cast("long") * APART + _seconds(F.col("time")))
    return rows.join(axes.nearest_map(rows.select("_x"), offered.select("_fx"), "_x", "_fx", SECONDS), "_x").drop("_x")


def with_features(rows: DataFrame, features: DataFrame, wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """rows with the features at `_fx` and the nearest grid point; beyond the tolerance they are NULL.

    wanted and offered hold the coordinates of rows and features, without the plans that made these.
    """
    features = features.drop("time", "_year").withColumnsRenamed(_SIDE)
    places = {"latitude": "_flat", "longitude": "_flon"}
    return align.nearest_grid(rows, features, places, DEGREES, on=["_fx"], wanted=wanted, offered=offered).drop("_fx", "_flat", "_flon")


def prepared(features: DataFrame, target: DataFrame, config: dict, years: list[int] | None = None, climate: DataFrame | None = None, regression: DataFrame | None = None, steps: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(time, latitude, longitude, target, features ...) of the configured years, in single precision.

    features, target: time (timestamp_ntz), latitude, longitude and variables; a target under another name than the
    configured one is taken if it is the only variable. regression: (time, latitude, longitude, reg_pred_anomaly),
    0 where it has no row. With smoothing, `{target}_hard` keeps the label as it was; with binarization there is
    `target_binary`, with weights `weight`. Empty tables and years without data give no rows.
    """
    data = config["data"]
    years = sorted(set(years or data["train_years"]))
    name = data["target_var"]
    rows = reshape.of_years(_boxed(target, data), "time", years)
    if name not in rows.columns:
        from ..sources import target_of

        rows = rows.withColumnRenamed(target_of(rows), name)
    wanted, offered = rows, _placed(by_years(_boxed(features, data), years, context_days(config))).select(*_SIDE).withColumnsRenamed(_SIDE)
    rows = timed(rows, offered)
    smooth = config.get("label_smoothing") or {}
    month = {"_y": F.year("time"), "_m": F.month("time")}
    rows = rows.withColumns(month)
    if smooth.get("enabled", False):
        rows = labels.smoothed(
            rows.withColumn(f"{name}_hard", F.col(name)), name, "_smooth", (smooth.get("temporal_sigma", 1.0), smooth.get("temporal_radius", 3)), (smooth.get("spatial_sigma", 1.0), smooth.get("spatial_radius", 1)),
            smooth.get("min_smooth_value", 0.0), smooth.get("max_smooth_value", 1.0), list(month), Keys("time", "latitude", "longitude"),
        )
        rows = rows.withColumn(name, F.when(F.col(name).isNotNull(), F.col("_smooth"))).drop("_smooth")
    rows = reshape.finite_target(rows, name)
    if (rule := config.get("binarization") or {}).get("enabled", False):
        rows = rows.withColumn("target_binary", labels.binarised(F.col(name), rule.get("threshold_val", 10.0), "cold" if rule.get("operator", "less") == "less" else "heat"))
    if tiers := config.get("sample_weights"):
        weights = tuple(float(tiers.get(f"weight_{k}", w)) for k, w in (("normal", 1.0), ("moderate", 2.0), ("extreme", 5.0), ("very_extreme", 10.0)))
        cuts = tuple(float(tiers.get(f"threshold_{k}", c)) for k, c in (("moderate", 5.0), ("extreme", 10.0), ("very_extreme", 15.0)))
        rows = rows.withColumn("weight", labels.tier_weight(F.col(name), weights, cuts))
    rows = sampled(rows, config, list(month)).drop(*month)
    rows = with_features(rows, yearly_features(features, config, years, climate, steps), wanted, offered)
    if regression is not None and (config.get("regression_predictions") or {}).get("enabled", True):
        rows = align.quantised_lookup(rows, regression, "time", "latitude", "longitude", "reg_pred_anomaly", ["time"])
    keep = {"latitude", "longitude"}
    return rows.withColumns({c: F.col(c).cast("float") for c, t in rows.dtypes if t == "double" and c not in keep})


def sampled(rows: DataFrame, config: dict, groups: list[str]) -> DataFrame:
    """Of each group, the configured share of rows; with `tail_preserving` all rows at or over the thresholds among them."""
    data = config["data"]
    share, rule = float(data.get("sample_fraction", 1.0)), data.get("subsampling") or {}
    if share >= 1.0:
        return rows
    rows = rows.withColumn("_draw", sampling.draw_key("time", "latitude", "longitude", seed=data.get("random_seed", 42)))
    if str(rule.get("mode", "")).lower().replace("-", "_") in ("tail_preserving", "tail_preserve"):
        if rule.get("positive_threshold") is None:
            raise ValueError("data.subsampling.positive_threshold must be set")
        near = rule.get("near_miss_threshold")
        positive = float(rule["positive_threshold"])
        rows = sampling.tail_preserving(rows, data["target_var"], share, positive, positive if near is None else float(near), groups, "_draw")
    else:
        rows = sampling.group_share(rows, groups, share, "_draw")
    return rows.drop("_draw")


def split(rows: DataFrame, config: dict) -> tuple[DataFrame, DataFrame]:
    """(training, validation) by years: the last share `training.validation_size` of them validates."""
    return sampling.temporal_split(rows, F.year("time"), (config.get("training") or {}).get("validation_size", 0.2))
