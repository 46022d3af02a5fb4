"""Operators over a grid's neighbourhood. Grids must be dense (axes.densify)."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .axes import KEYS, Keys
from .temporal import known


def _odd(sizes: list[int]) -> list[int]:
    for w in sizes:
        if w < 3 or w % 2 == 0:
            warnings.warn(f"window {w} isn't odd and 3 or more, and left out", stacklevel=3)
    return [w for w in sizes if w >= 3 and w % 2]


def window_stats(df: DataFrame, variables: list[str], sizes: list[int], stats: list[str], min_periods: int = 1, keys: Keys = KEYS) -> DataFrame:
    """{v}_{stat}{size}: mean, std (population), min, max or median over size x size points, cut at the borders.

    Sums and extremes are separable: a pass along each row, then a pass along columns over its results, so that
    the cost is 2 size and not size squared. Values are centred by the time step's mean before squaring. The
    median isn't separable and takes a join with offsets.
    """
    variables, sizes = known(df, variables, "window"), _odd(sizes)
    separable = [s for s in stats if s != "median"]
    if separable and variables and sizes:
        centre = df.groupBy(keys.time).agg(*(F.avg(v).alias(f"_m_{v}") for v in variables))
        df = df.join(centre, keys.time)
        row = lambda r: Window.partitionBy(keys.time, keys.lat).orderBy(keys.lon).rangeBetween(-r, r)
        column = lambda r: Window.partitionBy(keys.time, keys.lon).orderBy(keys.lat).rangeBetween(-r, r)
        first, second, out = {}, {}, {}
        for v in variables:
            x = F.col(v) - F.col(f"_m_{v}")
            for w in sizes:
                r, p = w // 2, f"_{v}_{w}_"
                first |= {p + "n": F.count(v).over(row(r)), p + "s": F.sum(x).over(row(r)), p + "q": F.sum(x * x).over(row(r)), p + "lo": F.min(v).over(row(r)), p + "hi": F.max(v).over(row(r))}
                second |= {p + "N": F.sum(p + "n").over(column(r)), p + "S": F.sum(p + "s").over(column(r)), p + "Q": F.sum(p + "q").over(column(r)), p + "LO": F.min(p + "lo").over(column(r)), p + "HI": F.max(p + "hi").over(column(r))}
                n, mean = F.col(p + "N"), F.col(p + "S") / F.nullif(p + "N", F.lit(0))
                made = {"mean": F.col(f"_m_{v}") + mean, "std": F.sqrt(F.greatest(F.col(p + "Q") / F.nullif(p + "N", F.lit(0)) - mean * mean, F.lit(0.0))), "min": F.col(p + "LO"), "max": F.col(p + "HI")}
                out |= {f"{v}_{s}{w}": F.when(n >= max(1, min_periods), made[s]) for s in separable}
        df = df.withColumns(first).withColumns(second).withColumns(out)
        df = df.drop(*first, *second, *(f"_m_{v}" for v in variables))
    if "median" in stats:
        for w in sizes:
            df = _median(df, variables, w, min_periods, keys)
    return df


def _median(df: DataFrame, variables: list[str], size: int, min_periods: int, keys: Keys) -> DataFrame:
    r = size // 2
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-r, r + 1) for b in range(-r, r + 1)))
    sent = df.select(keys.time, F.explode(offsets).alias("_o"), keys.lat, keys.lon, *variables)
    sent = sent.select(keys.time, (F.col(keys.lat) + F.col("_o.a")).alias(keys.lat), (F.col(keys.lon) + F.col("_o.b")).alias(keys.lon), *variables)
    made = sent.groupBy(*keys.all).agg(*(F.when(F.count(v) >= max(1, min_periods), F.percentile(v, F.lit(0.5))).alias(f"{v}_median{size}") for v in variables))
    return df.join(made, keys.all, "left")


def slope(v: Column, along: Window, spacing: float) -> Column:
    """Central difference, one-sided at the ends of the axis."""
    d, last, next_ = F.lit(float(spacing)), F.lag(v).over(along), F.lead(v).over(along)
    first_row, last_row = F.row_number().over(along) == 1, F.lead(F.lit(1)).over(along).isNull()
    return F.when(first_row & last_row, F.lit(None).cast("double")).when(first_row, (next_ - v) / d).when(last_row, (v - last) / d).otherwise((next_ - last) / (2 * d))


def gradients(df: DataFrame, variables: list[str], lat_step: float = 1.0, lon_step: float = 1.0, axis_order: str = "ascending", keys: Keys = KEYS) -> DataFrame:
    """{v}_grad_lat, {v}_grad_lon, {v}_grad_mag. Steps are absolute; axis_order `stored` follows a descending latitude."""
    lat = F.col(keys.lat).desc() if axis_order == "stored" else F.col(keys.lat)
    down, across = Window.partitionBy(keys.time, keys.lon).orderBy(lat), Window.partitionBy(keys.time, keys.lat).orderBy(keys.lon)
    variables = known(df, variables, "gradient")
    df = df.withColumns({f"{v}_grad_lat": slope(F.col(v), down, abs(lat_step)) for v in variables})
    df = df.withColumns({f"{v}_grad_lon": slope(F.col(v), across, abs(lon_step)) for v in variables})
    return df.withColumns({f"{v}_grad_mag": F.sqrt(F.pow(f"{v}_grad_lat", F.lit(2)) + F.pow(f"{v}_grad_lon", F.lit(2))) for v in variables})


def differentiate(v: Column, x: Column, along: Window) -> Column:
    """Derivative by an uneven, signed coordinate: second order inside, first order at the ends."""
    pv, nv, px, nx = F.lag(v).over(along), F.lead(v).over(along), F.lag(x).over(along), F.lead(x).over(along)
    a, b = x - px, nx - x
    inside = (a * a * nv - b * b * pv + (b * b - a * a) * v) / (a * b * (a + b))
    return F.when(px.isNull() & nx.isNull(), F.lit(None).cast("double")).when(px.isNull(), (nv - v) / b).when(nx.isNull(), (v - pv) / a).otherwise(inside)
