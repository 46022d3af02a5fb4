"""Operators along a cell's time series: lags, differences, smoothing, rolling quantiles, filling."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..shipping import ship
from .axes import KEYS, Keys


def known(df: DataFrame, variables: list[str], what: str) -> list[str]:
    """Variables that df has; the others are named in a warning and left out."""
    for v in variables:
        if v not in df.columns:
            warnings.warn(f"{what}: no variable {v}", stacklevel=3)
    return [v for v in variables if v in df.columns]


def _above(values: list[int], least: int, what: str) -> list[int]:
    for x in values:
        if x < least:
            warnings.warn(f"{what}: {x} is under {least} and left out", stacklevel=3)
    return [x for x in values if x >= least]


def lags(df: DataFrame, variables: list[str], steps: list[int], keys: Keys = KEYS) -> DataFrame:
    """{v}_lag{k}: the value k rows earlier in the cell; by position, so gaps in time don't count."""
    w = keys.series()
    return df.withColumns({f"{v}_lag{k}": F.lag(v, k).over(w) for v in known(df, variables, "lag") for k in _above(steps, 1, "lag")})


def diffs(df: DataFrame, variables: list[str], periods: list[int], keys: Keys = KEYS) -> DataFrame:
    """{v}_diff{p}: the value less the one p rows earlier."""
    w = keys.series()
    return df.withColumns({f"{v}_diff{p}": F.col(v) - F.lag(v, p).over(w) for v in known(df, variables, "diff") for p in _above(periods, 1, "diff")})


def ewm_values(x: np.ndarray, span: int, block: int = 64) -> np.ndarray:
    """y0 = x0, y = a x + (1 - a) y before, a = 2 / (span + 1); NaN keeps the last y.

    Blocks of values are one product with a triangle of powers, so that n values take n / block steps.
    """
    y, has = np.full(len(x), np.nan), ~np.isnan(x)
    known_x = x[has]
    if len(known_x):
        a = 2.0 / (span + 1)
        powers = np.tril((1 - a) ** np.clip(np.subtract.outer(np.arange(block), np.arange(block)), 0, None)) * a
        decay, out, last = (1 - a) ** np.arange(1, block + 1), np.empty(len(known_x)), known_x[0]
        for at in range(0, len(known_x), block):
            part = known_x[at : at + block]
            n = len(part)
            out[at : at + n] = powers[:n, :n] @ part + decay[:n] * last
            last = out[at + n - 1]
        filled = np.cumsum(has) - 1
        y[filled >= 0] = out[filled[filled >= 0]]
    return y


def ewm(df: DataFrame, variables: list[str], spans: list[int], keys: Keys = KEYS) -> DataFrame:
    """{v}_ewm{span}: exponentially weighted mean along time; NULL keeps the last mean, leading NULLs stay.

    The recurrence has no window form, so a cell's series goes to one grouped call; a cell is as long as the
    time axis. The other columns pass through it as they are, so that nothing is joined back.
    """
    variables, spans = known(df, variables, "ewm"), _above(spans, 2, "ewm")
    names = [(v, s, f"{v}_ewm{s}") for v in variables for s in spans]
    if not names:
        return df
    ship(df.sparkSession)
    df = df.drop(*(n for _, _, n in names))

    def run(series):  # a pa.Table in and out
        series = series.take(pc.sort_indices(series, sort_keys=[(keys.time, "ascending")]))
        for v, s, name in names:
            y = ewm_values(series.column(v).cast(pa.float64()).to_numpy(), s)
            series = series.append_column(name, pa.array(y, mask=np.isnan(y)))
        return series

    return df.groupBy(*keys.cell).applyInArrow(run, StructType([*df.schema.fields, *(StructField(n, DoubleType()) for _, _, n in names)]))


def rolling_quantiles(df: DataFrame, variable: str, steps: int, quantiles: dict[str, float], centred: bool = False, keys: Keys = KEYS) -> DataFrame:
    """A column for each named quantile over `steps` rows, linear between neighbours, NULLs skipped.

    Trailing frames end at the row; centred ones begin steps // 2 rows before. NULL where the frame doesn't fit.
    """
    before, after = (steps // 2, steps // 2 - 1 + steps % 2) if centred else (steps - 1, 0)
    frame = keys.series().rowsBetween(-before, after)
    full = F.count(F.lit(1)).over(frame) == steps
    q = F.percentile(variable, F.array(*(F.lit(float(x)) for x in quantiles.values()))).over(frame)
    df = df.withColumn("_q", F.when(full, q))
    return df.withColumns({name: F.col("_q")[k] for k, name in enumerate(quantiles)}).drop("_q")


def forward_fill(df: DataFrame, variables: list[str], keys: Keys = KEYS) -> DataFrame:
    """{v}_ffill: the last value that isn't NULL; leading NULLs stay."""
    w = keys.series().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"{v}_ffill": F.last(v, ignorenulls=True).over(w) for v in known(df, variables, "fill")})


def season(df: DataFrame, time: str, month: bool = True, day_of_year: bool = True, annual: bool = True, semiannual: bool = True) -> DataFrame:
    """month, day_of_year, sin_annual, cos_annual, sin_semiannual, cos_semiannual as asked for."""
    from ..functions import harmonic

    t, out = F.col(time), {}
    if month:
        out["month"] = F.month(t)
    if day_of_year:
        out["day_of_year"] = F.dayofyear(t)
    for name, period, on in (("annual", 365.25, annual), ("semiannual", 182.625, semiannual)):
        if on:
            out |= {f"{kind}_{name}": harmonic(t, period, kind) for kind in ("sin", "cos")}
    return df.withColumns(out)
