"""From a configuration to one lazy table: the sections of `feature_engineering`, in a fixed order.

Order: temporal, wind speed and direction, lag, ewm, spatial, gradients, divergence and vorticity, temporal_diff,
climatology, wind_chill, advection, regional, anomaly. So a wind speed can be lagged, and `anomaly` replaces the
column of the same name from `climatology`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import climatology, physics, spatial, temporal
from ..operators.axes import KEYS, Keys
from ..operators.temporal import known


def _section(config: dict, name: str) -> dict | None:
    found = config.get(name)
    return found if isinstance(found, dict) and found.get("enabled", True) else None


def _wind(part: dict) -> tuple[str, str]:
    return part.get("u_var", "u10"), part.get("v_var", "v10")


def feature_names(base: list[str], config: dict) -> list[str]:
    """Columns that a plan yields over the base variables, in order, without repeats."""
    if not config.get("enabled", True):
        return list(base)
    out = list(base)
    if (p := _section(config, "temporal")) is not None:
        out += ["month"] * p.get("month", True) + ["day_of_year"] * p.get("day_of_year", True)
        out += ["sin_annual", "cos_annual"] * p.get("sin_cos_annual", True) + ["sin_semiannual", "cos_semiannual"] * p.get("sin_cos_semiannual", False)
    wind = _section(config, "wind_physics")
    if wind is not None:
        out += ["wind10_speed", "wind10_dir_sin", "wind10_dir_cos"]
    for section, values, name in (("lag", "lags", "{v}_lag{k}"), ("ewm", "spans", "{v}_ewm{k}")):
        if (p := _section(config, section)) is not None:
            out += [name.format(v=v, k=k) for v in p.get("variables", []) for k in p.get(values, [])]
    if (p := _section(config, "spatial")) is not None:
        out += [f"{v}_{s}{w}" for v in p.get("variables", []) for w in p.get("window_sizes", []) for s in p.get("stats", ["mean", "std"])]
    if (p := _section(config, "gradients")) is not None:
        out += [f"{v}_grad_{d}" for v in p.get("variables", []) for d in ("lat", "lon", "mag")]
        if wind is not None and set(_wind(wind)) <= set(p.get("variables", [])):
            out += ["wind10_div", "wind10_vort"]
    if (p := _section(config, "temporal_diff")) is not None:
        out += [f"{v}_diff{k}" for v in p.get("variables", []) for k in p.get("periods", [])]
    for section in ("climatology", "anomaly"):
        if (p := _section(config, section)) is not None:
            out += [f"{v}_anom" for v in p.get("variables", [])]
    out += [name for section, name in (("wind_chill", "wind_chill_index"), ("advection", "temp_advection")) if (config.get(section) or {}).get("enabled", False)]
    if (p := _section(config, "regional")) is not None:
        out += [f"{v}_global_{s}" for v in p.get("variables", []) for s in p.get("stats", ["mean", "std", "min", "max"])]
    return list(dict.fromkeys(out))


def build(df: DataFrame, config: dict, time: str = "time", latitude: str = "latitude", longitude: str = "longitude", lat_step: float = 1.0, lon_step: float = 1.0, climate: DataFrame | None = None, keys: Keys = KEYS, strict: bool = False) -> DataFrame:
    """df with all features of the plan. `time` is a date or timestamp column, keys name integer positions.

    climate: an outside climatology (dayofyear, cell, variables). strict: an error where two sections would yield
    the same column. Variables that df lacks are named in warnings and left out.
    """
    if not config.get("enabled", True):
        return df
    if strict and (twice := {v for v in (config.get("climatology") or {}).get("variables", []) if v in (config.get("anomaly") or {}).get("variables", [])}):
        raise ValueError(f"climatology and anomaly both yield columns for {sorted(twice)}")
    if (p := _section(config, "temporal")) is not None:
        df = temporal.season(df, time, p.get("month", True), p.get("day_of_year", True), p.get("sin_cos_annual", True), p.get("sin_cos_semiannual", False))
    wind = _section(config, "wind_physics")
    if wind is not None:
        df = physics.wind_speed_direction(df, *_wind(wind))
    if (p := _section(config, "lag")) is not None:
        df = temporal.lags(df, p.get("variables", []), p.get("lags", []), keys)
    if (p := _section(config, "ewm")) is not None:
        df = temporal.ewm(df, p.get("variables", []), p.get("spans", []), keys)
    if any(_section(config, name) is not None for name in ("spatial", "gradients")):
        df = df.repartition(keys.time)  # rows and columns of a grid then lie together for every window below
    if (p := _section(config, "spatial")) is not None:
        df = spatial.window_stats(df, p.get("variables", []), p.get("window_sizes", []), p.get("stats", ["mean", "std"]), p.get("min_periods", 1), keys)
    if (p := _section(config, "gradients")) is not None:
        df = spatial.gradients(df, p.get("variables", []), lat_step, lon_step, p.get("axis_order", "ascending"), keys)
        if wind is not None:
            df = physics.divergence_vorticity(df, *_wind(wind))
    diff = _section(config, "temporal_diff")
    if diff is not None:
        df = temporal.diffs(df, diff.get("variables", []), diff.get("periods", []), keys)
    normal = _section(config, "climatology") or (diff or {}).get("climatology")
    if normal is not None:
        df = climatology.doy_anomaly(df, known(df, normal.get("variables", []), "climatology"), time, keys.cell, climate)
    if (p := config.get("wind_chill") or {}).get("enabled", False):
        df = physics.wind_chill(df, p.get("temp_var", "temperature_h00_lvl1000"), p.get("u_var", "u_component_of_wind_h00_lvl1000"), p.get("v_var", "v_component_of_wind_h00_lvl1000"))
    if (p := config.get("advection") or {}).get("enabled", False):
        df = physics.advection(df, p.get("temp_var", "temperature_h00_lvl1000"), p.get("u_var", "u_component_of_wind_h00_lvl1000"), p.get("v_var", "v_component_of_wind_h00_lvl1000"), latitude, longitude, keys=keys)
    if (p := _section(config, "regional")) is not None:
        df = climatology.regional(df, p.get("variables", []), p.get("stats", ["mean", "std", "min", "max"]), keys)
    if (p := _section(config, "anomaly")) is not None:
        df = climatology.mean_anomaly(df, p.get("variables", []), keys=keys)
    return df


def lacking(config: dict, base: list[str], columns: list[str]) -> list[str]:
    """Features of the plan that a table doesn't have yet."""
    return [f for f in feature_names(base, config) if f not in columns]
