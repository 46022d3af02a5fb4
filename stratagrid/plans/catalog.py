"""Query catalogue: each operator over the star-schema tables, with equal SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import align, axes, climatology, evaluate, labels, land, physics, profile, reshape, sampling, spatial, temporal
from . import runs
from .base import CUBE, DENSE, HOURLY, cube, dense, hourly, q, shown, table
from .features import build

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEY = ["t", "lat_i", "lon_i"]
K = "t, lat_i, lon_i"
CELL = "PARTITION BY lat_i, lon_i ORDER BY t"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- filters and reshaping


@query(f"WITH {CUBE} SELECT {K}, {q('v', 'v')} FROM cube WHERE lat_i BETWEEN 1 AND 3 AND lon_i BETWEEN 0 AND 2")
def scan_region_box(spark, sf):
    return shown(reshape.region(cube(spark, sf), "lat_i", "lon_i", (3, 1), (0, 2)), "v", keep=KEY)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def time_range(spark, sf):
    return reshape.years_between(table(spark, sf, "orders"), "o_orderdate", 1996, 1997).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m FROM orders WHERE year(o_orderdate) IN (1996, 1999) AND month(o_orderdate) IN (1, 2, 12)")
def semi_years(spark, sf):
    return reshape.of_years(table(spark, sf, "orders"), "o_orderdate", [1996, 1999], [1, 2, 12]).select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))


@query(f"WITH {DENSE} SELECT {K}, {q('v', 'v')} FROM dense WHERE v IS NOT NULL")
def finite_target(spark, sf):
    return shown(reshape.finite_target(dense(spark, sf), "v"), "v", keep=KEY)


@query(f"WITH {DENSE} SELECT {K} FROM dense WHERE v IS NOT NULL AND u IS NOT NULL AND n IS NOT NULL")
def drop_incomplete(spark, sf):
    return reshape.complete(dense(spark, sf)).select(*KEY)


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, user_id, value FROM events e WHERE EXISTS (SELECT 1 FROM events x WHERE date_trunc('day', x.ts) = date_trunc('day', e.ts) AND x.event_type = 'error' AND x.value > 300)")
def times_with_data(spark, sf):
    e = table(spark, sf, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d"), "user_id", "value", F.when((F.col("event_type") == "error") & (F.col("value") > 300), F.col("value")).alias("big"))
    return reshape.times_with_data(e, "d", ["big"]).select("d", "user_id", "value")


@query(f"WITH {CUBE}, a AS (SELECT t, row_number() OVER (ORDER BY t) AS k, count(*) OVER () AS c FROM (SELECT DISTINCT t FROM cube)) SELECT cube.t, lat_i, lon_i, {q('v', 'v')} FROM cube JOIN a ON a.t = cube.t WHERE k = c // 2 + 1")
def middle_slice(spark, sf):
    return shown(reshape.time_slice(cube(spark, sf), "t", "middle"), "v", keep=KEY)


@query(f"WITH {CUBE} SELECT lat_i, " + ", ".join(f"CAST(sum(n) FILTER (WHERE lon_i = {k}) AS BIGINT) AS lon_{k}" for k in range(5)) + " FROM cube GROUP BY 1")
def pivot_grid(spark, sf):
    total = cube(spark, sf).groupBy("lat_i", "lon_i").agg(F.sum("n").alias("n"))
    return profile.pivot_grid(total, "lat_i", "lon_i", "n", list(range(5)))


@query(f"WITH {CUBE}, s AS (SELECT lat_i, list(CAST(n AS BIGINT) ORDER BY t, lon_i) AS xs FROM cube GROUP BY 1) SELECT lat_i, CAST(unnest(range(len(xs))) AS INT) AS k, unnest(xs) AS n FROM s")
def unpivot_arrays(spark, sf):
    packed = cube(spark, sf).groupBy("lat_i").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "lon_i", "n"))), lambda x: x["n"]).alias("xs"))
    return reshape.unpivot_arrays(packed, ["lat_i"], "xs", "k", "n")


@query(f"WITH {DENSE} SELECT {K}, {q('v', 'v')}, n FROM dense")
def densified_grid(spark, sf):
    return shown(dense(spark, sf), "v", keep=[*KEY, "n"])


# ---- time series


@query(f"WITH {CUBE} SELECT {K}, " + ", ".join(q(f"lag(v, {k}) OVER ({CELL})", f"v_lag{k}") for k in (1, 3, 7)) + " FROM cube")
def lag_features(spark, sf):
    return shown(temporal.lags(cube(spark, sf), ["v"], [1, 3, 7]), "v_lag1", "v_lag3", "v_lag7", keep=KEY)


@query(f"WITH {CUBE} SELECT {K}, " + ", ".join(q(f"v - lag(v, {k}) OVER ({CELL})", f"v_diff{k}") for k in (1, 3, 7, 14)) + " FROM cube")
def diff_features(spark, sf):
    return shown(temporal.diffs(cube(spark, sf), ["v"], [1, 3, 7, 14]), "v_diff1", "v_diff3", "v_diff7", "v_diff14", keep=KEY)


def _ewm_sql(span: int) -> str:
    a = 2.0 / (span + 1)
    fold = f"list_reduce(list(v) FILTER (WHERE v IS NOT NULL) OVER ({CELL}), lambda acc, x: CAST({a!r} AS DOUBLE) * x + CAST({1 - a!r} AS DOUBLE) * acc)"
    return f"WITH {DENSE} SELECT {K}, {q(f'CASE WHEN count(v) OVER ({CELL}) > 0 THEN {fold} END', f'v_ewm{span}')} FROM dense"


@query(_ewm_sql(3))
def ewm_span3(spark, sf):
    return shown(temporal.ewm(dense(spark, sf), ["v"], [3]), "v_ewm3", keep=KEY)


@query(_ewm_sql(7))
def ewm_span7(spark, sf):
    return shown(temporal.ewm(dense(spark, sf), ["v"], [7]), "v_ewm7", keep=KEY)


_F7 = f"({CELL} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@query(f"WITH {CUBE} SELECT {K}, " + ", ".join(q(f"CASE WHEN count(*) OVER {_F7} = 7 THEN quantile_cont(v, {x}) OVER {_F7} END", n) for n, x in (("v_p05", 0.05), ("v_p95", 0.95))) + " FROM cube")
def rolling_q_trailing(spark, sf):
    return shown(temporal.rolling_quantiles(cube(spark, sf), "v", 7, {"v_p05": 0.05, "v_p95": 0.95}), "v_p05", "v_p95", keep=KEY)


_C6 = f"({CELL} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)"


@query(f"WITH {DENSE} SELECT {K}, {q(f'CASE WHEN count(*) OVER {_C6} = 6 THEN quantile_cont(v, 0.95) OVER {_C6} END', 'v_p95')} FROM dense")
def rolling_q_centered(spark, sf):
    return shown(temporal.rolling_quantiles(dense(spark, sf), "v", 6, {"v_p95": 0.95}, centred=True), "v_p95", keep=KEY)


@query(f"WITH {DENSE} SELECT {K}, {q(f'last_value(v IGNORE NULLS) OVER ({CELL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'v_ffill')} FROM dense")
def ffill(spark, sf):
    return shown(temporal.forward_fill(dense(spark, sf), ["v"]), "v_ffill", keep=KEY)


_ANGLE = "2e0 * pi() * dayofyear(o_orderdate) / "


@query(
    "SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS month, CAST(dayofyear(o_orderdate) AS INT) AS day_of_year, "
    + ", ".join(q(f"{f}({_ANGLE}{p})", f"{f}_{n}") for n, p in (("annual", "365.25e0"), ("semiannual", "182.625e0")) for f in ("sin", "cos"))
    + " FROM orders"
)
def season_features(spark, sf):
    return shown(temporal.season(table(spark, sf, "orders"), "o_orderdate"), "sin_annual", "cos_annual", "sin_semiannual", "cos_semiannual", keep=["o_orderkey", "month", "day_of_year"])


# ---- neighbourhoods

_NEAR = "dense a JOIN dense b ON a.t = b.t AND abs(a.lat_i - b.lat_i) <= {r} AND abs(a.lon_i - b.lon_i) <= {r}"


def _near_sql(expr: str, name: str, r: int) -> str:
    return f"WITH {DENSE} SELECT a.t, a.lat_i, a.lon_i, {q(expr, name)} FROM {_NEAR.format(r=r)} GROUP BY 1, 2, 3"


@query(_near_sql("avg(b.v)", "v_mean5", 2))
def spatial_mean(spark, sf):
    return shown(spatial.window_stats(dense(spark, sf), ["v"], [5], ["mean"]), "v_mean5", keep=KEY)


@query(f"WITH {DENSE} SELECT a.t, a.lat_i, a.lon_i, CAST(floor(stddev_pop(b.v) * 1e1 + 5.137e-1) AS DOUBLE) / 1e1 AS v_std3 FROM {_NEAR.format(r=1)} GROUP BY 1, 2, 3")
def spatial_std(spark, sf):
    return spatial.window_stats(dense(spark, sf), ["v"], [3], ["std"]).select(*KEY, fn.quantised(F.col("v_std3"), 10).alias("v_std3"))


@query(_near_sql("min(b.v)", "v_min3", 1))
def spatial_min(spark, sf):
    return shown(spatial.window_stats(dense(spark, sf), ["v"], [3], ["min"]), "v_min3", keep=KEY)


@query(_near_sql("max(b.v)", "v_max3", 1))
def spatial_max(spark, sf):
    return shown(spatial.window_stats(dense(spark, sf), ["v"], [3], ["max"]), "v_max3", keep=KEY)


@query(_near_sql("median(b.v)", "v_median3", 1))
def spatial_median(spark, sf):
    return shown(spatial.window_stats(dense(spark, sf), ["v"], [3], ["median"]), "v_median3", keep=KEY)


def _slope_sql(v: str, d: str) -> str:
    w = f"(PARTITION BY t, {'lon_i' if d == 'lat' else 'lat_i'} ORDER BY {d}_i)"
    nxt, prv = f"lead({v}) OVER {w}", f"lag({v}) OVER {w}"
    return f"CASE WHEN row_number() OVER {w} = 1 THEN {nxt} - {v} WHEN lead(1) OVER {w} IS NULL THEN {v} - {prv} ELSE ({nxt} - {prv}) / 2e0 END"


_GRADS = ", ".join(f"{_slope_sql(v, d)} AS {v}_{d}" for v in "uv" for d in ("lat", "lon"))


@query(f"WITH {DENSE}, g AS (SELECT {K}, {_GRADS} FROM dense) SELECT {K}, {q('v_lat', 'v_grad_lat')}, {q('v_lon', 'v_grad_lon')}, {q('sqrt(v_lat * v_lat + v_lon * v_lon)', 'v_grad_mag')} FROM g")
def gradients(spark, sf):
    return shown(spatial.gradients(dense(spark, sf), ["v"]), "v_grad_lat", "v_grad_lon", "v_grad_mag", keep=KEY)


@query(f"WITH {DENSE}, g AS (SELECT {K}, {_GRADS} FROM dense) SELECT {K}, {q('u_lon + v_lat', 'wind10_div')}, {q('v_lon - u_lat', 'wind10_vort')} FROM g")
def div_vort(spark, sf):
    return shown(physics.divergence_vorticity(spatial.gradients(dense(spark, sf), ["u", "v"]), "u", "v"), "wind10_div", "wind10_vort", keep=KEY)


@query(f"WITH {CUBE}, s AS (SELECT {K}, u, v, sqrt(u * u + v * v) AS s FROM cube) SELECT {K}, {q('s', 'wind10_speed')}, {q('v / (s + 1e-6)', 'wind10_dir_sin')}, {q('u / (s + 1e-6)', 'wind10_dir_cos')} FROM s")
def wind_speed_dir(spark, sf):
    return shown(physics.wind_speed_direction(cube(spark, sf), "u", "v"), "wind10_speed", "wind10_dir_sin", "wind10_dir_cos", keep=KEY)


_SCALED = "w AS (SELECT t, lat_i, lon_i, 270 + v / 1e4 AS temp, u / 1e3 AS east, v / 1e5 AS north FROM dense)"


def _weather(spark, sf):
    return dense(spark, sf).select(*KEY, (F.lit(270) + F.col("v") / 1e4).alias("temp"), (F.col("u") / 1e3).alias("east"), (F.col("v") / 1e5).alias("north"))


@query(
    f"WITH {DENSE}, {_SCALED}, p AS (SELECT {K}, CASE WHEN (SELECT avg(temp) FROM w) > 200 THEN temp - 273.15e0 ELSE temp END AS c, pow(sqrt(east * east + north * north) * 3.6e0, 0.16e0) AS z FROM w)"
    f" SELECT {K}, {q('13.12e0 + 0.6215e0 * c - 11.37e0 * z + 0.3965e0 * c * z', 'wind_chill_index')} FROM p"
)
def wind_chill(spark, sf):
    return shown(physics.wind_chill(_weather(spark, sf), "temp", "east", "north"), "wind_chill_index", keep=KEY)


def _advection_sql() -> str:
    parts = {}
    for name, x, other in (("dx", "lon_i", "lat_i"), ("dy", "lat_i", "lon_i")):
        w = f"(PARTITION BY t, {other} ORDER BY {x})"
        nxt, prv = f"lead(temp) OVER {w}", f"lag(temp) OVER {w}"
        parts[name] = f"CASE WHEN lag({x}) OVER {w} IS NULL THEN {nxt} - temp WHEN lead({x}) OVER {w} IS NULL THEN temp - {prv} ELSE ({nxt} - {prv}) / 2e0 END"
    degree = "(6371000e0 * pi() / 180e0)"
    value = f"-(east * dx / ({degree} * cos(radians(lat_i * 10e0 + 20e0))) + north * dy / {degree}) * 1e6"
    return f"WITH {DENSE}, {_SCALED}, d AS (SELECT {K}, east, north, {parts['dx']} AS dx, {parts['dy']} / 10e0 AS dy FROM w) SELECT {K}, {q(value, 'temp_advection')} FROM d"


@query(_advection_sql())
def advection(spark, sf):
    w = _weather(spark, sf).withColumns({"latitude": F.col("lat_i") * F.lit(10.0) + 20, "longitude": F.col("lon_i").cast("double")})
    made = physics.advection(w, "temp", "east", "north", "latitude", "longitude").withColumn("temp_advection", F.col("temp_advection") * 1e6)
    return shown(made, "temp_advection", keep=KEY)


# ---- domain-wide statistics and climatology


@query(f"WITH {CUBE} SELECT {K}, " + ", ".join(q(f"{f}(v) OVER (PARTITION BY t)", f"v_global_{n}") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + " FROM cube")
def regional_stats(spark, sf):
    return shown(climatology.regional(cube(spark, sf), ["v"], ["mean", "std", "min", "max"]), "v_global_mean", "v_global_std", "v_global_min", "v_global_max", keep=KEY)


@query(f"WITH {CUBE} SELECT {K}, {q('v - avg(v) OVER (PARTITION BY lat_i, lon_i)', 'v_anom')} FROM cube")
def anomaly_mean(spark, sf):
    return shown(climatology.mean_anomaly(cube(spark, sf), ["v"]), "v_anom", keep=KEY)


@query(f"WITH {CUBE}, r AS (SELECT lat_i, lon_i, avg(v) AS m FROM cube WHERE t < 23980 GROUP BY 1, 2) SELECT t, cube.lat_i, cube.lon_i, {q('v - m', 'v_anom')} FROM cube LEFT JOIN r ON r.lat_i = cube.lat_i AND r.lon_i = cube.lon_i")
def anomaly_reference(spark, sf):
    c = cube(spark, sf)
    return shown(climatology.mean_anomaly(c, ["v"], c.where("t < 23980")), "v_anom", keep=KEY)


_CLIM = "clim AS (SELECT CAST(dayofyear(l_shipdate) AS INT) AS dayofyear, l_returnflag, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_CLIM} SELECT dayofyear, l_returnflag, {q('p', 'l_extendedprice')} FROM clim")
def doy_climatology(spark, sf):
    return shown(climatology.doy_climatology(table(spark, sf, "lineitem"), ["l_extendedprice"], "l_shipdate", ["l_returnflag"]), "l_extendedprice", keep=["dayofyear", "l_returnflag"])


@query(f"WITH {_CLIM} SELECT l_orderkey, l_linenumber, {q('l_extendedprice - p', 'l_extendedprice_anom')} FROM lineitem l JOIN clim ON clim.dayofyear = dayofyear(l_shipdate) AND clim.l_returnflag = l.l_returnflag")
def doy_anomaly(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_extendedprice")
    return shown(climatology.doy_anomaly(lines, ["l_extendedprice"], "l_shipdate", ["l_returnflag"]), "l_extendedprice_anom", keep=["l_orderkey", "l_linenumber"])


@query(f"WITH {_CLIM} SELECT l_orderkey, l_linenumber, {q('p', 'normal')} FROM lineitem l LEFT JOIN clim ON clim.dayofyear = least(dayofyear(l_shipdate), 365) AND clim.l_returnflag = l.l_returnflag")
def climatology_lookup(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_extendedprice")
    clim = climatology.doy_climatology(lines, ["l_extendedprice"], "l_shipdate", ["l_returnflag"])
    return shown(climatology.climatology_lookup(lines, clim, "l_shipdate", ["l_returnflag"], "l_extendedprice", "normal"), "normal", keep=["l_orderkey", "l_linenumber"])


@query(
    f"WITH {_CLIM}, j AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, p FROM lineitem l LEFT JOIN clim ON clim.dayofyear = least(dayofyear(l_shipdate), 365) AND clim.l_returnflag = l.l_returnflag)"
    " SELECT l_orderkey, l_linenumber, CAST(coalesce(x < p - 10000, false) AS INT) AS cold, CAST(coalesce(x > p + 10000, false) AS INT) AS heat FROM j"
)
def binarize_vs_clim(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_extendedprice")
    clim = climatology.doy_climatology(lines, ["l_extendedprice"], "l_shipdate", ["l_returnflag"])
    both = climatology.climatology_lookup(lines, clim, "l_shipdate", ["l_returnflag"], "l_extendedprice", "normal")
    x, p = F.col("l_extendedprice"), F.col("normal")
    return both.select("l_orderkey", "l_linenumber", labels.binarised_against(x, p, 10000.0, "cold").alias("cold"), labels.binarised_against(x, p, 10000.0, "heat").alias("heat"))


# ---- alignment


@query(
    "WITH r AS (SELECT CAST(ts AS DATE) AS d, user_id, value, row_number() OVER (PARTITION BY CAST(ts AS DATE), round_even(user_id / 1e1, 0) ORDER BY event_id) AS k FROM events WHERE event_type = 'purchase')"
    f" SELECT e.event_id, {q('coalesce(r.value, 0)', 'value_purchase')} FROM events e LEFT JOIN r ON r.d = CAST(e.ts AS DATE) AND round_even(r.user_id / 1e1, 0) = round_even(e.user_id / 1e1, 0) AND r.k = 1 WHERE e.event_type = 'click'"
)
def quantised_key_join(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "event_type", "value", (F.col("user_id") / 1000.0).alias("lat"), F.lit(0.0).alias("lon"))
    right = e.where("event_type = 'purchase'").withColumnRenamed("value", "value_purchase")
    left = e.where("event_type = 'click'").drop("value")
    return shown(align.quantised_lookup(left, right, "ts", "lat", "lon", "value_purchase", ["event_id"]), "value_purchase", keep=["event_id"])


@query(
    f"WITH {HOURLY}, want AS (SELECT CAST(h + to_minutes(CAST(((epoch_us(h) // 3600000000) % 6) * 10 AS INT)) AS TIMESTAMP) AS w, n FROM hourly),"
    " m AS (SELECT w, want.n, h, x, row_number() OVER (PARTITION BY w ORDER BY abs(epoch_us(w) - epoch_us(h)), h DESC) AS k FROM want JOIN hourly ON abs(epoch_us(w) - epoch_us(h)) <= 5400000000)"
    f" SELECT w, h, n, {q('x', 'x')} FROM m WHERE k = 1"
)
def nearest_time_join(spark, sf):
    h = hourly(spark, sf)
    hour = F.floor(F.unix_micros(F.col("h").cast("timestamp")) / F.lit(3_600_000_000)).cast("long")
    moved = F.timestamp_micros(F.unix_micros(F.col("h").cast("timestamp")) + (hour % 6) * 600_000_000).cast("timestamp_ntz")
    return shown(align.nearest_time(h.select(moved.alias("w"), "n"), h.select("h", "x"), "w", "h", 5400), "x", keep=["w", "h", "n"])


_GRIDS = "p AS (SELECT s_suppkey, s_acctbal / 1e3 AS x FROM supplier), g AS (SELECT DISTINCT CAST(floor(c_acctbal / 500) AS DOUBLE) * 5e-1 AS gx FROM customer)"


def _grids(spark, sf):
    p = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1e3).alias("x"))
    return p, table(spark, sf, "customer").select((F.floor(F.col("c_acctbal") / 500).cast("double") * 0.5).alias("gx")).distinct()


@query(f"WITH {_GRIDS}, m AS (SELECT s_suppkey, gx, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(x - gx), gx DESC) AS k FROM p JOIN g ON abs(x - gx) <= 6e-1) SELECT p.s_suppkey, m.gx FROM p LEFT JOIN m ON m.s_suppkey = p.s_suppkey AND k = 1")
def nearest_grid_join(spark, sf):
    p, g = _grids(spark, sf)
    return p.join(axes.nearest_map(p, g, "x", "gx", 0.6), "x", "left").select("s_suppkey", "gx")


@query(f"WITH {_GRIDS}, m AS (SELECT s_suppkey, gx, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(x - gx), gx) AS k FROM p CROSS JOIN g) SELECT s_suppkey, gx FROM m WHERE k = 1")
def nearest_first_join(spark, sf):
    p, g = _grids(spark, sf)
    return p.join(axes.nearest_map(p, g, "x", "gx", ties="smaller"), "x").select("s_suppkey", "gx")


@query(
    "WITH l AS (SELECT CAST(l_shipdate AS DATE) AS d, l_returnflag AS f, min(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS y FROM lineitem GROUP BY 1, 2)"
    " SELECT l_orderkey, l_linenumber, CAST(coalesce(l.y, 0) AS INT) AS y, l.y IS NOT NULL AS valid FROM lineitem i LEFT JOIN l ON l.d = CAST(i.l_shipdate AS DATE) AND l.f = i.l_returnflag"
)
def external_label_join(spark, sf):
    i = table(spark, sf, "lineitem")
    outside = i.select(F.to_date("l_shipdate").alias("date"), "l_returnflag", F.when(F.col("l_quantity") > 40, 1).otherwise(0).alias("y"))
    return align.outside_labels(i, outside, "l_shipdate", ["l_returnflag"], "y").select("l_orderkey", "l_linenumber", "y", "valid")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def dedupe_first(spark, sf):
    return align.first_of(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice END AS price FROM orders WHERE year(o_orderdate) IN (1996, 1997)")
def union_years(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("price"))
    return align.union_all([o.where("y = 1996"), o.where("y = 1997").drop("price")])


@query(f"WITH {CUBE} SELECT a.t, a.lat_i, a.lon_i, {q('a.v', 'v')}, {q('b.u', 'u')} FROM cube a JOIN cube b ON a.t = b.t AND a.lat_i = b.lat_i AND a.lon_i = b.lon_i WHERE a.n > 2 AND b.u > 4000")
def merge_inner(spark, sf):
    c = cube(spark, sf)
    return shown(align.common([c.where("n > 2").select(*KEY, "v"), c.where("u > 4000").select(*KEY, "u")], KEY), "v", "u", keep=KEY)


@query(
    f"WITH {CUBE}, a AS (SELECT * FROM cube WHERE t % 3 <> 0), b AS (SELECT * FROM cube WHERE t % 3 <> 1) SELECT coalesce(a.t, b.t) AS t, coalesce(a.lat_i, b.lat_i) AS lat_i, coalesce(a.lon_i, b.lon_i) AS lon_i,"
    f" {q('coalesce(a.v, b.v)', 'v')}, {q('b.u', 'u')}, a.n AS n FROM a FULL JOIN b ON a.t = b.t AND a.lat_i = b.lat_i AND a.lon_i = b.lon_i"
)
def merge_outer(spark, sf):
    """Two parts that overlap in time, one without u and one without n."""
    c = cube(spark, sf)
    parts = [c.where("t % 3 <> 0").select(*KEY, "v", "n"), c.where("t % 3 <> 1").select(*KEY, "v", "u")]
    return shown(align.merged(parts, KEY), "v", "u", keep=[*KEY, "n"])


# ---- labels and weights

_EVENT = "y AS (SELECT t, lat_i, lon_i, v, u, CAST(coalesce(v > 150500, false) AS INT) AS hit, CAST(coalesce(u > 4600, false) AS INT) AS pred FROM dense)"


def _events_cube(spark, sf):
    d = dense(spark, sf)
    return d.select(*KEY, "v", "u", labels.binarised(F.col("v"), 150500.0, "heat").alias("hit"), labels.binarised(F.col("u"), 4600.0, "heat").alias("pred"))


@query(f"WITH {DENSE} SELECT {K}, CAST(coalesce(v - 150000 > 3000, false) AS INT) AS heat, CAST(coalesce(v - 150000 < -3000, false) AS INT) AS cold FROM dense")
def binarize_threshold(spark, sf):
    a = F.col("v") - 150000
    return dense(spark, sf).select(*KEY, labels.binarised(a, 3000.0, "heat").alias("heat"), labels.binarised(a, 3000.0, "cold").alias("cold"))


@query("SELECT o_orderkey, CASE WHEN abs(o_totalprice - 250000) >= 150000 THEN 1e1 WHEN abs(o_totalprice - 250000) >= 100000 THEN 5e0 WHEN abs(o_totalprice - 250000) >= 50000 THEN 2e0 ELSE 1e0 END AS w FROM orders")
def tier_weights(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", labels.tier_weight(F.col("o_totalprice") - 250000, cuts=(50000.0, 100000.0, 150000.0)).alias("w"))


@query(f"WITH {DENSE}, {_EVENT} SELECT {K}, CASE WHEN hit = 1 AND pred = 1 THEN 1 WHEN hit = 0 AND pred = 1 THEN 2 WHEN hit = 1 AND pred = 0 THEN 3 ELSE 0 END AS code FROM y")
def confusion_codes(spark, sf):
    return _events_cube(spark, sf).select(*KEY, labels.confusion_code(F.col("hit"), F.col("pred")).alias("code"))


@query(
    f"WITH {DENSE}, {_EVENT}, r AS (SELECT *, greatest(hit, coalesce(lag(hit) OVER ({CELL}), 0), coalesce(lead(hit) OVER ({CELL}), 0)) AS hr, greatest(pred, coalesce(lag(pred) OVER ({CELL}), 0), coalesce(lead(pred) OVER ({CELL}), 0)) AS pr FROM y),"
    " s AS (SELECT CAST(sum(CASE WHEN pred = 1 AND hr = 1 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(pred), 0) AS p, CAST(sum(CASE WHEN hit = 1 AND pr = 1 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(hit), 0) AS r FROM r)"
    f" SELECT {q('p', 'precision')}, {q('r', 'recall')}, {q('2 * p * r / (p + r)', 'f1')} FROM s"
)
def relaxed_metrics(spark, sf):
    d = labels.relaxed(_events_cube(spark, sf), ["hit", "pred"])
    made = d.agg(
        evaluate.ratio(F.count_if((F.col("pred") == 1) & (F.col("hit_relaxed") == 1)), F.sum("pred")).alias("precision"),
        evaluate.ratio(F.count_if((F.col("hit") == 1) & (F.col("pred_relaxed") == 1)), F.sum("hit")).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return shown(made.withColumn("f1", evaluate.ratio(2 * p * r, p + r)), "precision", "recall", "f1", keep=[])


def _smooth_sql() -> str:
    def conv(c: str, part: str, order: str, weights: list[float]) -> str:
        r, w = len(weights) // 2, f"(PARTITION BY {part} ORDER BY {order})"
        ends = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        terms = []
        for k, x in zip(range(-r, r + 1), weights, strict=True):
            value = c if k == 0 else f"coalesce(lag({c}, {-k}) OVER {w}, first_value({c}) OVER {ends})" if k < 0 else f"coalesce(lead({c}, {k}) OVER {w}, last_value({c}) OVER {ends})"
            terms.append(f"CAST({x!r} AS DOUBLE) * {value}")
        return " + ".join(terms)

    t, s = labels.gaussian(1.5, 3), labels.gaussian(1.0, 1)
    return (
        f"WITH {DENSE}, {_EVENT}, a AS (SELECT {K}, hit, {conv('CAST(hit AS DOUBLE)', 'lat_i, lon_i', 't', t)} AS s FROM y), b AS (SELECT {K}, hit, {conv('s', 't, lon_i', 'lat_i', s)} AS s FROM a),"
        f" c AS (SELECT {K}, hit, {conv('s', 't, lat_i', 'lon_i', s)} AS s FROM b), e AS (SELECT {K}, hit, least(greatest(s, CAST(hit AS DOUBLE), 0), 1) AS smooth FROM c)"
    )


@query(f"{_smooth_sql()} SELECT {K}, {q('smooth', 'smooth')} FROM e")
def label_smooth(spark, sf):
    return shown(labels.smoothed(_events_cube(spark, sf), "hit", temporal=(1.5, 3), spatial=(1.0, 1)), "smooth", keep=KEY)


@query(f"{_smooth_sql()} SELECT {K}, {q('CASE WHEN hit = 1 THEN 5e0 ELSE 1e0 + 4e0 * 4e0 * smooth * (1 - smooth) END', 'weight')} FROM e")
def smooth_weights(spark, sf):
    s = labels.smoothed(_events_cube(spark, sf), "hit", temporal=(1.5, 3), spatial=(1.0, 1))
    return shown(s.withColumn("weight", labels.smooth_weight(F.col("smooth"), F.col("hit"))), "weight", keep=KEY)


# ---- sampling

_DRAW = "md5('42|' || CAST(o_orderkey AS VARCHAR))"


def _orders_drawn(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), sampling.draw_key("o_orderkey").alias("draw"))


@query(f"SELECT o_orderkey FROM orders ORDER BY {_DRAW} LIMIT 500")
def sample_uniform(spark, sf):
    return sampling.uniform(_orders_drawn(spark, sf), 500, "draw").select("o_orderkey")


@query(
    f"WITH a AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, {_DRAW} AS d, o_totalprice >= 480000 AS keep FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY y, m, keep ORDER BY d) AS k,"
    " count(*) OVER (PARTITION BY y, m) AS n, count(*) FILTER (WHERE keep) OVER (PARTITION BY y, m) AS c FROM a) SELECT o_orderkey, CAST(y AS INT) AS y, CAST(m AS INT) AS m FROM b WHERE keep OR k <= greatest(floor(n * 1e-1), 1) - c"
)
def sample_tail_preserving(spark, sf):
    return sampling.tail_preserving(_orders_drawn(spark, sf), "o_totalprice", 0.1, 490000.0, 480000.0, ["y", "m"], "draw").select("o_orderkey", "y", "m")


@query(
    f"WITH a AS (SELECT o_orderkey, CASE WHEN o_totalprice >= 495000 THEN 1 ELSE 0 END AS label, {_DRAW} AS d FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d) AS k, sum(label) OVER () AS p FROM a) SELECT o_orderkey, label FROM b WHERE label = 1 OR k <= 5 * p"
)
def undersample_ratio(spark, sf):
    rows = _orders_drawn(spark, sf).withColumn("label", F.when(F.col("o_totalprice") >= 495000, 1).otherwise(0))
    return sampling.undersampled(rows, "label", 5, "draw").select("o_orderkey", "label")


@query(
    "WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), r AS (SELECT y, row_number() OVER (ORDER BY y DESC) AS k, count(*) OVER () AS n FROM y)"
    " SELECT o_orderkey, CAST(r.y AS INT) AS y, CASE WHEN r.k <= least(greatest(1, ceil(n * 2e-1)), n - 1) THEN 'valid' ELSE 'train' END AS part FROM orders JOIN r ON r.y = year(o_orderdate)"
)
def temporal_split(spark, sf):
    o = table(spark, sf, "orders")
    train, valid = sampling.temporal_split(o, F.year("o_orderdate"), 0.2)
    cols = lambda d, name: d.select("o_orderkey", F.year("o_orderdate").alias("y"), F.lit(name).alias("part"))
    return cols(train, "train").union(cols(valid, "valid"))


# ---- evaluation

_COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE hit = {a} AND pred = {b}) AS BIGINT) AS {n}" for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))
_R = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"
_METRICS = ", ".join(
    q(x, n)
    for n, x in (
        ("accuracy", _R("tp + tn", "tp + fp + fn + tn")), ("precision", _R("tp", "tp + fp")), ("recall", _R("tp", "tp + fn")), ("f1", _R("2 * tp", "2 * tp + fp + fn")), ("specificity", _R("tn", "tn + fp")),
        ("balanced_accuracy", f"coalesce(({_R('tp', 'tp + fn')} + {_R('tn', 'tn + fp')}) / nullif(CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END + CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END, 0), 0)"),
    )
)
_SCORES = ["accuracy", "precision", "recall", "f1", "specificity", "balanced_accuracy"]
_COUNT_NAMES = ["tp", "fp", "fn", "tn"]


@query("WITH y AS (SELECT toxic AS hit, quality AS pred FROM labels), c AS (SELECT " + _COUNTS + f" FROM y) SELECT tp, fp, fn, tn, {_METRICS} FROM c")
def confusion_metrics(spark, sf):
    return shown(evaluate.confusion(table(spark, sf, "labels"), "toxic", "quality"), *_SCORES, keep=_COUNT_NAMES)


@query(f"WITH {DENSE}, {_EVENT}, z AS (SELECT CAST(t // 12 AS VARCHAR) AS year, hit, pred FROM y), c AS (SELECT coalesce(year, 'ALL') AS year, {_COUNTS} FROM z GROUP BY ROLLUP (year)) SELECT year, tp, fp, fn, tn, {_METRICS} FROM c")
def report_rollup(spark, sf):
    y = _events_cube(spark, sf).withColumn("year", F.floor(F.col("t") / 12).cast("string"))
    return shown(evaluate.rollup(y, "hit", "pred", "year"), *_SCORES, keep=["year", *_COUNT_NAMES])


@query(
    "WITH b AS (SELECT toxic AS t, quality AS p FROM labels), k AS (SELECT DISTINCT t AS c FROM b UNION SELECT DISTINCT p FROM b),"
    " r AS (SELECT c, (SELECT count(*) FROM b WHERE t = c AND p = c) AS hit, (SELECT count(*) FROM b WHERE t = c) AS support, (SELECT count(*) FROM b WHERE p = c) AS named FROM k),"
    f" s AS (SELECT CAST(c AS VARCHAR) AS label, {_R('hit', 'named')} AS precision, {_R('hit', 'support')} AS recall, {_R('2 * hit', 'named + support')} AS f1, support FROM r),"
    " a AS (SELECT * FROM s UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM s"
    " UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM s)"
    f" SELECT label, {q('precision', 'precision')}, {q('recall', 'recall')}, {q('f1', 'f1')}, CAST(support AS BIGINT) AS support FROM a"
)
def class_report(spark, sf):
    return shown(evaluate.class_report(table(spark, sf, "labels"), "toxic", "quality"), "precision", "recall", "f1", keep=["label", "support"])


@query(
    f"WITH {CUBE}, e AS (SELECT v AS a, 150000 + (u - 4500) AS p FROM cube) SELECT {q('sqrt(avg((p - a) * (p - a)))', 'rmse')}, {q('avg(abs(p - a))', 'mae')}, {q('1 - avg((p - a) * (p - a)) / var_pop(a)', 'r2')}, count(*) AS n FROM e"
)
def regression_metrics(spark, sf):
    c = cube(spark, sf).select(F.col("v").alias("a"), (F.lit(150000) + (F.col("u") - 4500)).alias("p"))
    return shown(evaluate.regression(c, "a", "p"), "rmse", "mae", "r2", keep=["n"])


_SCORED = "d AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity / 5e1 AS s FROM lineitem)"
_STEPS = [round(0.05 * k, 2) for k in range(1, 20)]


def _scored(spark, sf):
    return table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), (F.col("l_quantity") / 50.0).alias("s"))


@query(
    f"WITH {_SCORED}, x AS (SELECT CAST(unnest([{', '.join(map(str, _STEPS))}]) AS DOUBLE) AS threshold), c AS (SELECT threshold, CAST(count(*) FILTER (WHERE y = 1 AND s >= threshold) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE y = 0 AND s >= threshold) AS BIGINT) AS fp,"
    f" CAST(count(*) FILTER (WHERE y = 1 AND s < threshold) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE y = 0 AND s < threshold) AS BIGINT) AS tn FROM d CROSS JOIN x GROUP BY 1) SELECT threshold, tp, fp, fn, tn, {_METRICS} FROM c"
)
def threshold_sweep(spark, sf):
    return shown(evaluate.sweep(_scored(spark, sf), "y", "s", _STEPS), *_SCORES, keep=["threshold", *_COUNT_NAMES])


@query(
    f"WITH {_SCORED}, x AS (SELECT CAST(unnest([{', '.join(map(str, _STEPS))}]) AS DOUBLE) AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE y = 1 AND s >= threshold) AS tp, count(*) FILTER (WHERE y = 0 AND s >= threshold) AS fp,"
    f" count(*) FILTER (WHERE y = 1 AND s < threshold) AS fn FROM d CROSS JOIN x GROUP BY 1) SELECT threshold, {q(_R('2 * tp', '2 * tp + fp + fn'), 'f1')} FROM c ORDER BY {_R('2 * tp', '2 * tp + fp + fn')} DESC, threshold LIMIT 1"
)
def best_threshold(spark, sf):
    return shown(evaluate.best_threshold(evaluate.sweep(_scored(spark, sf), "y", "s", _STEPS)), "f1", keep=["threshold"])


_OFFSETS = [-5.0 + 10.0 * k / 20 for k in range(21)]


@query(
    f"WITH {CUBE}, e AS (SELECT (v - 150000) / 1e3 AS a, (u - 4500) / 1e2 AS p FROM cube), x AS (SELECT CAST(unnest([{', '.join(map(repr, _OFFSETS))}]) AS DOUBLE) AS o),"
    " c AS (SELECT o AS offset_value, " + ", ".join(f"CAST(count(*) FILTER (WHERE {'' if t else 'NOT '}(a > 3) AND {'' if p else 'NOT '}(p > 3 + o)) AS BIGINT) AS {n}" for n, t, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))) + f" FROM e CROSS JOIN x GROUP BY 1) SELECT offset_value, tp, fp, fn, tn, {_METRICS} FROM c"
)
def offset_sweep(spark, sf):
    c = cube(spark, sf).select(((F.col("v") - 150000) / 1e3).alias("a"), ((F.col("u") - 4500) / 1e2).alias("p"))
    made = evaluate.offset_sweep(c, "a", "p", 3.0, "heat", steps=21).withColumnRenamed("offset", "offset_value")
    return shown(made, *_SCORES, keep=["offset_value", *_COUNT_NAMES])


_CURVE = (
    f"WITH {_SCORED}, g AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY 1), c AS (SELECT s, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp,"
    " CAST(sum(pos) OVER () AS DOUBLE) AS pp, CAST(sum(neg) OVER () AS DOUBLE) AS nn FROM g WINDOW w AS (ORDER BY s DESC))"
)


@query(f"{_CURVE} SELECT {q('sum(pos / pp * tp / (tp + fp))', 'pr_auc')} FROM c")
def pr_auc(spark, sf):
    return shown(evaluate.average_precision(_scored(spark, sf), "y", "s"), "pr_auc", keep=[])


@query(f"{_CURVE} SELECT {q('sum(neg * (tp - pos / 2)) / max(pp * nn)', 'roc_auc')} FROM c")
def roc_auc(spark, sf):
    return shown(evaluate.roc_auc(_scored(spark, sf), "y", "s"), "roc_auc", keep=[])


@query(f"{_CURVE}, f AS (SELECT s, tp / (tp + fp) AS p, tp / pp AS r FROM c) SELECT s AS threshold, {q('2 * p * r / (p + r + 1e-10)', 'f1')} FROM f ORDER BY 2 * p * r / (p + r + 1e-10) DESC, s DESC LIMIT 1")
def pr_best_threshold(spark, sf):
    return shown(evaluate.best_curve_threshold(_scored(spark, sf), "y", "s"), "f1", keep=["threshold"])


@query(
    f"WITH {CUBE}, m AS (SELECT avg(u) AS mp, avg(v) AS mt, stddev_pop(u) AS sp, stddev_pop(v) AS st FROM cube) SELECT {K}, {q('u - mp + mt', 'mean_shift')}, {q('(u - mp) * (st / sp) + mp', 'std_scale')}, {q('(u - mp) * (st / sp) + mt', 'both')} FROM cube CROSS JOIN m"
)
def calibrate(spark, sf):
    c = cube(spark, sf)
    for method in ("mean_shift", "std_scale", "both"):
        c = evaluate.calibrated(c, "u", "v", method, method)
    return shown(c, "mean_shift", "std_scale", "both", keep=KEY)


@query(
    "WITH j AS (SELECT l.toxic AS hit, CASE WHEN l.quality = 1 THEN 0 ELSE 1 END AS pred FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), y AS (SELECT hit, pred FROM j WHERE hit IS NOT NULL), c AS (SELECT " + _COUNTS
    + f", count(*) AS valid_samples FROM y) SELECT valid_samples, tp, fp, fn, tn, {_METRICS} FROM c"
)
def external_report(spark, sf):
    """Documents without a label are no valid samples."""
    both = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    made = evaluate.agreement(both.select("toxic", F.when(F.col("quality") == 1, 0).otherwise(1).alias("pred")), "toxic", "pred")
    return shown(made, *_SCORES, keep=["valid_samples", *_COUNT_NAMES])


@query(
    f"WITH {DENSE}, y AS (SELECT CASE WHEN v IS NOT NULL THEN CAST(v > 150500 AS INT) END AS hit, CASE WHEN u IS NOT NULL THEN CAST(n > 2 AS INT) END AS pred FROM dense), z AS (SELECT * FROM y WHERE hit IS NOT NULL AND pred IS NOT NULL),"
    f" c AS (SELECT {_COUNTS}, count(*) AS valid_samples, CAST(sum(hit) AS BIGINT) AS events_true, CAST(sum(pred) AS BIGINT) AS events_pred FROM z) SELECT valid_samples, events_true, events_pred, tp, fp, fn, tn, {_METRICS} FROM c"
)
def labels_agreement(spark, sf):
    d = dense(spark, sf)
    both = d.select(F.when(F.col("v").isNotNull(), (F.col("v") > 150500).cast("int")).alias("hit"), F.when(F.col("u").isNotNull(), (F.col("n") > 2).cast("int")).alias("pred"))
    return shown(evaluate.agreement(both, "hit", "pred"), *_SCORES, keep=["valid_samples", "events_true", "events_pred", *_COUNT_NAMES])


_REPORT = ["rmse", "mae", "r2", "f1", "recall", "precision", "balanced_accuracy"]


def _report_sql() -> str:
    scores = [(n, x) for n, x in (("f1", _R("2 * tp", "2 * tp + fp + fn")), ("recall", _R("tp", "tp + fn")), ("precision", _R("tp", "tp + fp")))]
    scores.append(("balanced_accuracy", f"coalesce(({_R('tp', 'tp + fn')} + {_R('tn', 'tn + fp')}) / nullif(CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END + CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END, 0), 0)"))
    errors = "sqrt(avg(pow(p - t, 2))) AS rmse, avg(abs(p - t)) AS mae, CASE WHEN var_pop(t) > 0 THEN 1 - avg(pow(p - t, 2)) / var_pop(t) ELSE 0 END AS r2"
    return (
        f"WITH {CUBE}, y AS (SELECT CAST(t // 12 AS VARCHAR) AS year, v - 150000 AS t, u * 33 - 150000 AS p, CAST(v > 150500 AS INT) AS hit, CAST(u * 33 > 150500 AS INT) AS pred, CAST(u * 33 > 149000 AS INT) AS opt FROM cube),"
        f" a AS (SELECT coalesce(year, 'ALL') AS year, {errors}, {_COUNTS} FROM y GROUP BY ROLLUP (year)), o AS (SELECT 'OPT' AS year, {errors}, {_COUNTS.replace('pred', 'opt')} FROM y), r AS (SELECT * FROM a UNION ALL SELECT * FROM o)"
        f" SELECT year, {q('rmse', 'rmse')}, {q('mae', 'mae')}, {q('r2', 'r2')}, {', '.join(q(x, n) for n, x in scores)}, tp + fn AS events_true, tp + fp AS events_pred FROM r"
    )


@query(_report_sql())
def report_opt(spark, sf):
    p = F.col("u") * 33
    y = cube(spark, sf).select(
        F.floor(F.col("t") / 12).cast("string").alias("year"), (F.col("v") - 150000).alias("anomaly"), (p - 150000).alias("predicted"),
        labels.binarised(F.col("v"), 150500.0, "heat").alias("hit"), labels.binarised(p, 150500.0, "heat").alias("pred"), labels.binarised(p, 149000.0, "heat").alias("opt"),
    )
    return shown(evaluate.report(y, "year", "hit", "pred", "anomaly", "predicted", "opt"), *_REPORT, keep=["year", "events_true", "events_pred"])


# ---- profiles

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "WITH x AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS variable, CASE WHEN l_linenumber = 3 THEN NULL ELSE {c} END AS x FROM lineitem" for c in _NUMBERS)
    + f") SELECT variable, count(x) AS n, count(*) - count(x) AS nulls, {q('1e2 * (count(*) - count(x)) / count(*)', 'null_pct')}, {q('min(x)', 'min')}, {q('max(x)', 'max')}, {q('avg(x)', 'mean')}, {q('stddev_pop(x)', 'std')},"
    f" {q('quantile_cont(x, 0.25)', 'q1')}, {q('median(x)', 'median')}, {q('quantile_cont(x, 0.75)', 'q3')} FROM x GROUP BY 1"
)
def describe_stats(spark, sf):
    l = table(spark, sf, "lineitem").select("l_linenumber", *_NUMBERS)
    l = l.select(*(F.when(F.col("l_linenumber") != 3, F.col(c)).alias(c) for c in _NUMBERS))
    return shown(profile.describe(l, _NUMBERS), "null_pct", "min", "max", "mean", "std", "q1", "median", "q3", keep=["variable", "n", "nulls"])


_LEVELS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query(" UNION ALL ".join(f"SELECT CAST({x} AS DOUBLE) AS level, {q(f'quantile_cont(o_totalprice, {x})', 'value')} FROM orders" for x in _LEVELS))
def quantile_list(spark, sf):
    return shown(profile.quantiles(table(spark, sf, "orders"), "o_totalprice", _LEVELS), "value", keep=["level"])


@query(f"WITH {DENSE} " + " UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) AS rows, count(*) - count({c}) AS nulls, {q(f'1e2 * (count(*) - count({c})) / count(*)', 'null_pct')} FROM dense" for c in ("v", "u", "n")))
def missing_report(spark, sf):
    return shown(profile.missing(dense(spark, sf), ["v", "u", "n"]), "null_pct", keep=["variable", "rows", "nulls"])


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {q(f'corr({a}, {b})', 'r')} FROM lineitem" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]))
def corr_matrix(spark, sf):
    return shown(profile.correlations(table(spark, sf, "lineitem"), _NUMBERS), "r", keep=["a", "b"])


@query(
    "WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem), h AS (SELECT CAST(least(floor((l_quantity - a) / ((b - a) / 20)), 19) AS INT) AS bin, a, b FROM lineitem CROSS JOIN e)"
    f" SELECT bin, {q('a + bin * (b - a) / 20', 'low')}, count(*) AS n FROM h GROUP BY bin, a, b"
)
def histogram(spark, sf):
    return shown(profile.histogram(table(spark, sf, "lineitem"), "l_quantity", 20), "low", keep=["bin", "n"])


def _drift_sql() -> str:
    one = lambda c: (
        f"SELECT '{c}' AS variable, avg({c}) FILTER (WHERE NOT g) AS ref_mean, avg({c}) FILTER (WHERE g) AS target_mean, stddev_pop({c}) FILTER (WHERE NOT g) AS ref_std, stddev_pop({c}) FILTER (WHERE g) AS target_std FROM x"
    )
    columns = ["ref_mean", "target_mean", "ref_std", "target_std"]
    return (
        "WITH x AS (SELECT *, l_shipdate >= TIMESTAMP '1999-01-01' AS g FROM lineitem), d AS (" + " UNION ALL ".join(map(one, _NUMBERS)) + ") SELECT variable, " + ", ".join(q(c, c) for c in columns)
        + f", {q('(target_mean - ref_mean) / ref_std', 'drift_score')}, {q('abs((target_mean - ref_mean) / ref_std)', 'abs_drift')} FROM d"
    )


@query(_drift_sql())
def drift_report(spark, sf):
    late = F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")
    return shown(profile.drift(table(spark, sf, "lineitem"), late, _NUMBERS), "ref_mean", "target_mean", "ref_std", "target_std", "drift_score", "abs_drift", keep=["variable"])


@query(f"SELECT l_returnflag AS value, count(*) AS n, {q('1e2 * count(*) / sum(count(*)) OVER ()', 'pct')} FROM lineitem GROUP BY 1")
def class_counts(spark, sf):
    return shown(profile.class_counts(table(spark, sf, "lineitem"), "l_returnflag"), "pct", keep=["value", "n"])


@query(f"SELECT count(*) FILTER (WHERE toxic = 1) AS positives, {q('avg(toxic)', 'rate')}, {q('avg(toxic)', 'mean')}, CAST(min(toxic) AS INT) AS min, CAST(max(toxic) AS INT) AS max FROM labels")
def positive_rate(spark, sf):
    return shown(profile.rate(table(spark, sf, "labels"), "toxic"), "rate", "mean", keep=["positives", "min", "max"])


@query(f"SELECT p_brand, {q('sum(p_retailprice)', 'total')} FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, p_brand LIMIT 20")
def topk_importance(spark, sf):
    total = table(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("total"))
    return shown(profile.top(total, "total", 20, "p_brand"), "total", keep=["p_brand"])


@query(f"SELECT round_even(s_acctbal / 1e3 * 4, 0) / 4 AS lat, round_even(s_nationkey / 8e0 * 4, 0) / 4 AS lon, {q('avg(s_acctbal)', 'value')} FROM supplier GROUP BY 1, 2")
def grid_round_agg(spark, sf):
    s = table(spark, sf, "supplier").select("s_acctbal", (F.col("s_acctbal") / 1e3).alias("la"), (F.col("s_nationkey") / 8.0).alias("lo"))
    return shown(profile.gridded(s, "la", "lo", "s_acctbal"), "value", keep=["lat", "lon"])


@query(f"WITH {DENSE}, {_EVENT} SELECT lat_i, lon_i, {q('CAST(count(*) FILTER (WHERE hit = 1 AND pred = 1) AS DOUBLE) / nullif(count(*) FILTER (WHERE hit = 1), 0)', 'recall')}, {q('avg(hit) * 1e2', 'event_pct')} FROM y GROUP BY 1, 2")
def recall_per_cell(spark, sf):
    return shown(profile.cell_recall(_events_cube(spark, sf), "hit", "pred", ["lat_i", "lon_i"]), "recall", "event_pct", keep=["lat_i", "lon_i"])


@query(f"WITH {CUBE} SELECT lat_i, lon_i, {q('sqrt(avg(pow(u * 33 - v, 2)))', 'rmse')}, {q('avg(u * 33 - v)', 'mean_error')} FROM cube GROUP BY 1, 2")
def rmse_per_cell(spark, sf):
    c = cube(spark, sf).withColumn("p", F.col("u") * 33)
    return shown(profile.cell_errors(c, "v", "p", ["lat_i", "lon_i"]), "rmse", "mean_error", keep=["lat_i", "lon_i"])


@query(f"WITH {CUBE} SELECT CAST(t % 12 + 1 AS INT) AS month, lat_i, lon_i, {q('avg(v)', 'v')}, {q('avg(u)', 'u')} FROM cube GROUP BY 1, 2, 3")
def monthly_maps(spark, sf):
    made = profile.monthly_maps(cube(spark, sf).withColumn("month", F.col("t") % 12 + 1), F.col("month"), ["v", "u"], ["lat_i", "lon_i"])
    return shown(made, "v", "u", keep=["month", "lat_i", "lon_i"])


@query(f"WITH {CUBE} SELECT t, {q('avg(v)', 'mean_v')}, {q('max(v)', 'max_v')} FROM cube GROUP BY 1")
def spatial_mean_series(spark, sf):
    return shown(profile.means_and_peaks(cube(spark, sf), ["t"], ["v"]), "mean_v", "max_v", keep=["t"])


@query(f"WITH {CUBE} SELECT lat_i, lon_i, {q('avg(v)', 'mean_v')}, {q('max(v)', 'max_v')}, {q('avg(u)', 'mean_u')}, {q('max(u)', 'max_u')} FROM cube GROUP BY 1, 2")
def temporal_maps(spark, sf):
    return shown(profile.means_and_peaks(cube(spark, sf), ["lat_i", "lon_i"], ["v", "u"]), "mean_v", "max_v", "mean_u", "max_u", keep=["lat_i", "lon_i"])


@query(f"WITH {CUBE}, r AS (SELECT quantile_cont(v - 150000, 0.02) AS a, quantile_cont(v - 150000, 0.98) AS b FROM cube) SELECT {q('-greatest(abs(a), abs(b))', 'low')}, {q('greatest(abs(a), abs(b))', 'high')} FROM r")
def plot_range(spark, sf):
    return shown(profile.plot_range(cube(spark, sf).withColumn("a", F.col("v") - 150000), "a", symmetric=True), "low", "high", keep=[])


@query("SELECT c_custkey, CAST(round_even(least(greatest(c_acctbal / 40, 0), 254), 0) AS SMALLINT) AS packed, CAST(round_even(c_acctbal * 2, 0) AS INT) AS key FROM customer")
def packed_values(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fn.packed_u8(F.col("c_acctbal") / 40).alias("packed"), fn.coordinate_key(F.col("c_acctbal"), 2).alias("key"))


@query("SELECT DISTINCT p_name, CAST(CASE WHEN regexp_matches('x_2021_' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '_y.zarr', '_[0-9]{4}_[0-9]{2}_') THEN 2021 END AS INT) AS y, CAST(p_size AS INT) AS m, TRY_CAST(p_brand AS DOUBLE) AS num FROM part")
def string_functions(spark, sf):
    name = F.concat(F.lit("x_2021_"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("_y.zarr"))
    year, month = fn.year_month_of(name)
    return table(spark, sf, "part").select("p_name", year.alias("y"), month.alias("m"), fn.to_number(F.col("p_brand")).alias("num")).distinct()


# ---- land


_MASK = f"{CUBE}, g AS (SELECT lat_i, lon_i, CASE WHEN avg(v) > 150000 THEN 1 ELSE 0 END AS land FROM cube GROUP BY 1, 2)"


def _mask(spark, sf):
    return cube(spark, sf).groupBy("lat_i", "lon_i").agg(F.when(F.avg("v") > 150000, 1).otherwise(0).alias("land"))


def _coast_sql() -> str:
    near = lambda f, g: (
        f"SELECT a.lat_i, a.lon_i, {f}(a.land, " + ", ".join(f"coalesce((SELECT b.land FROM {g} b WHERE b.lat_i = a.lat_i + {i} AND b.lon_i = a.lon_i + {j}), 0)" for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))) + f") AS land FROM {g} a"
    )
    dist = lambda g: (
        f"SELECT a.lat_i, a.lon_i, (CASE WHEN a.land = 1 THEN 1 ELSE -1 END) * coalesce(min(sqrt(pow(a.lat_i - b.lat_i, 2) + pow(a.lon_i - b.lon_i, 2))), 0) * 111.1e0 AS d FROM {g} a LEFT JOIN {g} b ON b.land <> a.land GROUP BY a.lat_i, a.lon_i, a.land"
    )
    return f"WITH {_MASK}, dil AS ({near('greatest', 'g')}), clo AS ({near('least', 'dil')}), x AS ({dist('g')}), z AS ({dist('clo')}) SELECT x.lat_i, x.lon_i, {q('x.d', 'distance_to_coast_km')}, {q('z.d', 'distance_to_coast_dilated_km')} FROM x JOIN z ON z.lat_i = x.lat_i AND z.lon_i = x.lon_i"


@query(_coast_sql())
def coast_distance(spark, sf):
    return shown(land.coast_distance(_mask(spark, sf), "land", 1.0), "distance_to_coast_km", "distance_to_coast_dilated_km", keep=["lat_i", "lon_i"])


@query(
    f"WITH {CUBE}, h AS (SELECT lat_i, lon_i, avg(v) AS e FROM cube GROUP BY 1, 2), o AS (SELECT h.lat_i, h.lon_i, least(greatest(h.lat_i + a.k, 0), 4) AS i, least(greatest(h.lon_i + b.k, 0), 4) AS j FROM h CROSS JOIN (SELECT unnest([-1, 0, 1]) AS k) a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS k) b)"
    f" SELECT o.lat_i, o.lon_i, {q('min(e)', 'e_min_2')}, {q('max(e)', 'e_max_2')}, {q('avg(e)', 'e_mean_2')} FROM o JOIN h ON h.lat_i = o.i AND h.lon_i = o.j GROUP BY 1, 2"
)
def elevation_stats(spark, sf):
    h = cube(spark, sf).groupBy("lat_i", "lon_i").agg(F.avg("v").alias("e"))
    return shown(land.relief(h, "e", [2.0], 1.0), "e_min_2", "e_max_2", "e_mean_2", keep=["lat_i", "lon_i"])


#: Two closed rings of (x, y), the second one concave.
_RINGS = {"a": [(0, 0), (6, 0), (6, 4), (0, 4), (0, 0)], "b": [(2, 1), (9, 1), (9, 9), (5, 9), (5, 5), (2, 5), (2, 1)]}
_POINTS = "pts AS (SELECT s_suppkey, s_acctbal / 1e3 AS x, s_nationkey / 3e0 + 1e-1 AS y FROM supplier)"
_EDGES_SQL = ", ".join(f"('{n}', {a[0]}, {a[1]}, {b[0]}, {b[1]})" for n, r in _RINGS.items() for a, b in zip(r, r[1:], strict=False))


def _polygons(spark):
    rows = [(n, [(float(x), float(y)) for x, y in r]) for n, r in _RINGS.items()]
    return spark.createDataFrame(rows, "name string, ring array<struct<x: double, y: double>>")


def _points(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1e3).alias("x"), (F.col("s_nationkey") / 3.0 + 0.1).alias("y"))


_HITS = (
    f"WITH {_POINTS}, e(name, x1, y1, x2, y2) AS (VALUES {_EDGES_SQL}), c AS (SELECT s_suppkey, name, count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(CAST(y2 - y1 AS DOUBLE), 0) + x1) AS k FROM pts CROSS JOIN e GROUP BY 1, 2),"
    " h AS (SELECT s_suppkey, name, row_number() OVER (PARTITION BY s_suppkey ORDER BY name) AS r FROM c WHERE k % 2 = 1)"
)


@query(f"{_HITS} SELECT p.s_suppkey, h.name FROM pts p LEFT JOIN h ON h.s_suppkey = p.s_suppkey AND h.r = 1")
def polygon_first(spark, sf):
    return land.within_polygons(_points(spark, sf), _polygons(spark), "x", "y", "s_suppkey", ["name"], order="name").select("s_suppkey", "name")


@query(f"{_HITS} SELECT p.s_suppkey, coalesce(h.name, 'Unknown') AS name FROM pts p LEFT JOIN h ON h.s_suppkey = p.s_suppkey")
def polygon_all(spark, sf):
    return land.within_polygons(_points(spark, sf), _polygons(spark), "x", "y", "s_suppkey", ["name"], fill="Unknown").select("s_suppkey", "name")


# ---- plans


@query(
    f"WITH {DENSE}, d AS (SELECT *, make_timestamp(CAST(t // 12 AS BIGINT), CAST(t % 12 + 1 AS BIGINT), 1, 0, 0, 0) AS ts FROM dense), g AS (SELECT {K}, CAST(month(ts) AS INT) AS month, lag(v, 1) OVER ({CELL}) AS l1, v - lag(v, 1) OVER ({CELL}) AS d1, avg(v) OVER (PARTITION BY t) AS m, {_slope_sql('v', 'lat')} AS gl FROM d)"
    f" SELECT {K}, month, {q('l1', 'v_lag1')}, {q('d1', 'v_diff1')}, {q('m', 'v_global_mean')}, {q('gl', 'v_grad_lat')} FROM g"
)
def feature_plan(spark, sf):
    plan = {"temporal": {"month": True, "day_of_year": False, "sin_cos_annual": False}, "lag": {"variables": ["v"], "lags": [1]}, "gradients": {"variables": ["v"]}, "temporal_diff": {"variables": ["v"], "periods": [1]}, "regional": {"variables": ["v"], "stats": ["mean"]}}
    when = F.make_timestamp_ntz(F.floor(F.col("t") / 12).cast("int"), F.col("t") % 12 + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    made = build(dense(spark, sf).withColumn("time", when), plan)
    return shown(made, "v_lag1", "v_diff1", "v_global_mean", "v_grad_lat", keep=[*KEY, "month"])


@query(f"SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS time, event_type, {q('avg(value)', 'v')}, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_cube(spark, sf):
    from ..streaming import windowed_cube as made

    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return shown(made(events, "ts", "value", ["event_type"]).withColumn("time", F.col("time").cast("timestamp_ntz")), "v", keep=["time", "event_type", "n"])


@query(
    "SELECT p_name, CASE WHEN contains(lower(x), 'temperature') OR lower(x) IN ('t2m', 'd2m', 'stl1') THEN 'K' WHEN contains(lower(x), 'humidity') THEN 'kg/kg' WHEN contains(lower(x), 'wind') OR lower(x) IN ('u10', 'v10', 'fg10', 'i10fg') THEN 'm/s'"
    " WHEN contains(lower(x), 'geopotential') THEN 'm²/s²' ELSE '' END AS unit FROM (SELECT DISTINCT p_name, CASE p_size % 5 WHEN 0 THEN 'Temperature_850' WHEN 1 THEN 'u10' WHEN 2 THEN 'geopotential_h00' WHEN 3 THEN 'specific_humidity' ELSE p_name END AS x FROM part)"
)
def unit_names(spark, sf):
    size = F.col("p_size") % 5
    name = F.when(size == 0, "Temperature_850").when(size == 1, "u10").when(size == 2, "geopotential_h00").when(size == 3, "specific_humidity").otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_name", name.alias("x")).distinct().select("p_name", fn.unit_of(F.col("x")).alias("unit"))


@query("SELECT n_nationkey, coalesce(printf('%.4f', CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey / 8e0 END), '-') AS shown FROM nation")
def formatted_report(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", fn.shown(F.when(F.col("n_nationkey") % 4 > 0, F.col("n_nationkey") / F.lit(8.0))).alias("shown"))


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_DRAW}) AS k, count(*) OVER () AS n FROM orders) WHERE k <= floor(n * 6e-2)")
def sample_share(spark, sf):
    return sampling.uniform_share(_orders_drawn(spark, sf), 0.06, "draw").select("o_orderkey")


@query(f"WITH {CUBE} SELECT t, CAST(dense_rank() OVER (ORDER BY t) - 1 AS INT) AS t_pos FROM (SELECT DISTINCT t FROM cube)")
def axis_positions(spark, sf):
    return axes.axis(cube(spark, sf), "t", "t_pos")


@query(f"WITH {CUBE}, r AS (SELECT n_nationkey, n_regionkey FROM nation) SELECT t, lat_i, lon_i, {q('v', 'v')}, n_regionkey FROM cube JOIN r ON r.n_nationkey = lat_i * 5 + lon_i")
def static_raster(spark, sf):
    raster = table(spark, sf, "nation").select(F.floor(F.col("n_nationkey") / 5).cast("int").alias("lat_i"), (F.col("n_nationkey") % 5).cast("int").alias("lon_i"), "n_regionkey")
    return shown(align.common([cube(spark, sf), raster], ["lat_i", "lon_i"]), "v", keep=[*KEY, "n_regionkey"])


@query(f"WITH {CUBE} SELECT {K}, {q(f'lag(v, 1) OVER ({CELL})', 'v_lag1')}, {q(f'v - lag(v, 2) OVER ({CELL})', 'v_diff2')} FROM cube")
def incremental_columns(spark, sf):
    from ..sources import add_missing

    c = cube(spark, sf)
    old = temporal.lags(c, ["v"], [1])
    return shown(add_missing(old, ["v_lag1", "v_diff2"], KEY, lambda lacking: temporal.diffs(c, ["v"], [2])), "v_lag1", "v_diff2", keep=KEY)


@query("SELECT c_custkey, CAST(c_acctbal AS FLOAT) AS c_acctbal FROM customer")
def single_precision(spark, sf):
    return reshape.single_precision(table(spark, sf, "customer").select("c_custkey", "c_acctbal"))


@query("SELECT c.c_custkey, c.c_acctbal, s.s_acctbal, s.n AS c_acctbal_supplier FROM customer c LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS s_acctbal, CAST(count(*) AS DOUBLE) AS n FROM supplier GROUP BY 1) s ON s.s_nationkey = c.c_nationkey")
def clashing_columns(spark, sf):
    right = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("s_acctbal"), F.count("*").cast("double").alias("c_acctbal"))
    return reshape.add_columns(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), right, ["c_nationkey"], "supplier").drop("c_nationkey")


def _near_sql_polygons() -> str:
    radius = "6378137e0"
    x, y = (lambda c: f"({radius} * radians({c}))"), (lambda c: f"({radius} * ln(tan(pi() / 4 + radians({c}) / 2)))")
    edge = f"SELECT name, {x('x1')} AS ax, {y('y1')} AS ay, {x('x2')} AS bx, {y('y2')} AS by_ FROM e"
    t = "least(greatest(((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 0), 1)"
    return (
        f"{_HITS}, m AS ({edge}), p AS (SELECT s_suppkey, {x('x')} AS px, {y('y')} AS py FROM pts),"
        f" d AS (SELECT s_suppkey, name, min(sqrt(pow(px - ax - {t} * (bx - ax), 2) + pow(py - ay - {t} * (by_ - ay), 2))) AS gap FROM p CROSS JOIN m GROUP BY 1, 2),"
        " n AS (SELECT d.s_suppkey, avg(CASE d.name WHEN 'a' THEN 4e0 ELSE 8e0 END) AS weight FROM d LEFT JOIN h ON h.s_suppkey = d.s_suppkey AND h.name = d.name WHERE gap <= 150000 OR h.name IS NOT NULL GROUP BY 1)"
        " SELECT pts.s_suppkey, n.weight FROM pts LEFT JOIN n ON n.s_suppkey = pts.s_suppkey"
    )


@query(_near_sql_polygons())
def polygon_near(spark, sf):
    weighted = _polygons(spark).withColumn("weight", F.when(F.col("name") == "a", 4.0).otherwise(8.0))
    return land.near_polygons_mean(_points(spark, sf), weighted, "x", "y", "s_suppkey", "weight", 150_000).select("s_suppkey", "weight")


@query(
    "SELECT l_orderkey, l_linenumber, y, w FROM (SELECT l_orderkey, l_linenumber, 1e0 AS y, l_discount * 10 AS w FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 0e0, 1 - l_discount * 10 FROM lineitem) WHERE w > 0"
)
def soft_label_rows(spark, sf):
    from ..ml import soft_rows

    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("p"))
    return soft_rows(rows, "p").select("l_orderkey", "l_linenumber", F.col("_label").alias("y"), F.col("_weight").alias("w"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube with lags, differences, a smoothed mean and domain-wide statistics."""
    d = dense(spark, sf_dir)
    made = climatology.regional(temporal.ewm(temporal.diffs(temporal.lags(d, ["v"], [1]), ["v"], [1]), ["v"], [3]), ["v"], ["mean"])
    return shown(made, "v_lag1", "v_diff1", "v_ewm3", "v_global_mean", keep=KEY)




# ---- whole runs from a configuration

_RUN = {
    "data": {"target_var": "y", "train_years": [1996, 1997, 1999], "latitude_range": [0, 6], "longitude_range": [4, 0], "sample_fraction": 0.4, "random_seed": 7, "subsampling": {"mode": "tail_preserving", "positive_threshold": 80.0, "near_miss_threshold": 60.0}},
    "feature_engineering": {"lag": {"variables": ["v"], "lags": [1, 2]}, "regional": {"variables": ["v"], "stats": ["mean"]}},
    "binarization": {"enabled": True, "threshold_val": 70.0, "operator": "greater"},
    "sample_weights": {"threshold_moderate": 30.0, "threshold_extreme": 60.0, "threshold_very_extreme": 90.0},
}
_RUN_ROWS = (
    "f AS (SELECT o.o_orderdate AS time, CAST(floor(c.c_nationkey / 5) AS DOUBLE) AS latitude, CAST(c.c_nationkey % 5 AS DOUBLE) AS longitude, avg(o.o_totalprice) AS v FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2, 3),"
    " ch AS (SELECT f.*, y FROM f JOIN (VALUES (1996), (1997), (1999)) w(y) ON time >= make_date(y, 1, 1) - INTERVAL 7 DAY AND time < make_date(y + 1, 1, 1)),"
    " l AS (SELECT *, lag(v, 1) OVER p AS v1, lag(v, 2) OVER p AS v2, avg(v) OVER (PARTITION BY y, time) AS g FROM ch WINDOW p AS (PARTITION BY y, latitude, longitude ORDER BY time)),"
    " tg AS (SELECT CAST(l_shipdate + INTERVAL 9 HOUR AS TIMESTAMP) AS time, l_linenumber % 6 + 2.5e-1 AS latitude, CAST(l_suppkey % 5 AS DOUBLE) AS longitude, sum(l_quantity) AS y FROM lineitem WHERE year(l_shipdate) IN (1996, 1997, 1999) GROUP BY 1, 2, 3),"
    " j AS (SELECT tg.*, l.v, l.v1, l.v2, l.g, CAST(year(tg.time) AS INT) AS yr, CAST(month(tg.time) AS INT) AS mo FROM tg JOIN (SELECT DISTINCT y, time FROM ch) d ON d.y = year(tg.time) AND d.time = date_trunc('day', tg.time)"
    " LEFT JOIN l ON l.y = d.y AND l.time = d.time AND l.latitude = floor(tg.latitude) AND l.longitude = tg.longitude)"
)


@query(
    f"WITH {_RUN_ROWS}, r AS (SELECT *, y >= 60 AS keep, row_number() OVER (PARTITION BY yr, mo, y >= 60 ORDER BY md5('7|' || CAST(time AS VARCHAR) || '|' || CAST(latitude AS VARCHAR) || '|' || CAST(longitude AS VARCHAR))) AS k,"
    " count(*) OVER (PARTITION BY yr, mo) AS n, count(*) FILTER (WHERE y >= 60) OVER (PARTITION BY yr, mo) AS kept FROM j)"
    f" SELECT time, latitude, longitude, {q('y', 'y')}, {q('CAST(v AS FLOAT)', 'v')}, {q('CAST(v1 AS FLOAT)', 'v_lag1')}, {q('CAST(v2 AS FLOAT)', 'v_lag2')}, {q('CAST(g AS FLOAT)', 'v_global_mean')}, CASE WHEN y > 70 THEN 1 ELSE 0 END AS target_binary,"
    f" {q('CASE WHEN y >= 90 THEN 10 WHEN y >= 60 THEN 5 WHEN y >= 30 THEN 2 ELSE 1 END', 'weight')} FROM r WHERE keep OR k <= greatest(greatest(floor(n * 4e-1), 1) - kept, 0)"
)
def config_run(spark, sf):
    """The whole way from a configuration: context of years, features, nearest times and points, labels, weights, sampling."""
    o, c, i = (table(spark, sf, name) for name in ("orders", "customer", "lineitem"))
    cell = [F.floor(F.col("c_nationkey") / 5).cast("double").alias("latitude"), (F.col("c_nationkey") % 5).cast("double").alias("longitude")]
    features = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("o_orderdate").alias("time"), *cell).agg(F.avg("o_totalprice").alias("v"))
    place = [(F.col("l_shipdate") + F.expr("INTERVAL 9 HOURS")).alias("time"), (F.col("l_linenumber") % 6 + 0.25).cast("double").alias("latitude"), (F.col("l_suppkey") % 5).cast("double").alias("longitude")]
    target = i.groupBy(*place).agg(F.sum("l_quantity").alias("y"))
    made = runs.prepared(features, target, _RUN)
    return shown(made, "y", "v", "v_lag1", "v_lag2", "v_global_mean", "weight", keep=["time", "latitude", "longitude", "target_binary"])
