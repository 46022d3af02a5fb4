"""Edge cases of operators: borders, gaps, ties, NULLs, wrong parameters; and properties against numpy."""

import datetime
import fractions
import json
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid import functions as fn
from stratagrid import ml, sources
from stratagrid.operators import align, axes, climatology, evaluate, labels, land, physics, profile, reshape, sampling, spatial, temporal
from stratagrid.plans import features


def grid(spark, values):
    """Cube of an array [t, lat, lon]; NaN is NULL."""
    a = np.asarray(values, float)
    rows = [(int(t), int(i), int(j), None if np.isnan(a[t, i, j]) else float(a[t, i, j])) for t, i, j in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, "t int, lat_i int, lon_i int, v double")


def series(spark, values):
    return grid(spark, np.array([np.nan if x is None else x for x in values], float).reshape(-1, 1, 1))


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*(order or ("t", "lat_i", "lon_i"))).collect()]


def close(a, b, digits=9):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert (x is None) == (y is None or np.isnan(y)) and (x is None or x == pytest.approx(float(y), abs=10**-digits, rel=1e-9))


# ---- time


def test_wrong_parameters_warn_and_are_left_out(spark):
    d = series(spark, [1, 2, 3])
    with pytest.warns(UserWarning):
        assert temporal.lags(d, ["v", "absent"], [0, -1, 1]).columns[-1:] == ["v_lag1"]
    with pytest.warns(UserWarning):
        assert "v_ewm1" not in temporal.ewm(d, ["v"], [1, 3]).columns
    with pytest.warns(UserWarning):
        assert spatial.window_stats(d, ["v"], [2, 1], ["mean"]).columns == d.columns
    with pytest.warns(UserWarning):
        assert physics.divergence_vorticity(d, "u", "v").columns == d.columns


def test_differences_are_value_less_lag(spark):
    d = temporal.diffs(temporal.lags(series(spark, [1, None, 4, 8]), ["v"], [1]), ["v"], [1])
    assert [(r.v_lag1, r.v_diff1) for r in d.orderBy("t").collect()] == [(None, None), (1.0, None), (None, None), (4.0, 4.0)]


def plain_ewm(x, span):
    a, y, out = 2 / (span + 1), None, []
    for v in x:
        if not np.isnan(v):
            y = v if y is None else a * v + (1 - a) * y
        out.append(np.nan if y is None else y)
    return np.array(out)


@pytest.mark.parametrize("n, span", [(1, 3), (5, 3), (64, 7), (65, 14), (500, 30)])
def test_smoothed_mean_is_the_recurrence(n, span):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    x[rng.random(n) < 0.3] = np.nan
    np.testing.assert_allclose(temporal.ewm_values(x, span), plain_ewm(x, span), rtol=1e-9)


def test_smoothed_mean_carries_over_gaps(spark):
    close(column(temporal.ewm(series(spark, [None, 2, None, 4]), ["v"], [3]), "v_ewm3"), [np.nan, 2, 2, 3])


def test_rolling_quantiles_need_a_full_frame(spark):
    d = series(spark, [1, 2, None, 4, 10])
    close(column(temporal.rolling_quantiles(d, "v", 3, {"m": 0.5}), "m"), [np.nan, np.nan, 1.5, 3, 7])
    close(column(temporal.rolling_quantiles(d, "v", 4, {"m": 0.5}, centred=True), "m"), [np.nan, np.nan, 2, 4, np.nan])
    close(column(temporal.rolling_quantiles(d, "v", 9, {"m": 0.5}), "m"), [np.nan] * 5)


def test_forward_fill_leaves_a_leading_gap(spark):
    assert column(temporal.forward_fill(series(spark, [None, 1, None, None, 2]), ["v"]), "v_ffill") == [None, 1, 1, 1, 2]


def test_leap_day(spark):
    d = spark.createDataFrame([(datetime.datetime(2024, 12, 31),), (datetime.datetime(2023, 12, 31),)], "time timestamp_ntz")
    assert sorted(r[0] for r in d.select(F.dayofyear("time")).collect()) == [365, 366]
    assert {r[0] for r in d.select(fn.clipped_doy(F.col("time"))).collect()} == {365}


# ---- space


def brute_window(a, w, f):
    out, r = np.full(a.shape, np.nan), w // 2
    for t, i, j in np.ndindex(a.shape):
        part = a[t, max(0, i - r) : i + r + 1, max(0, j - r) : j + r + 1]
        part = part[~np.isnan(part)]
        out[t, i, j] = f(part) if len(part) else np.nan
    return out


@pytest.mark.parametrize("w", [3, 5])
def test_windows_are_brute_force(spark, w):
    rng = np.random.default_rng(w)
    a = 250_000 + rng.normal(size=(2, 6, 7))
    a[rng.random(a.shape) < 0.3] = np.nan
    d = spatial.window_stats(grid(spark, a), ["v"], [w], ["mean", "std", "min", "max", "median"]).persist()
    for stat, f in (("mean", np.mean), ("std", np.std), ("min", np.min), ("max", np.max), ("median", np.median)):
        close(column(d, f"v_{stat}{w}"), brute_window(a, w, f).ravel(), 6)
    least = spatial.window_stats(grid(spark, a), ["v"], [w], ["mean"], min_periods=7)
    count = brute_window(a, w, len).ravel()
    assert [x is None for x in column(least, f"v_mean{w}")] == [not n >= 7 for n in count]


def test_gradients_are_numpy_s(spark):
    a = np.random.default_rng(1).normal(size=(2, 4, 5))
    d = spatial.gradients(grid(spark, a), ["v"], lat_step=-0.25, lon_step=0.5)
    close(column(d, "v_grad_lat"), np.gradient(a, 0.25, axis=1).ravel())
    close(column(d, "v_grad_lon"), np.gradient(a, 0.5, axis=2).ravel())
    close(column(spatial.gradients(grid(spark, a), ["v"], axis_order="stored"), "v_grad_lat"), -np.gradient(a, axis=1).ravel())
    assert column(spatial.gradients(grid(spark, a[:, :1, :1]), ["v"]), "v_grad_lat") == [None, None]


def test_uneven_derivative_is_numpy_s(spark):
    x = np.array([0.0, 1.0, 3.0, 3.5, 7.0])
    v = np.sin(x)
    d = spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in enumerate(zip(x, v, strict=True))], "k int, x double, v double")
    from pyspark.sql import Window

    got = d.withColumn("g", spatial.differentiate(F.col("v"), F.col("x"), Window.orderBy("k")))
    close(column(got, "g", "k"), np.gradient(v, x))


# ---- alignment


def test_nearest_ties_and_tolerance(spark):
    want = spark.createDataFrame([(0.5,), (1.0,), (5.0,), (-9.0,)], "x double")
    offered = spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "y double")
    found = lambda **k: {r.x: r.y for r in axes.nearest_map(want, offered, "x", "y", **k).collect()}
    assert found() == {0.5: 1.0, 1.0: 1.0, 5.0: 3.0, -9.0: 0.0}
    assert found(ties="smaller")[0.5] == 0.0
    assert found(tolerance=2.0) == {0.5: 1.0, 1.0: 1.0, 5.0: 3.0}


def test_nearest_time_takes_the_later_of_two(spark):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    want = spark.createDataFrame([(at(6),), (at(23),)], "w timestamp_ntz")
    offered = spark.createDataFrame([(at(0), 1), (at(12), 2)], "h timestamp_ntz, x int")
    assert [(r.w, r.x) for r in align.nearest_time(want, offered, "w", "h").orderBy("w").collect()] == [(at(6), 2), (at(23), 2)]
    assert align.nearest_time(want, offered, "w", "h", 3600).count() == 0


def test_nearest_grid_keeps_rows_without_a_match(spark):
    want = spark.createDataFrame([(10.1, 20.1), (50.0, 20.0)], "la double, lo double")
    have = spark.createDataFrame([(10.0, 20.0, 7), (10.5, 20.5, 8)], "gla double, glo double, x int")
    assert sorted((r.la, r.x) for r in align.nearest_grid(want, have, {"la": "gla", "lo": "glo"}).collect()) == [(10.1, 7), (50.0, None)]


def test_first_of_duplicates_and_lookup(spark):
    day = datetime.datetime(2024, 1, 1, 12)
    left = spark.createDataFrame([(1, day, 0.125, 3.0), (2, day, 9.0, 9.0)], "id int, time timestamp_ntz, lat double, lon double")
    right = spark.createDataFrame([(day, 0.121, 3.0, 5.0, 1), (day, 0.119, 3.0, 6.0, 0)], "time timestamp_ntz, lat double, lon double, p double, k int")
    assert [r.p for r in align.quantised_lookup(left, right, "time", "lat", "lon", "p", ["k"]).orderBy("id").collect()] == [6.0, 0.0]


def test_outside_labels_tell_absent_rows(spark):
    d = spark.createDataFrame([(datetime.datetime(2024, 1, k, 6), 0) for k in (1, 2)], "time timestamp_ntz, lat_i int")
    y = spark.createDataFrame([(datetime.date(2024, 1, 1), 0, 1)], "date date, lat_i int, y int")
    assert [(r.y, r.valid) for r in align.outside_labels(d, y, "time", ["lat_i"], "y").orderBy("time").collect()] == [(1, True), (0, False)]


def test_dense_grid_has_every_row(spark):
    d = spark.createDataFrame([(0, 0, 0, 1.0), (1, 2, 1, 2.0)], "t int, lat_i int, lon_i int, v double")
    assert axes.densify(d).count() == 8 and axes.densify(d).where("v IS NOT NULL").count() == 2
    assert [(r.x, r.p) for r in axes.axis(spark.createDataFrame([(3.0,), (1.0,), (3.0,), (None,)], "x double"), "x", "p", descending=True).orderBy("p").collect()] == [(3.0, 0), (1.0, 1)]


# ---- labels


def test_events_at_thresholds(spark):
    d = spark.createDataFrame([(x,) for x in (-5.1, -5.0, 5.0, 5.1, None, float("nan"))], "x double")
    got = d.select(labels.binarised(F.col("x"), 5.0, "cold").alias("c"), labels.binarised(F.col("x"), 5.0, "heat").alias("h")).collect()
    assert [(r.c, r.h) for r in got] == [(1, 0), (0, 0), (0, 0), (0, 1), (0, 0), (0, 0)]
    w = spark.createDataFrame([(x,) for x in (0.0, -5.0, 9.9, 10.0, -15.0)], "x double").select(labels.tier_weight(F.col("x")).alias("w"))
    assert [r.w for r in w.collect()] == [1, 2, 2, 5, 10]


def test_smoothing_keeps_ones_and_replicates_edges(spark):
    ones = labels.smoothed(grid(spark, np.ones((4, 3, 3))), "v", temporal=(1.5, 3), spatial=(1.0, 2))
    close(column(ones, "smooth"), [1.0] * 36)
    a = np.zeros((5, 1, 1))
    a[0] = 1
    g = labels.gaussian(1.0, 1)
    got = column(labels.smoothed(grid(spark, a), "v", temporal=(1.0, 1), spatial=(1.0, 0)), "smooth")
    close(got, [1.0, g[0], 0, 0, 0])


def test_relaxed_recall_is_not_less(spark):
    rng = np.random.default_rng(2)
    d = grid(spark, (rng.random((30, 2, 2)) > 0.8).astype(float)).withColumn("p", F.when(F.rand(1) > 0.7, 1.0).otherwise(0.0)).persist()
    r = labels.relaxed(d, ["p"]).agg(F.sum(F.col("v") * F.col("p")).alias("a"), F.sum(F.col("v") * F.col("p_relaxed")).alias("b")).first()
    assert r.b >= r.a


# ---- sampling


def test_exact_samples(spark):
    d = spark.range(1000).withColumn("draw", sampling.draw_key("id"))
    first = sampling.uniform(d, 100, "draw").collect()
    assert len(first) == 100 and sampling.uniform(d.repartition(7), 100, "draw").exceptAll(spark.createDataFrame(first, d.schema)).count() == 0
    assert sampling.uniform(d, 5000, "draw").count() == 1000
    want = [r.id for r in d.orderBy("draw").limit(100).collect()]
    assert sorted(want) == sorted(r.id for r in first)
    assert sampling.uniform_share(d, 0.25, "draw").count() == 250


def test_tails_may_exceed_the_target(spark):
    d = spark.range(100).select("id", F.lit(1).alias("m"), (F.col("id") >= 40).cast("double").alias("y"), sampling.draw_key("id").alias("draw"))
    assert sampling.tail_preserving(d, "y", 0.1, 1.0, 1.0, ["m"], "draw").count() == 60
    assert sampling.tail_preserving(d.where("id < 40"), "y", 0.001, 1.0, 1.0, ["m"], "draw").count() == 1
    nothing = d.where("id < 0")
    assert sampling.tail_preserving(nothing, "y", 0.1, 1.0, 1.0, ["m"], "draw").count() == 0


def test_undersampling_keeps_positives(spark):
    d = spark.range(1000).select("id", F.when(F.col("id") < 7, 1).otherwise(0).alias("y"), sampling.draw_key("id").alias("draw"))
    got = sampling.undersampled(d, "y", 50, "draw").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {1: 7, 0: 350}


def test_split_by_years():
    assert sampling.split_years([2020, 2021, 2022, 2023, 2024], 0.3) == ([2020, 2021, 2022], [2023, 2024])
    assert sampling.split_years([2020, 2021], 5) == ([2020], [2021])
    with pytest.raises(ValueError):
        sampling.split_years([2020], 0.2)


# ---- evaluation


def scored(spark, y, s):
    return spark.createDataFrame(list(zip(y, s, strict=True)), "y int, s double")


def test_counts_add_up_and_empty_denominators_are_zero(spark):
    d = spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "y int, p int")
    r = evaluate.confusion(d, "y", "p").first()
    assert r.tp + r.fp + r.fn + r.tn == 3 and r.recall == 0.5 and r.precision == 1.0 and r.balanced_accuracy == 0.75
    none = evaluate.confusion(d.where("y = 0").withColumn("p", F.lit(0)), "y", "p").first()
    assert (none.precision, none.recall, none.f1, none.balanced_accuracy) == (0, 0, 0, 1.0)
    assert evaluate.regression(d.where("y > 5"), "y", "p").first().n == 0


def test_curves_are_brute_force(spark):
    rng = np.random.default_rng(6)
    y, s = (rng.random(400) > 0.7).astype(int), np.round(rng.random(400), 2)
    d = scored(spark, y.tolist(), s.tolist())
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert evaluate.roc_auc(d, "y", "s").first()[0] == pytest.approx(np.mean(pairs))
    ap, last = 0.0, 0.0
    for x in sorted(set(s), reverse=True):
        p, r = y[s >= x].mean(), y[s >= x].sum() / y.sum()
        ap, last = ap + (r - last) * p, r
    assert evaluate.average_precision(d, "y", "s").first()[0] == pytest.approx(ap)
    one = scored(spark, [1, 1], [0.1, 0.9])
    assert evaluate.roc_auc(one, "y", "s").first()[0] == 0.0


def test_sweep_counts_each_threshold(spark):
    d = scored(spark, [1, 0, 1, 0], [0.05, 0.5, 0.5, None])
    got = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in evaluate.sweep(d, "y", "s", [0.5, 0.05, 0.95]).collect()}
    assert got == {0.05: (2, 1, 0, 1), 0.5: (1, 1, 1, 1), 0.95: (0, 0, 2, 2)}
    assert evaluate.best_threshold(evaluate.sweep(d, "y", "s", [0.5, 0.05, 0.95])).first().threshold == 0.05


def test_calibration_of_a_constant(spark):
    d = spark.createDataFrame([(1.0, 3.0), (1.0, 5.0)], "p double, y double")
    assert [r.calibrated for r in evaluate.calibrated(d, "p", "y", "both").collect()] == [4.0, 4.0]


# ---- profiles and land


def test_histogram_of_one_value_and_of_none(spark):
    assert [(r.bin, r.n) for r in profile.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 5).collect()] == [(0, 2)]
    assert profile.histogram(spark.createDataFrame([], "v double"), "v", 5).count() == 0


def test_coast_distance_is_brute_force(spark):
    rng = np.random.default_rng(9)
    mask = (rng.random((7, 8)) > 0.6).astype(int)
    d = spark.createDataFrame([(int(i), int(j), int(mask[i, j])) for i, j in np.ndindex(mask.shape)], "lat_i int, lon_i int, m int")
    got = {(r.lat_i, r.lon_i): r.distance_to_coast_km for r in land.coast_distance(d, "m", 0.25).collect()}
    for i, j in np.ndindex(mask.shape):
        other = np.argwhere(mask != mask[i, j])
        far = np.sqrt(((other - [i, j]) ** 2).sum(1).min()) * 0.25 * 111.1
        assert got[i, j] == pytest.approx(far if mask[i, j] else -far)


def test_polygons(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    polygons = spark.createDataFrame([("a", 4.0, square), ("b", 8.0, [(x + 1, y) for x, y in square])], "name string, pop double, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 0.5, 1.0), (2, 1.5, 1.0), (3, 5.0, 5.0)], "id int, x double, y double")
    first = land.within_polygons(points, polygons, "x", "y", "id", ["name"], order="name")
    assert [r.name for r in first.orderBy("id").collect()] == ["a", "a", None]
    assert land.within_polygons(points, polygons, "x", "y", "id", ["name"], how="inner").count() == 3
    near = {r.id: r["pop"] for r in land.near_polygons_mean(points, polygons, "x", "y", "id", "pop", 60_000).collect()}
    assert near == {1: 6.0, 2: 6.0, 3: None}  # 0.5 degrees are 56 km


def test_relief_repeats_the_border(spark):
    a = np.arange(12.0).reshape(3, 4)
    d = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in np.ndindex(a.shape)], "lat_i int, lon_i int, h double")
    padded = np.pad(a, 1, mode="edge")
    for r in land.relief(d, "h", [1.0], 1.0).collect():
        part = padded[r.lat_i : r.lat_i + 3, r.lon_i : r.lon_i + 3]
        gy, gx = np.gradient(part)
        assert (r.h_min_1, r.h_max_1) == (part.min(), part.max()) and r.h_std_1 == pytest.approx(part.std()) and r.h_grad_mean_1 == pytest.approx(np.hypot(gy, gx).mean())


# ---- sources and plans


def test_cubes_are_read_with_uniform_names(spark, tmp_path):
    path = str(tmp_path / "cube")
    rows = [(datetime.datetime(y, 6, 1), float(lat), 1.0, float("nan") if y == 2020 else 2.0) for y in (2020, 2021) for lat in (50, 40)]
    sources.write_by_year(spark.createDataFrame(rows, "valid_time timestamp_ntz, lat double, lon double, t2m double"), path, "valid_time")
    got = sources.read_cube(spark, path, ["t2m", "absent"], years=[2020], lat_range=(55, 45))
    assert got.columns == ["time", "latitude", "longitude", "t2m"] and [(r.latitude, r.t2m) for r in got.collect()] == [(50.0, None)]
    assert sources.read_cube(spark, path, years=[1999]).count() == 0
    assert sources.target_of(got) == "t2m" and sources.sniffed(got, ["fg10", "t2m"]) == "t2m"
    assert sources.latest(sources.read_cube(spark, path)).select("time").distinct().count() == 1


def test_monthly_files_and_kept_tables(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "raw"))
    part = next((tmp_path / "raw").glob("part-*.parquet"))
    part.rename(tmp_path / "x_2021_07_y.parquet")
    assert {(r.file_year, r.file_month) for r in sources.read_monthly(spark, str(tmp_path / "x_2021_07_y.parquet")).collect()} == {(2021, 7)}
    calls = []
    make = lambda: (calls.append(1), spark.range(5))[1]
    folder = str(tmp_path / "kept")
    for _ in range(2):
        assert sources.kept(spark, folder, {"b": 1, "a": [2]}, make).count() == 5
    assert len(calls) == 1 and len(sources.evict(spark, folder, 0)) == 1
    sources.write_report(spark.range(2), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2
    (tmp_path / "c.json").write_text(json.dumps({"features": ["t2m"], "data": {}}))
    assert sources.load_config(str(tmp_path / "c.json"))["data"]["features"] == ["t2m"]
    assert sources.register_sources(spark) in ([], ["gridstore"])


PLAN = {
    "enabled": True, "temporal": {"month": True, "day_of_year": True, "sin_cos_annual": True}, "wind_physics": {"enabled": True, "u_var": "u10", "v_var": "v10"}, "lag": {"variables": ["wind10_speed"], "lags": [1, 2]},
    "ewm": {"variables": ["t2m"], "spans": [3]}, "spatial": {"variables": ["t2m"], "window_sizes": [3], "stats": ["mean", "std"]}, "gradients": {"variables": ["u10", "v10"]}, "temporal_diff": {"variables": ["t2m"], "periods": [1]},
    "climatology": {"variables": ["t2m"]}, "wind_chill": {"enabled": True, "temp_var": "t2m", "u_var": "u10", "v_var": "v10"}, "advection": {"enabled": True, "temp_var": "t2m", "u_var": "u10", "v_var": "v10"},
    "regional": {"variables": ["t2m"], "stats": ["mean"]}, "anomaly": {"variables": ["u10"]},
}


def test_a_plan_yields_the_columns_it_names(spark):
    rng = np.random.default_rng(0)
    rows = [(datetime.datetime(2024, 1, 1 + t), t, i, j, 40.0 + i, 30.0 + j, *map(float, 280 + rng.normal(size=3))) for t in range(4) for i in range(3) for j in range(3)]
    d = spark.createDataFrame(rows, "time timestamp_ntz, t int, lat_i int, lon_i int, latitude double, longitude double, t2m double, u10 double, v10 double")
    made = features.build(d, PLAN)
    names = features.feature_names(["t2m", "u10", "v10"], PLAN)
    assert sorted(names) == sorted(set(made.columns) - {"time", "t", "lat_i", "lon_i", "latitude", "longitude"}) and made.count() == 36
    assert features.lacking(PLAN, ["t2m"], names) == []
    assert features.build(d, {"enabled": False}).columns == d.columns
    with pytest.raises(ValueError):
        features.build(d, {"climatology": {"variables": ["t2m"]}, "anomaly": {"variables": ["t2m"]}}, strict=True)
    old = made.drop("t2m_lag1", "t2m_diff1")
    again = sources.add_missing(old, ["t2m_diff1", "t2m_ewm3"], ["t", "lat_i", "lon_i"], lambda lacking: features.build(d, {"temporal_diff": PLAN["temporal_diff"]}))
    assert again.where("t2m_diff1 IS NOT NULL").count() == 27


def test_columns_that_clash_get_new_names(spark):
    assert reshape.fresh_name("a", "x", {"a", "a_x"}) == "a_x_2"
    left, right = spark.createDataFrame([(1, 2)], "k int, a int"), spark.createDataFrame([(1, 3)], "k int, a int")
    assert reshape.add_columns(left, right, ["k"], "src").first().asDict() == {"k": 1, "a": 2, "a_src": 3}


def test_anomalies_with_an_outside_climatology(spark):
    d = spark.createDataFrame([(datetime.datetime(2024, 12, 31), 0, 0, 5.0)], "time timestamp_ntz, lat_i int, lon_i int, v double")
    clim = spark.createDataFrame([(366, 0, 0, 2.0), (365, 0, 0, 1.0)], "dayofyear int, lat_i int, lon_i int, v double")
    assert climatology.doy_anomaly(d, ["v"], "time", ["lat_i", "lon_i"], clim).first().v_anom == 3.0
    assert climatology.climatology_lookup(d, clim, "time", ["lat_i", "lon_i"], "v", "normal").first().normal == 1.0


# ---- learning and streams


def test_two_stage_learning(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), int(a + b > 0), float(a + b)) for a, b in rng.normal(size=(400, 2))]
    d = spark.createDataFrame(rows, "a double, b double, y int, z double").persist()
    first = ml.predict(ml.fit_regressor(d, ["a", "b"], "z", maxIter=5), d, "z_pred")
    model = ml.fit_classifier(first, ["a", "b", "z_pred"], "y", positive_weight=2.0, maxIter=5)
    got = ml.predict(model, first, "p")
    assert got.where("p = y").count() > 360 and {r.feature for r in ml.importance(model, ["a", "b", "z_pred"]).collect()} == {"a", "b", "z_pred"}
    soft = ml.soft_rows(d.withColumn("s", F.lit(0.25)), "s")
    assert soft.count() == 800 and soft.agg(F.sum("_weight")).first()[0] == pytest.approx(400)


def test_streams(spark, tmp_path):
    from stratagrid import streaming

    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [("a", t(0), 1.0), ("a", t(5), 3.0), ("b", t(1), None), ("b", t(2), 4.0)]
    spark.createDataFrame(rows, "cell string, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema("cell string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    for name, frame, mode in (("ewm_out", streaming.stream_ewm(read, "ts", "v", "cell", 3), "append"), ("cube_out", streaming.windowed_cube(read, "ts", "v", ["cell"], "10 minutes"), "complete")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [(r.cell, r.ewm) for r in spark.table("ewm_out").orderBy("cell", "time").collect()] == [("a", 1.0), ("a", 2.0), ("b", None), ("b", 4.0)]
    assert sorted((r.cell, r.v, r.n) for r in spark.table("cube_out").collect()) == [("a", 2.0, 2), ("b", 4.0, 2)]


def test_nothing_warns_on_good_parameters(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        temporal.lags(series(spark, [1.0]), ["v"], [1])


def test_quantiles_by_ranges_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    a = np.r_[rng.normal(0, 1, 3000), np.full(2000, 7.0), rng.integers(0, 5, 1000)]
    rows = [(float(x), 3.0, None, float(k) if k == 11 else None) for k, x in enumerate(a)]
    df = spark.createDataFrame(rows, "a double, same double, nothing double, one double")
    levels = [0.0, 0.013, 0.25, 0.5, 0.77, 1.0]
    got = {(r.variable, r.level): r.value for r in profile.exact_quantiles(df, ["a", "same", "nothing", "one"], levels).collect()}
    for x in levels:
        assert abs(got["a", x] - np.quantile(a, x)) < 1e-9
        assert got["same", x] == 3.0 and got["nothing", x] is None and got["one", x] == 11.0
    assert profile.quantiles(df.where("a > 100"), "a", [0.5]).collect()[0].value is None
    assert profile.describe(df, ["nothing"]).collect()[0].median is None


def test_merged_parts_and_report_without_years(spark):
    a, b = spark.createDataFrame([(1, 2.0), (2, None)], "t int, v double"), spark.createDataFrame([(2, 5.0, 1), (3, 6.0, 2)], "t int, v double, w int")
    assert sorted(map(tuple, align.merged([a, b], ["t"]).collect())) == [(1, 2.0, None), (2, 5.0, 1), (3, 6.0, 2)]
    y = spark.createDataFrame([], "year string, hit int, pred int, opt int, t double, p double")
    assert {r.year for r in evaluate.report(y, "year", "hit", "pred", "t", "p", "opt").collect()} <= {"ALL", "OPT"}


def test_coordinate_ties_are_those_of_the_coordinate(spark):
    values = [k / 1000.0 for k in range(-2000, 2001)] + [*np.nextafter([0.235, 0.235, 0.245], [0, 1, 1]).tolist(), 35.125, -35.135, None]
    got = spark.createDataFrame(list(enumerate(values)), "id int, c double").select("id", fn.coordinate_key(F.col("c")).alias("k")).orderBy("id").collect()
    thousandths = [round(fractions.Fraction(k, 10)) for k in range(-2000, 2001)]
    assert [r.k for r in got] == thousandths + [23, 24, 25, 3512, -3514, None]
