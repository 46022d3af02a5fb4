"""Runs from a configuration, tables kept by month, polygon files and nearest maps, against plain Python."""

import datetime
import math
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid import ml, sources
from stratagrid.operators import align, axes, land, sampling
from stratagrid.plans import runs

DAY = datetime.timedelta(days=1)
FEATURES = "time timestamp_ntz, latitude double, longitude double, t2m double"
TARGET = "time timestamp_ntz, latitude double, longitude double, y double"


def days(first, n):
    return [datetime.datetime.fromisoformat(first) + k * DAY for k in range(n)]


def grid(spark, times, value, schema, shift=0.0, hours=0):
    rows = [(t + datetime.timedelta(hours=hours), lat + shift, float(lon), value(t, lat, lon)) for t in times for lat in (40.0, 41.0) for lon in (10, 11)]
    return spark.createDataFrame(rows, schema)


def test_context_of_a_year_reaches_back(spark):
    config = {"data": {"target_var": "y", "train_years": [2021]}, "features": ["t2m"], "feature_engineering": {"lag": {"variables": ["t2m"], "lags": [1, 3]}}}
    assert runs.context_days(config) == 8 and runs.context_days({"feature_engineering": {"enabled": False}}) == 0
    assert runs.context_days({"feature_engineering": {"ewm": {"spans": [3, 7]}}}) == 26
    day = lambda t, *_: float(t.toordinal())
    features, target = grid(spark, days("2020-12-01", 40), day, FEATURES), grid(spark, days("2020-12-20", 20), day, TARGET, 0.25, 9)
    got = runs.prepared(features, target, config).collect()
    assert len(got) == 8 * 4 and {r.time.year for r in got} == {2021}
    assert all(r.t2m == r.time.toordinal() and r.t2m_lag1 == r.t2m - 1 and r.t2m_lag3 == r.t2m - 3 for r in got)
    two = runs.prepared(features, target, config, years=[2020, 2021])
    assert two.count() == 20 * 4 and two.where("t2m_lag3 IS NULL").count() == 0


def test_times_and_points_without_a_match(spark):
    config = {"data": {"target_var": "y", "train_years": [2021]}, "feature_engineering": {"enabled": False}}
    features = grid(spark, days("2021-03-01", 2), lambda *_: 1.0, FEATURES)
    target = grid(spark, days("2021-03-01", 4), lambda *_: 2.0, TARGET, 0.7, 6)
    got = runs.prepared(features, target.withColumnRenamed("y", "other"), config).collect()
    assert len(got) == 2 * 4 and {(round(r.latitude, 1), r.t2m) for r in got} == {(40.7, 1.0), (41.7, None)}
    for a, b in ((features.limit(0), target), (features, target.limit(0))):
        assert runs.prepared(a, b, config).count() == 0


def test_smoothing_labels_weights_and_outside_predictions(spark):
    config = {
        "data": {"target_var": "y", "train_years": [2021]}, "feature_engineering": {"enabled": False}, "label_smoothing": {"enabled": True, "temporal_sigma": 1.0, "temporal_radius": 1, "spatial_radius": 0},
        "binarization": {"enabled": True, "threshold_val": 0.5, "operator": "greater"}, "sample_weights": {"threshold_moderate": 0.1, "threshold_extreme": 0.9, "threshold_very_extreme": 2.0},
    }
    times = days("2021-03-01", 5)
    features = grid(spark, times, lambda *_: 1.0, FEATURES)
    target = grid(spark, times, lambda t, lat, lon: None if lat == 41.0 and t == times[0] else float(t == times[2]), TARGET)
    regression = grid(spark, times[:1], lambda *_: 7.0, FEATURES.replace("t2m", "reg_pred_anomaly"))
    got = runs.prepared(features, target, config, regression=regression).collect()
    side = math.exp(-0.5) / (1 + 2 * math.exp(-0.5))
    assert len(got) == 5 * 4 - 2
    for r in got:
        k = times.index(r.time)
        assert r.y == pytest.approx({2: 1.0, 1: side, 3: side}.get(k, 0.0), abs=1e-6) and r.y_hard == float(k == 2)
        assert (r.target_binary, r.weight) == {2: (1, 5.0), 1: (0, 2.0), 3: (0, 2.0)}.get(k, (0, 1.0)) and r.reg_pred_anomaly == (7.0 if k == 0 else 0.0)


def test_shares_by_month_and_split(spark):
    config = {"data": {"target_var": "y", "train_years": [2020, 2021], "sample_fraction": 0.25}, "feature_engineering": {"enabled": False}, "training": {"validation_size": 0.5}}
    times = days("2020-12-11", 42)
    features, target = (grid(spark, times, lambda t, lat, lon: float(t.day == 1), s) for s in (FEATURES, TARGET))
    months = lambda df: {(r.y, r.m): r.n for r in df.groupBy(F.year("time").alias("y"), F.month("time").alias("m")).agg(F.count("*").alias("n")).collect()}
    got = runs.prepared(features, target, config)
    assert months(got) == {(2020, 12): 21, (2021, 1): 21}
    train, valid = runs.split(got, config)
    assert months(train) == {(2020, 12): 21} and months(valid) == {(2021, 1): 21}
    config["data"]["subsampling"] = {"mode": "tail-preserving"}
    with pytest.raises(ValueError):
        runs.prepared(features, target, config)
    config["data"]["subsampling"]["positive_threshold"] = 1.0
    assert runs.prepared(features, target, config).where("y = 1").count() == 4
    rows = spark.createDataFrame([(g, f"{k:02d}") for g in "ab" for k in range(5)], "g string, k string")
    assert sampling.group_share(rows, ["g"], 0.5, "k").groupBy("g").count().select("count").distinct().collect()[0][0] == 2


def test_months_are_kept_once(spark, tmp_path):
    asked = []

    def make(months):
        asked.append(months)
        return grid(spark, days("2021-01-15", 30), lambda t, *_: float(t.month), FEATURES).withColumn("month", F.month("time"))

    folder, config = str(tmp_path / "months"), {"a": 1}
    assert sources.kept_months(spark, folder, config, [(2021, 1), (2021, 3)], make).count() == 17 * 4
    again = sources.kept_months(spark, folder, config, [(2021, 3), (2021, 2), (2021, 1)], make)
    assert asked == [[(2021, 1), (2021, 3)], [(2021, 2)]] and again.count() == 30 * 4 and again.columns[-1] == "month"
    assert sources.kept_months(spark, folder, config, [(2021, 3)], make).count() == 0 and len(asked) == 2
    assert sources.kept_months(spark, folder, {"a": 2}, [(2022, 1)], make).count() == 0 and len(asked) == 3


@pytest.mark.parametrize("tolerance", [None, 0.5, 7, 400])
@pytest.mark.parametrize("ties", ["larger", "smaller"])
def test_nearest_maps(spark, tolerance, ties):
    rng = np.random.default_rng(3)
    a, b = np.unique(rng.integers(-900, 4000, 500)) / 2, np.unique(rng.integers(0, 3000, 120)) / 2
    frame = lambda x, n: spark.createDataFrame([(float(v),) for v in x] * 2 + [(None,)], f"{n} double")
    got = {r.a: r.b for r in axes.nearest_map(frame(a, "a"), frame(b, "b"), "a", "b", tolerance, ties).collect()}
    want = {}
    for x in a:
        gap = abs(b - x).min()
        if tolerance is None or gap <= tolerance:
            near = b[abs(b - x) == gap]
            want[x] = near.max() if ties == "larger" else near.min()
    assert got == want
    assert axes.nearest_map(frame(a, "a"), frame([], "b"), "a", "b", tolerance).count() == 0


def test_long_axes_are_numbered(spark):
    x = np.unique(np.random.default_rng(4).integers(0, 10**6, 3000))
    d = spark.createDataFrame([(int(v),) for v in x] * 2, "x long")
    for down in (False, True):
        assert [r.p for r in axes.axis(d, "x", "p", down).orderBy("x").collect()] == (list(range(len(x)))[::-1] if down else list(range(len(x))))


def test_outer_merge_takes_the_first_value(spark):
    a, b = spark.createDataFrame([(1, 1.0, None), (2, None, 5.0)], "k int, u double, v double"), spark.createDataFrame([(2, 7.0), (3, 8.0)], "k int, u double")
    assert {tuple(r) for r in align.merged([a, b], ["k"]).select("k", "u", "v").collect()} == {(1, 1.0, None), (2, 7.0, 5.0), (3, 8.0, None)}


def test_relief_of_wide_windows(spark):
    h = np.random.default_rng(5).normal(size=(6, 5)) * 100
    d = spark.createDataFrame([(int(i) + 3, int(j) - 2, float(h[i, j])) for i, j in np.ndindex(h.shape)], "lat_i int, lon_i int, h double")
    padded = np.pad(h, 2, mode="edge")
    for r in land.relief(d, "h", [4.0], 1.0).collect():
        part = padded[r.lat_i - 3 : r.lat_i + 2, r.lon_i + 2 : r.lon_i + 7]
        size = np.hypot(*np.gradient(part))
        for name, x in (("h", part), ("h_grad", size)):
            assert [r[f"{name}_{s}_4"] for s in ("min", "max", "mean", "std")] == pytest.approx([x.min(), x.max(), x.mean(), x.std()])


OUTER, HOLE, PART = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(3, 3), (6, 3), (6, 6), (3, 6), (3, 3)], [(20, 0), (20, 4), (24, 4), (24, 0), (20, 0)]


def _hits(spark, polygons):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 4.5, 4.5), (3, 22.0, 2.0), (4, 15.0, 5.0)], "id int, px double, py double")
    return {(r.id, r.name) for r in land.within_polygons(points, polygons, "px", "py", "id", ["name"]).collect()}


def test_geopackages(spark, tmp_path):
    ring = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r)
    polygon = lambda *rs: struct.pack("<BII", 1, 3, len(rs)) + b"".join(map(ring, rs))
    shape = struct.pack("<BII", 1, 6, 2) + polygon(OUTER, HOLE) + polygon(PART)
    path = tmp_path / "areas.gpkg"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        db.execute("CREATE TABLE areas (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT, population REAL)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('areas', 'geom')")
        db.execute("INSERT INTO areas VALUES (5, ?, 'a', 12.5), (6, NULL, 'none', 1)", (b"GP\0\x03" + struct.pack("<i4d", 4326, 0, 24, 0, 9) + shape,))
    db.close()
    got = sources.read_polygons(spark, str(path), "name string, population double")
    assert {(r.fid, r.part, r.name, r.population) for r in got.collect()} == {(5, 0, "a", 12.5), (5, 1, "a", 12.5)}
    assert _hits(spark, got) == {(1, "a"), (2, None), (3, "a"), (4, None)}


def test_shapefiles(spark, tmp_path):
    points = [*OUTER, *HOLE, *PART]
    body = struct.pack("<I4d", 5, 0, 0, 24, 9) + struct.pack("<2I3I", 3, len(points), 0, 5, 10) + b"".join(struct.pack("<2d", *p) for p in points)
    (tmp_path / "areas.shp").write_bytes(bytes(100) + struct.pack(">II", 1, len(body) // 2) + body + struct.pack(">II", 2, 2) + struct.pack("<I", 0))
    field = lambda n, size: n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([size]) + bytes(15)
    head = bytes(4) + struct.pack("<IHH", 2, 32 + 64 + 1, 13) + bytes(20)
    (tmp_path / "areas.dbf").write_bytes(head + field("name", 8) + field("pop", 4) + b"\r" + b" north   12.5" + b" none        ")
    got = sources.read_polygons(spark, str(tmp_path / "areas.shp"), "name string, pop double")
    assert {(r.fid, r.part, r.name, r.pop) for r in got.collect()} == {(1, 0, "north", 12.5), (1, 1, "north", 12.5)}
    assert _hits(spark, got) == {(1, "north"), (2, None), (3, "north"), (4, None)}


def test_tuning_picks_a_setting(spark):
    d = spark.range(200).select((F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 10 > 5, 1).otherwise(0).alias("y"))
    model = ml.tune_classifier(d, ["x"], "y", {"maxDepth": [1, 2], "maxIter": [2]})
    assert len(model.validationMetrics) == 2 and max(model.validationMetrics) > 0.9
