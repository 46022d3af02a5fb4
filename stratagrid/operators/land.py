"""Static land data: distance to the coast, relief statistics, polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .axes import KEYS, Keys

KM_PER_DEGREE = 111.1
#: Radius of the sphere of web Mercator coordinates, in metres.
MERCATOR_RADIUS = 6_378_137.0


def morphology(df: DataFrame, mask: str, kind: str, keys: Keys = KEYS) -> DataFrame:
    """Dilation or erosion of a 0/1 mask by a point's four neighbours; outside the grid there is 0."""
    down, across = Window.partitionBy(keys.lon).orderBy(keys.lat), Window.partitionBy(keys.lat).orderBy(keys.lon)
    near = [F.coalesce(f(mask).over(w), F.lit(0)) for w in (down, across) for f in (F.lag, F.lead)]
    made = F.greatest(F.col(mask), *near) if kind == "dilate" else F.least(F.col(mask), *near)
    return df.withColumn("_m", made).drop(mask).withColumnRenamed("_m", mask)


def _distance(df: DataFrame, mask: str, of: int, name: str, keys: Keys) -> DataFrame:
    """Euclidean distance, in grid steps, of each point to the nearest point whose mask is `of`; NULL if there is none.

    Exact and separable: the nearest such point within the column first, then over the row of those results, so
    that a point meets its row and not the whole grid.
    """
    i, j = keys.lat, keys.lon
    up, down = Window.partitionBy(j).orderBy(i).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(j).orderBy(i).rowsBetween(0, Window.unboundedFollowing)
    own = F.when(F.col(mask) == of, F.col(i))
    df = df.withColumn("_g", F.least(F.col(i) - F.last(own, ignorenulls=True).over(up), F.first(own, ignorenulls=True).over(down) - F.col(i)))
    row = df.where("_g IS NOT NULL").select(F.col(i).alias("_i"), F.col(j).alias("_j"), F.col("_g").alias("_h"))
    near = df.select(i, j).join(row, F.col(i) == F.col("_i")).groupBy(i, j).agg(F.sqrt(F.min(F.pow(F.col(j) - F.col("_j"), F.lit(2)) + F.pow("_h", F.lit(2)))).alias(name))
    return df.drop("_g").join(near, [i, j], "left")


def coast_distance(df: DataFrame, mask: str, step_degrees: float, keys: Keys = KEYS) -> DataFrame:
    """distance_to_coast_km and, after closing the mask, distance_to_coast_dilated_km.

    df: a dense grid (one row for each point) with a mask, land where it is over 0. Distances are over 0 on land
    and under 0 at sea.
    """
    df = df.withColumn("_land", F.when(F.coalesce(F.col(mask), F.lit(0)) > 0, 1).otherwise(0))
    base = df.select(*keys.cell, "_land")
    closed = morphology(morphology(base, "_land", "dilate", keys), "_land", "erode", keys)
    for frame, name in ((base, "distance_to_coast_km"), (closed, "distance_to_coast_dilated_km")):
        both = _distance(_distance(frame, "_land", 0, "_to_sea", keys), "_land", 1, "_to_land", keys)
        signed = F.when(F.col("_land") == 1, F.coalesce("_to_sea", F.lit(0.0))).otherwise(-F.coalesce("_to_land", F.lit(0.0)))
        df = df.join(both.select(*keys.cell, (signed * step_degrees * KM_PER_DEGREE).alias(name)), keys.cell)
    return df.drop("_land")


def _padded(df: DataFrame, height: str, r: int, keys: Keys) -> DataFrame:
    """(_i, _j, _h, _own): the dense grid with its border repeated r points beyond it; _own marks its own points."""
    i, j = keys.lat, keys.lon
    ends = df.agg(F.min(i).alias("_i0"), F.max(i).alias("_i1"), F.min(j).alias("_j0"), F.max(j).alias("_j1"))  # one row

    def reach(c: str, low: str, high: str) -> Column:
        return F.explode(F.sequence(F.when(F.col(c) == F.col(low), F.col(c) - r).otherwise(F.col(c)), F.when(F.col(c) == F.col(high), F.col(c) + r).otherwise(F.col(c))))

    wide = df.select(i, j, F.col(height).cast("double").alias("_h")).crossJoin(F.broadcast(ends))
    wide = wide.withColumn("_i", reach(i, "_i0", "_i1")).withColumn("_j", reach(j, "_j0", "_j1"))
    return wide.select("_i", "_j", "_h", ((F.col("_i") == F.col(i)) & (F.col("_j") == F.col(j))).alias("_own"))


def _sums(x: Column) -> dict[str, Column]:
    """What a single value adds to a window's count, sum, squares, least and greatest value."""
    return {"n": F.when(x.isNotNull(), 1).otherwise(0), "s": F.coalesce(x, F.lit(0.0)), "q": F.coalesce(x * x, F.lit(0.0)), "lo": x, "hi": x}


def _joined(parts: list[dict[str, Column]]) -> dict[str, Column]:
    if len(parts) == 1:
        return parts[0]
    add = lambda k: sum((F.coalesce(p[k], F.lit(0)) for p in parts[1:]), F.coalesce(parts[0][k], F.lit(0)))
    return {k: add(k) for k in ("n", "s", "q")} | {"lo": F.least(*(p["lo"] for p in parts)), "hi": F.greatest(*(p["hi"] for p in parts))}


def _over(names: dict[str, str], w: Window) -> dict[str, Column]:
    made = {"n": F.sum, "s": F.sum, "q": F.sum, "lo": F.min, "hi": F.max}
    return {k: made[k](F.col(c)).over(w) for k, c in names.items()}


def _stats(sums: dict[str, Column], prefix: str, tag: str) -> dict[str, Column]:
    n = F.nullif(sums["n"], F.lit(0))
    mean = sums["s"] / n
    return {f"{prefix}_min_{tag}": sums["lo"], f"{prefix}_max_{tag}": sums["hi"], f"{prefix}_mean_{tag}": mean, f"{prefix}_std_{tag}": F.sqrt(F.greatest(sums["q"] / n - mean * mean, F.lit(0.0)))}


def relief(df: DataFrame, height: str, degrees: list[float], resolution: float, keys: Keys = KEYS) -> DataFrame:
    """{height}_{min,max,mean,std}_{d} over windows of d degrees whose border repeats beyond the dense grid, and
    {height}_grad_{min,max,mean,std}_{d} of the slope's size within each window.

    Two passes, along rows and then along columns over their results. A slope is a central difference inside a
    window and one-sided (`f` forward, `b` backward) on its edges, so that the edges' strips are added apart.
    """
    i, j = keys.lat, keys.lon
    down, across = Window.partitionBy("_j").orderBy("_i"), Window.partitionBy("_i").orderBy("_j")
    for d in degrees:
        r, tag = max(1, math.ceil(d / 2 / resolution)), f"{d:g}".replace(".", "_")
        grid, inner, whole = _padded(df, height, r, keys), (1 - r, r - 1), (-r, r)
        slopes = {}
        for name, w in (("d", down), ("a", across)):
            back, on, here = F.lag("_h").over(w), F.lead("_h").over(w), F.col("_h")
            slopes |= {f"_{name}f": on - here, f"_{name}b": here - back, f"_{name}c": F.when(back.isNull(), on - here).when(on.isNull(), here - back).otherwise((on - back) / 2)}
        sizes = {f"_{k}{m}": F.sqrt(F.col(f"_d{k}") * F.col(f"_d{k}") + F.col(f"_a{m}") * F.col(f"_a{m}")) for k in "cfb" for m in "cfb"}
        grid = grid.withColumns(slopes).withColumns(sizes)
        names = {f: {k: f"_{f}_{k}" for k in ("n", "s", "q", "lo", "hi")} for f in ["h", *(f"{k}{m}" for k in "cfb" for m in "cfb")]}
        grid = grid.withColumns({names[f][k]: c for f in names for k, c in _sums(F.col(f"_{f}")).items()})
        at = lambda f, steps, w: {k: F.lag(c, steps).over(w) for k, c in names[f].items()}
        strips = {"h": _over(names["h"], across.rowsBetween(*whole))}
        strips |= {k: _joined([_over(names[f"{k}c"], across.rowsBetween(*inner)), at(f"{k}f", r, across), at(f"{k}b", -r, across)]) for k in "cfb"}
        grid = grid.select("_i", "_j", "_own", *(c.alias(f"_{f}_{k}") for f, made in strips.items() for k, c in made.items()))
        names = {f: {k: f"_{f}_{k}" for k in made} for f, made in strips.items()}
        heights = _over(names["h"], down.rowsBetween(*whole))
        steep = _joined([_over(names["c"], down.rowsBetween(*inner)), at("f", r, down), at("b", -r, down)])
        totals = {f"_t_{f}_{k}": c for f, made in (("h", heights), ("g", steep)) for k, c in made.items()}
        grid = grid.select("_i", "_j", "_own", *(c.alias(n) for n, c in totals.items())).where("_own")
        col = lambda f: {k: F.col(f"_t_{f}_{k}") for k in ("n", "s", "q", "lo", "hi")}
        made = _stats(col("h"), height, tag) | _stats(col("g"), f"{height}_grad", tag)
        df = df.join(grid.select(F.col("_i").alias(i), F.col("_j").alias(j), *(c.alias(n) for n, c in made.items())), [i, j], "left")
    return df


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.lit(MERCATOR_RADIUS) * F.radians(lon), F.lit(MERCATOR_RADIUS) * F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2))


def _tiled(points: DataFrame, polygons: DataFrame, x: str, y: str, ring: str, tile: float, reach: float = 0.0) -> DataFrame:
    """Pairs of points and polygons that share a tile, by an equi-join; reach widens the polygons' boxes."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    span = lambda c: F.sequence(F.floor((F.array_min(c) - reach) / tile), F.floor((F.array_max(c) + reach) / tile))
    tiles = polygons.withColumn("_tx", F.explode(span(xs))).withColumn("_ty", F.explode(span(ys)))
    return points.withColumns({"_tx": F.floor(F.col(x) / tile), "_ty": F.floor(F.col(y) / tile)}).join(tiles, ["_tx", "_ty"]).drop("_tx", "_ty")


def _edges(ring: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda k: F.struct(F.element_at(ring, k).alias("a"), F.element_at(ring, k + 1).alias("b")))


def inside(x: Column, y: Column, ring: str) -> Column:
    """True if a ray from the point crosses the closed ring (array of x, y) an odd number of times."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(_edges(ring), lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def within_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, point_id: str, attributes: list[str], ring: str = "ring", order: str | None = None, tile: float = 1.0, how: str = "left", fill: str | None = None) -> DataFrame:
    """points with the attributes of the polygon they lie in: of the first by `order`, or of each if order is None."""
    hits = _tiled(points.select(point_id, x, y), polygons.select(*dict.fromkeys([*attributes, ring, *([order] if order else [])])), x, y, ring, tile).where(inside(F.col(x), F.col(y), ring))
    if order:
        hits = hits.withColumn("_k", F.row_number().over(Window.partitionBy(point_id).orderBy(order))).where("_k = 1")
    joined = points.join(hits.select(point_id, *attributes), point_id, how)
    return joined.na.fill(fill, attributes) if fill is not None else joined


def near_polygons_mean(points: DataFrame, polygons: DataFrame, x: str, y: str, point_id: str, value: str, metres: float, ring: str = "ring", tile: float = 1.0) -> DataFrame:
    """points with the mean value of the polygons within so many web Mercator metres; NULL without one."""
    reach = metres / (MERCATOR_RADIUS * math.pi / 180) * 1.5
    pairs = _tiled(points.select(point_id, x, y), polygons.select(value, ring), x, y, ring, tile, reach)
    px, py = mercator(F.col(x), F.col(y))

    def gap(e: Column) -> Column:
        (ax, ay), (bx, by) = mercator(e["a"]["x"], e["a"]["y"]), mercator(e["b"]["x"], e["b"]["y"])
        length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
        t = F.when(length > 0, F.least(F.greatest(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
        return F.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))

    close = inside(F.col(x), F.col(y), ring) | (F.array_min(F.transform(_edges(ring), gap)) <= metres)
    means = pairs.where(close).groupBy(point_id).agg(F.avg(value).alias(value))
    return points.join(means, point_id, "left")
