"""Polygon files, GeoPackage and shapefile, as tables of closed rings. Files come through Spark's binary reader, so that
any of its file systems serves; a file is read by one task and is 2 GB at most."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship

_RING = "ring array<struct<x: double, y: double>>"


def _closed(rings: list[np.ndarray]) -> list[dict]:
    """One closed ring of a polygon and its holes: a hole is reached and left by the same way, which a parity of crossings cancels."""
    outer = rings[0]
    points = [outer if (outer[0] == outer[-1]).all() else np.vstack([outer, outer[:1]])]
    for hole in rings[1:]:
        points += [hole if (hole[0] == hole[-1]).all() else np.vstack([hole, hole[:1]]), outer[:1]]
    return [{"x": float(x), "y": float(y)} for x, y in np.vstack(points)]


def _wkb(data: bytes, at: int = 0) -> tuple[list[list[np.ndarray]], int]:
    """Polygons (lists of rings) of a well-known binary geometry, and where it ends; other kinds have none."""
    order = "<" if data[at] == 1 else ">"
    kind = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    if kind & 0x20000000:  # an SRID follows
        at += 4
    iso = (kind & 0x0FFFFFFF) // 1000
    width = 2 + max(iso == 3, bool(kind & 0x80000000) + bool(kind & 0x40000000), iso in (1, 2)) + (iso == 3)
    kind = (kind & 0x0FFFFFFF) % 1000

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", data, at - 4)[0]

    if kind == 3:
        rings = []
        for _ in range(number()):
            n = number()
            rings.append(np.frombuffer(data, order + "f8", n * width, at).reshape(n, width)[:, :2])
            at += 8 * n * width
        return ([rings] if rings and len(rings[0]) else []), at
    if kind in (6, 7):
        found = []
        for _ in range(number()):
            part, at = _wkb(data, at)
            found += part
        return found, at
    return [], len(data)


def _geopackage(content: bytes, layer: str | None, names: list[str]) -> Iterator[tuple]:
    with sqlite3.connect(":memory:") as db:
        db.deserialize(content)
        where, args = (" WHERE table_name = ?", (layer,)) if layer else ("", ())
        table, column = db.execute(f"SELECT table_name, column_name FROM gpkg_geometry_columns{where} ORDER BY table_name", args).fetchone()
        quoted = ", ".join(f'"{n}"' for n in ["rowid", column, *names])
        for fid, blob, *values in db.execute(f'SELECT {quoted} FROM "{table}" ORDER BY rowid'):
            if blob is not None:
                envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]  # bytes of the box that precedes the geometry
                for part, rings in enumerate(_wkb(blob, 8 + envelope)[0]):
                    yield fid, part, *values, _closed(rings)


def _dbf(content: bytes) -> tuple[list[str], list[list[str]]]:
    rows, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("latin-1"), content[at + 16]))
        at += 32
    out = []
    for k in range(rows):
        at, values = head + k * size + 1, []
        for _, n in fields:
            values.append(content[at : at + n].decode("utf-8", "replace").strip())
            at += n
        out.append(values)
    return [n for n, _ in fields], out


def _area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y))


def _shapefile(content: bytes, attributes: bytes, names: list[str]) -> Iterator[tuple]:
    fields, rows = _dbf(attributes)
    at = 100
    while at + 8 <= len(content):
        number, words = struct.unpack_from(">II", content, at)
        body, at = at + 8, at + 8 + 2 * words
        if struct.unpack_from("<I", content, body)[0] not in (5, 15, 25):
            continue
        parts, points = struct.unpack_from("<II", content, body + 36)
        starts = [*struct.unpack_from(f"<{parts}I", content, body + 44), points]
        xy = np.frombuffer(content, "<f8", 2 * points, body + 44 + 4 * parts).reshape(points, 2)
        polygons: list[list[np.ndarray]] = []
        for a, b in zip(starts, starts[1:], strict=False):
            if polygons and _area(xy[a:b]) > 0:  # counterclockwise: a hole
                polygons[-1].append(xy[a:b])
            else:
                polygons.append([xy[a:b]])
        values = dict(zip(fields, rows[number - 1], strict=True))
        for part, rings in enumerate(polygons):
            yield number, part, *(values.get(n) or None for n in names), _closed(rings)


def read_polygons(spark: SparkSession, path: str, attributes: str, layer: str | None = None) -> DataFrame:
    """(fid, part, attributes, ring): a row for each polygon of each feature, its holes joined to it.

    path: a .gpkg or .shp file, the .dbf beside it; attributes: their names and types as DDL; layer: of a
    GeoPackage, by default its first one. Features without a geometry give no rows. Distances to a polygon with
    holes may be those to the way between border and hole.
    """
    names = StructType.fromDDL(attributes).fieldNames()
    ship(spark)
    shape = path.endswith(".shp")
    files = spark.read.format("binaryFile").load([path, path[:-4] + ".dbf"] if shape else path).select("path", "content")
    of = lambda end: F.max(F.when(F.col("path").endswith(end), F.col("content")))
    files = files.agg(of(".shp").alias("content"), of(".dbf").alias("attributes")) if shape else files.withColumn("attributes", F.lit(None).cast("binary"))

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content, rows in zip(frame["content"], frame["attributes"], strict=True):
                found = _shapefile(content, rows, names) if shape else _geopackage(content, layer, names)
                while part := [r for _, r in zip(range(1000), found, strict=False)]:
                    yield pd.DataFrame([(fid, k, *(None if v is None else str(v) for v in values), ring) for fid, k, *values, ring in part], columns=["fid", "part", *names, "ring"])

    texts = ", ".join(f"`{n}` string" for n in names)
    made = files.select("content", "attributes").mapInPandas(parsed, f"fid bigint, part int, {texts}, {_RING}")
    return made.select("fid", "part", *(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in StructType.fromDDL(attributes)), "ring")
