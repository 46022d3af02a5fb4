"""Connected components of a distributed list of links, by alternating large-star and small-star steps.

Before, each task replaces its links, of which it holds a bounded number, by a star for each of their components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: Links that a task holds at a time.
HELD = 1 << 20


def spanned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of all nodes but the least ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(i):
        x, y = root[i], root[j]
        apart = x != y
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (jumped := root[root] != root).any():
            root[jumped] = root[root[jumped]]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, total = [], 0

    def stars() -> pa.RecordBatch:
        a, b = spanned(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        total += batch.num_rows
        if total >= HELD:
            yield stars()
            held, total = [], 0
    if total:
        yield stars()


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Links each node's larger (both_ways) or smaller neighbours, and itself, to the least of them all.

    The least neighbour is an aggregate that Spark combines before its shuffle; the links themselves are
    joined to it, so that no node's neighbours are gathered in one place.
    """
    # a > b in each edge; large-star looks at all neighbours of a node, small-star at the smaller ones
    turned = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both_ways:
        least = seen.union(turned).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        moved = turned.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))  # v > u
    else:
        least = seen.groupBy("u").agg(F.min("v").alias("m"))
        moved = seen.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; component is the least node reachable.

    edges: two long columns a, b in any direction; loops and repeats don't matter.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, sign = scratch.table(now, "links"), None
    parts = max(1, -(-now.count() // HELD))
    now = scratch.table(now.coalesce(parts).mapInArrow(_spanned, "a long, b long").distinct(), "links0")
    for k in range(most_rounds):
        after = scratch.table(_star(_star(now, True), False), f"links{k + 1}")
        scratch.drop(f"links{k}")
        now = after
        # order-free sums tell whether a round changed anything
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == sign:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        sign = seen
    raise RuntimeError(f"links did not settle in {most_rounds} rounds")
