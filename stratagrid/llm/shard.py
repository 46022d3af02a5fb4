"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every row hashes to a point of a 64-bit ring. Each shard owns `vnodes` tokens on it and takes the rows
between a token and the one before it. No shard may hold more than its capacity, and the capacities add up to
the number of rows with at most one row between any two of them; rows that find their shard full continue
clockwise to the next shard that isn't. So the counts of any two shards differ by one at most, and a row
leaves its ring position's shard only where that shard is full.

The ring is cut into cells whose size follows the row count. Only row counts of cells reach the driver
(2**MOST_BITS of them at most, whatever the input); a row's place within its cell comes from a window over
the cell. No row is compared with another, and no shard's rows meet in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

CELL_ROWS, LEAST_BITS, MOST_BITS = 2048, 10, 20


def ring_tokens(shards: int, vnodes: int, bits: int) -> np.ndarray:
    """Owner of each ring cell: the shard of the first token at or after it, clockwise."""
    import xxhash

    cells = 1 << bits
    at = np.array([[xxhash.xxh64_intdigest(f"shard {s} token {v}") >> (64 - bits) for v in range(vnodes)] for s in range(shards)])
    order = sorted((int(at[s, v]), s) for s in range(shards) for v in range(vnodes))
    first: dict[int, int] = {}
    for cell, s in order:
        first.setdefault(cell, s)
    places = np.array(sorted(first))
    owner = np.array([first[c] for c in places])
    return owner[np.searchsorted(places, np.arange(cells)) % len(places)]


def clockwise(owner: np.ndarray, shards: int) -> np.ndarray:
    """[cell, k]: the k-th distinct shard that a walk clockwise from the cell meets; -1 past the last."""
    cells = len(owner)
    runs = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    seq = owner[runs]
    nxt = np.full((len(runs), shards), -1)
    upcoming: list[int] = []
    for i in range(2 * len(runs) - 1, -1, -1):  # twice round, from behind: the nearest shard moves to the front
        s = int(seq[i % len(runs)])
        if s in upcoming:
            upcoming.remove(s)
        upcoming.insert(0, s)
        if i < len(runs):
            nxt[i, : len(upcoming)] = upcoming
    return nxt[np.searchsorted(runs, np.arange(cells), side="right") - 1]


def fill(counts: np.ndarray, capacity: np.ndarray, walk: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): which ranks of a cell go to which shard."""
    left, used, out = counts.astype(np.int64).copy(), np.zeros(len(capacity), np.int64), []
    for k in range(walk.shape[1]):
        for s in range(len(capacity)):
            cells = np.flatnonzero((walk[:, k] == s) & (left > 0))
            if not len(cells) or used[s] >= capacity[s]:
                continue
            ends = np.minimum(np.cumsum(left[cells]), capacity[s] - used[s])
            takes = np.diff(ends, prepend=0)
            for c, take, end in zip(cells[takes > 0], takes[takes > 0], ends[takes > 0], strict=True):
                lo = int(counts[c] - left[c])
                out.append((int(c), lo, lo + int(take), s, int(used[s] + end - take)))
                left[c] -= take
            used[s] += ends[-1]
    assert not left.any()
    return out


def assign_shards(docs: DataFrame, shards: int = 16, vnodes: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, ring_shard.

    size is the UTF-8 length plus 1; a null text counts as no bytes (size 1, crc32 0). Null ids and repeated
    rows are rows like others; equal rows are interchangeable and get neighbouring slots. An empty table gives
    no rows. Other columns of docs are not read. ring_shard is the shard of the row's ring position, before
    any overflow.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "shard")
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
    ).withColumn("position", F.xxhash64("doc_id", "text_crc32", "size"))
    rows = scratch.table(rows, "rows")
    n = rows.count()
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, n / CELL_ROWS))))))
    rows = rows.withColumn("cell", F.expr(f"CAST(shiftrightunsigned(position, {64 - bits}) AS INT)"))
    counts = np.zeros(1 << bits, np.int64)
    for cell, count in rows.groupBy("cell").count().collect():  # 2**MOST_BITS rows at most
        counts[cell] = count
    capacity = np.array([n // shards + (s < n % shards) for s in range(shards)])
    owner = ring_tokens(shards, vnodes, bits)
    spans = pd.DataFrame(fill(counts, capacity, clockwise(owner, shards)), columns=["cell", "lo", "hi", "shard", "base"])
    spans["ring_shard"] = owner[spans["cell"].to_numpy(int)]
    spans = spark.createDataFrame(spans, "cell int, lo long, hi long, shard int, base long, ring_shard int") if len(spans) else spark.createDataFrame([], "cell int, lo long, hi long, shard int, base long, ring_shard int")
    spans = spans.groupBy("cell", "ring_shard").agg(F.collect_list(F.struct("lo", "hi", "shard", "base")).alias("spans"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("position", "doc_id", "text_crc32", "size")).cast("long") - 1
    placed = rows.withColumn("place", place).join(spans, "cell")
    placed = placed.withColumn("span", F.expr("filter(spans, x -> place >= x.lo AND place < x.hi)[0]"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("span.shard").alias("shard"),
        (F.col("span.base") + F.col("place") - F.col("span.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "ring_shard",
    )
