"""Exact dedup by content sort.

Splitters over the normalised bytes come from a sample: it is sorted, and rows at even distances cut it, by the
shortest prefix that tells its text from the one before, or, where these are equal, by the whole text and the
identifier. So a group that holds a third of all rows spreads over as many partitions as its size asks for.
Spark sorts each partition externally by the whole texts, so that equal ones are adjacent, and neighbours are
compared in full. A group can only cross a border whose splitter holds its whole text: the first and last texts
of a partition are compared with the splitters beside it, and groups that cross are joined from one record a border.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

#: Sampled rows for each partition.
SAMPLED = 16
RUN_SCHEMA = "doc_id long, row long, text_sha256 string, keep_id long, in_run long, kept_here boolean, part int, run long, chain int"


def normalised(text: Column) -> Column:
    """Each run of space, tab, LF, VT, FF and CR becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def splitter(before: str | None, text: str, doc_id: int | None, row: int) -> tuple:
    """The least key of a partition that begins with this text: a prefix, or the whole text where the one before is the same."""
    if before == text:
        return (text, doc_id is not None, doc_id or 0, row, True)
    n = 0
    for n, (a, b) in enumerate(zip(before or "", text, strict=False)):  # noqa: B007
        if a != b:
            break
    else:
        n = min(len(before or ""), len(text))
    return (text[: n + 1], False, 0, -1, False)


def splitters(rows: DataFrame, total: int, parts: int) -> list[tuple]:
    """Ascending keys (text, id is given, id, row, whether the text is whole) that cut rows into `parts` at most."""
    if parts < 2:
        return []
    below = F.pmod(F.xxhash64("doc_id", "row", F.octet_length("norm")), F.lit(1 << 40)) < int(min(1.0, parts * SAMPLED / max(1, total)) * (1 << 40))
    every = max(1, min(total, parts * SAMPLED) // parts // 2)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, k, out = None, 0, [[], [], [], [], []]
        for batch in slices(batches, "norm"):
            for doc, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("norm").to_pylist(), strict=True):
                if k and k % every == 0:
                    for column, value in zip(out, splitter(before, text, doc, row), strict=True):
                        column.append(value)
                before, k = text, k + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["text", "given", "doc_id", "row", "whole"])

    # SAMPLED rows for a partition, in one task
    ordered = rows.where(below).repartition(1).sortWithinPartitions("norm", "doc_id", "row")
    found = sorted({tuple(r) for r in ordered.mapInArrow(cut, "text string, given boolean, doc_id long, row long, whole boolean").collect()})
    return found if len(found) < parts else [found[k * len(found) // parts] for k in range(1, parts)]  # any of them cuts between texts


def _runs(keys: list[tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: rows with the number of their run of equal texts, without the text.

    chain: of a run that reaches a border, the first splitter with its text. Only identifiers of the run that is
    still open are held, never more than a partition has.
    """
    import pyspark

    part = pyspark.TaskContext.get().partitionId()
    borders = [keys[k] for k in (part - 1, part) if 0 <= k < len(keys) and keys[k][4]]
    last_text, run, ids, numbers = None, -1, [], []
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int32())
    out: list[list] = [[] for _ in types]

    def close() -> None:
        n, sha = len(ids), hashlib.sha256(last_text.encode()).hexdigest()
        chain = next((next(i for i, x in enumerate(keys) if x[4] and x[0] == last_text) for k in borders if k[0] == last_text), None)
        for column, values in zip(out, (ids, numbers, [sha] * n, [ids[0]] * n, [n] * n, [True] + [False] * (n - 1), [part] * n, [run] * n, [chain] * n), strict=True):
            column.extend(values)

    def flush() -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
        for column in out:
            column.clear()
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in RUN_SCHEMA.split(", ")])

    for batch in slices(batches, "norm"):
        texts, docs, rows = batch.column("norm"), batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
        fresh = [last_text is None or texts[0].as_py() != last_text]
        if len(docs) > 1:  # neighbours, compared in full
            fresh += pc.not_equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_pylist()
        starts = np.flatnonzero(fresh).tolist()
        if not starts or starts[0]:
            ids.extend(docs[: starts[0] if starts else None])
            numbers.extend(rows[: starts[0] if starts else None])
        for a, b in zip(starts, [*starts[1:], len(docs)], strict=True):
            if ids:
                close()
            last_text, run, ids, numbers = texts[a].as_py(), run + 1, docs[a:b], rows[a:b]
        if out[0]:
            yield flush()
    if ids:
        close()
        yield flush()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, row.

    Texts are equal if their normalised forms are, compared in full; a null text counts as empty. The row with
    the smallest id stays; a null id sorts before all others, and of rows that repeat an id within a group one
    stays: that with the least row_col (a number of its own for each row), if that is given. Empty tables give no
    rows; columns besides the id, the text and row_col are not read. The result reads tables in scratch, which the
    caller may clear afterwards.
    """
    spark, scratch = docs.sparkSession, scratch or Scratch(docs.sparkSession, "exact")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.col(row_col).cast("long") if row_col else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), normalised(F.col(text_col)).alias("norm"))
    keys = splitters(rows, docs.count(), parts)
    shared = spark.sparkContext.broadcast(keys)  # prefixes; whole texts only of groups with several of the sampled rows

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [k[:4] for k in shared.value]
        for batch in slices(batches, "norm"):
            found = zip(batch.column("norm").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), strict=True)
            part = pa.array([bisect_right(own, (t, d is not None, d or 0, r)) for t, d, r in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "norm")), part], names=["doc_id", "row", "norm", "part"])

    dealt = rows.mapInArrow(deal, "doc_id long, row long, norm string, part int").repartitionById(parts, F.col("part")).sortWithinPartitions("norm", "doc_id", "row")
    runs = scratch.table(dealt.select("doc_id", "row", "norm").mapInArrow(lambda batches: _runs(shared.value, batches), RUN_SCHEMA), "runs")

    # a partition has two runs at its borders at most
    chains: dict[int, list] = {}
    for e in runs.where("chain IS NOT NULL AND kept_here").select("chain", "part", "run", "keep_id", "in_run").orderBy("part", "run").collect():
        chains.setdefault(e["chain"], []).append(e)
    fixes = [(e["part"], e["run"], c[0]["keep_id"], sum(x["in_run"] for x in c), i == 0) for c in chains.values() if len(c) > 1 for i, e in enumerate(c)]
    whole = runs.select("doc_id", "keep_id", F.col("in_run").alias("group_size"), F.col("kept_here").alias("kept"), "text_sha256", "row", "part", "run")
    if fixes:
        fix = spark.createDataFrame(fixes, "part int, run long, chain_id long, chain_rows long, chain_first boolean")
        whole = whole.join(F.broadcast(fix), ["part", "run"], "left").select(  # at most two rows for a partition
            "doc_id", F.when(F.col("chain_rows").isNotNull(), F.col("chain_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("chain_rows", "group_size").alias("group_size"), (F.col("kept") & F.coalesce("chain_first", F.lit(True))).alias("kept"), "text_sha256", "row",
        )
    return whole.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "row")
