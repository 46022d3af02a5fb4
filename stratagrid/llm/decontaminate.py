"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may appear with up to k = m * ERROR_SHARE edits. Split into k + 1 pieces, at least one
piece must then appear unchanged; an Aho-Corasick automaton over all pieces finds these in one pass over each
document, and Myers' bit-parallel algorithm measures the item's edit distance within the stretch of text that a
hit points to. Hits of an item that point to overlapping stretches are verified together.

Items shorter than SHORT_CHARS count where they occur unchanged as whole words.

Items lie in blocks of a bounded size in the shared folder. A task holds a slice of documents and takes one block
after the other, each with an automaton of its own, so that its memory doesn't grow with the benchmark.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import Scratch, fresh, slices

ERROR_SHARE = 0.08
#: Items with fewer characters after normalising must occur unchanged, as whole words: with an edit they would hit ordinary text.
SHORT_CHARS = 24
#: Characters of the items of one block, on average; bytes of documents that meet one block after the other.
BLOCK_CHARS, SLICE_BYTES = 4_000_000, 32 << 20


def plain(text: Column) -> Column:
    """Lower case; whatever isn't a letter or digit separates words, which one space joins. Null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their offsets."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(least edit distance of the pattern to any stretch of text, that stretch's end), None if over most."""
    m = len(pattern)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    ones, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = ones, 0, m, None
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (~(xh | up) & ones), up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & ones, (mh << 1) & ones  # a stretch may begin anywhere: no 1 comes in
        up, down = mh | (~(xv | ph) & ones), ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[tuple[int | None, str]], share: float):
        import ahocorasick

        self.items = [(i, t) for i, t in items if t]
        self.budgets = [int(len(t) * share) for _, t in self.items]
        self.automaton = ahocorasick.Automaton()
        hits: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(self.items):
            for offset, piece in pieces(t, self.budgets[i]) if len(t) >= SHORT_CHARS else [(-1, f" {t} ")]:
                hits.setdefault(piece, []).append((i, offset))
        for piece, found in hits.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int]]:
        """(item id, distance, end) of each item that occurs: its best occurrence."""
        spans: dict[int, list[list[int]]] = {}
        out = []
        for end, (n, found) in self.automaton.iter(f" {text} ") if self.items else ():
            for i, offset in found:
                start, k = end - n - offset, self.budgets[i]  # in the text, which begins after a space
                if offset < 0:
                    spans.setdefault(i, [[start - 1, end - 1]])
                    continue
                a, b = max(0, start - k), min(len(text), start + len(self.items[i][1]) + k)
                own = spans.setdefault(i, [])
                if own and a <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], a), max(own[-1][1], b)
                else:
                    own.append([a, b])
        for i, own in sorted(spans.items()):
            item, pattern = self.items[i]
            if len(pattern) < SHORT_CHARS:
                out.append((item, 0, own[0][1]))
                continue
            got = [(d, a + e) for a, b in own if (r := myers(pattern, text[a:b], self.budgets[i])) for d, e in [r]]
            if got:
                out.append((item, *min(got)))
        return out


def blocks_of(benchmark: DataFrame, scratch: Scratch, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> tuple[str, int]:
    """Writes the normalised items, dealt by a hash, and returns their folder and the number of blocks."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), plain(F.col(text_col)).alias("plain")).where(F.length("plain") > 0)
    chars = rows.agg(F.coalesce(F.sum(F.length("plain")), F.lit(0))).first()[0]
    count = -(-chars // block_chars)
    if count:
        block = F.pmod(F.xxhash64("item_id", "plain"), F.lit(count)).cast("int")
        rows.withColumn("block", block).repartition(count, "block").sortWithinPartitions("block", "item_id", "plain").write.partitionBy("block").parquet(scratch.path("items"))
    return scratch.path("items"), count


@functools.lru_cache(maxsize=1)
def matcher_of(path: str, block: int, share: float) -> Matcher:
    store, folder = fs.FileSystem.from_uri(f"{path}/block={block}")
    if store.get_file_info(folder).type == fs.FileType.NotFound:  # no item's hash is the block's
        return Matcher([], share)
    files = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")]
    found = [pq.read_table(f, columns=["item_id", "plain"], filesystem=store, partitioning=None) for f in sorted(files)]
    return Matcher([x for t in found for x in zip(t.column("item_id").to_pylist(), t.column("plain").to_pylist(), strict=True)], share)


def matched(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE, text_col: str = "text", name: str = "leaks", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with a column of that name, which docs mustn't have yet: (item_id, distance, end) for each item that a text holds.

    Null and empty texts hold none, an empty benchmark leaves all arrays empty, items without a letter or digit
    match nothing; repeated items each count. Distances are in characters of the normalised texts, and ends count
    from the normalised document's start. Rows keep their columns and place: nothing is shuffled.
    """
    path, count = blocks_of(benchmark, Scratch(docs.sparkSession, "benchmark"), block_chars=block_chars)
    leak = StructType([StructField("item_id", LongType()), StructField("distance", LongType()), StructField("end", LongType())])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64()), ("end", pa.int64())]))
    n, work = len(docs.columns), fresh(docs.withColumn(name, F.lit(0)), "plain_text")
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(leak))])

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, size = [], 0
        for batch in slices(batches, n):
            held.append(batch)
            size += batch.nbytes
            if size >= SLICE_BYTES or count < 2:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sized(batches):
            leaks: list[list[list[dict]]] = [[[] for _ in range(b.num_rows)] for b in held]
            for block in range(count):
                matcher = matcher_of(path, block, share)
                for batch, own in zip(held, leaks, strict=True):
                    for found, text in zip(own, batch.column(n).to_pylist(), strict=True):
                        found += [{"item_id": i, "distance": d, "end": e} for i, d, e in matcher.find(text)]
            for batch, own in zip(held, leaks, strict=True):
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(own, kind)], names=schema.names)

    return docs.withColumn(work, plain(F.col(text_col))).mapInArrow(run, schema)
