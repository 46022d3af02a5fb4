"""Token-id output: documents encoded by a tokenizer, written as compact binary files in id order, read back.

A file holds a header, a table of its documents (id, number of ids), and blocks of the range coder with a
checksum each. Files follow one another in ascending document id: splitters from the ids deal the rows to
partitions, each partition sorts and writes its files. Files are of bounded size, are written under a temporary
name and renamed, and a task that runs again writes the same ones.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import codec
from .common import Scratch, make_dir, shared_dir, slices

MAGIC = b"STOK1\n"
#: Ids of one file at which it is closed, and partitions' least number of rows worth a splitter.
FILE_IDS = 6_000_000
#: Words and pieces that a worker remembers, and the longest of them.
MEMO, MEMO_CHARS = 500_000, 64
#: Texts of these characters alone are composed (NFC), and Python's lower case and white space are the tokenizer's.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-įı-ſ‐-‧€]*")


class WordCoder:
    """Ids of texts as the tokenizer file gives them, with a memo of words where words are independent.

    The file's rules: normalise (NFC, white space, lower case), split by its pattern, merge within each piece.
    So a piece has the same ids in any text; pieces not met before go through the library. Texts with characters
    for which Python's rules might differ from the library's go through it whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path) as file:
            rules = json.load(file)
        steps = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        split = next((x for x in (rules.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"), None)
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and split is not None and split["behavior"] == "Removed" and split["invert"] and rules.get("post_processor") is None
        self.words = regex.compile(split["pattern"]["Regex"]).findall if self.by_word else None
        self.memo: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        for p, e in zip(pieces, self.tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True):
            ids = e.ids
            self.pieces[p] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.by_word and _PLAIN.fullmatch(t)]
        rest = sorted(set(range(len(texts))) - set(plain))
        for i, e in zip(rest, self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        # white space never lies within a piece, so that what it separates can be looked up as a whole
        found = [texts[i].lower().split() for i in plain]
        if len(self.memo) > MEMO:
            self.memo.clear()
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        memo, long = self.memo, {}
        fresh = list(set().union(*found).difference(memo))
        for a in range(0, len(fresh), 20_000):
            part = fresh[a : a + 20_000]
            split = [self.words(w) for w in part]
            self._learn(list(set().union(*split).difference(self.pieces)))
            piece = self.pieces.__getitem__
            for w, s in zip(part, split, strict=True):
                (memo if len(w) <= MEMO_CHARS else long)[w] = b"".join(map(piece, s))
            for w in {w for s in split for w in s if len(w) > MEMO_CHARS}:
                del self.pieces[w]
        get = memo.__getitem__ if not long else lambda w: memo[w] if w in memo else long[w]
        for i, words in zip(plain, found, strict=True):
            out[i] = b"".join(map(get, words))
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordCoder:
    return WordCoder(path)


def pack_file(docs: list[tuple[int | None, np.ndarray]], planes: int) -> bytes:
    """The file of documents in order."""
    ids = np.concatenate([d[1] for d in docs]) if docs else np.zeros(0, np.uint32)
    blocks = [ids[a : a + codec.BLOCK] for a in range(0, len(ids), codec.BLOCK)]
    coded = codec.encode_blocks(blocks, planes)
    table = np.array([(0 if d is None else d, d is None, len(x)) for d, x in docs], np.dtype([("id", "<i8"), ("null", "<u1"), ("n", "<u4")])).tobytes()
    head = MAGIC + struct.pack("<BIII", planes, len(docs), len(blocks), zlib.crc32(table)) + table
    return head + b"".join(struct.pack("<III", len(b), len(c), codec.checksum(c)) + c for b, c in zip(blocks, coded, strict=True))


def unpack_file(data: bytes) -> list[tuple[int | None, np.ndarray]]:
    """Documents of a file, in order. ValueError if a checksum differs or the file breaks off."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    planes, docs, count, crc = struct.unpack_from("<BIII", data, len(MAGIC))
    kind, at = np.dtype([("id", "<i8"), ("null", "<u1"), ("n", "<u4")]), len(MAGIC) + 13
    table = data[at : at + docs * kind.itemsize]
    if len(table) != docs * kind.itemsize or zlib.crc32(table) != crc:
        raise ValueError("the table of documents is damaged")
    at += len(table)
    sizes, coded = [], []
    for k in range(count):
        n, length, crc = struct.unpack_from("<III", data, at)
        coded.append(data[at + 12 : at + 12 + length])
        if len(coded[-1]) != length or codec.checksum(coded[-1]) != crc:
            raise ValueError(f"block {k} is damaged")
        sizes.append(n)
        at += 12 + length
    ids = np.concatenate([np.zeros(0, np.uint32), *codec.decode_blocks(coded, sizes, planes)]) if count else np.zeros(0, np.uint32)
    rows = np.frombuffer(table, kind)
    if int(rows["n"].sum()) != len(ids):
        raise ValueError("the blocks don't hold the documents' ids")
    return [(None if r["null"] else int(r["id"]), x) for r, x in zip(rows, np.split(ids, np.cumsum(rows["n"])[:-1].astype(np.int64)), strict=True)] if docs else []


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, planes: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns (file, docs, ids, start), start being the ids of all files before.

    Each document's ids end in end_id. A null text counts as empty. Null ids come first; rows that repeat an id
    lie together. An empty table gives an empty folder.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "tokens")
    make_dir(spark, path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [(k + 1) / parts for k in range(parts - 1)], 10_000) if parts > 1 else F.array().cast("array<long>")).first()[0] or []
    cuts = sorted(set(cuts))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = load(tokenizer), struct.pack("<I", end_id)
        small = np.dtype("<u2") if planes <= 2 else np.dtype("<u4")
        edges = np.array(cuts, np.int64)
        for batch in slices(batches, "text", 4 << 20):
            ids = [np.frombuffer(x + end, "<u4").astype(small).tobytes() for x in coder.encode([t or "" for t in batch.column("text").to_pylist()])]
            part = [0 if d is None else int(p) for d, p in zip(batch.column("doc_id").to_pylist(), np.searchsorted(edges, batch.column("doc_id").fill_null(0).to_numpy(), side="left"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column("doc_id"), pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        target, folder = fs.FileSystem.from_uri(path)
        small = "<u2" if planes <= 2 else "<u4"
        part, held, n, k, done = pyspark.TaskContext.get().partitionId(), [], 0, 0, []

        def close() -> None:
            nonlocal held, n, k
            name, attempt = f"ids-{part:06d}-{k:04d}.tok", f"{folder}/.{part}-{k}-{pyspark.TaskContext.get().taskAttemptId()}"
            with target.open_output_stream(attempt) as out:
                out.write(pack_file(held, planes))
            target.move(attempt, f"{folder}/{name}")
            done.append((name, part, k, len(held), n))
            held, n, k = [], 0, k + 1

        for batch in slices(batches, "ids"):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                held.append((doc, np.frombuffer(ids, small).astype(np.uint32)))
                n += len(held[-1][1])
                if n >= FILE_IDS:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)] if done else [pa.array([], t) for t in (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())], names=["file", "part", "k", "docs", "ids"])

    coded = rows.mapInArrow(encode, "part int, doc_id long, ids binary")
    dealt = coded.repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id").select("doc_id", "ids")
    files = scratch.table(dealt.mapInArrow(write, "file string, part int, k int, docs long, ids long"), "files")
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for a file
    return files.select("file", "docs", "ids", before.alias("start"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(file, doc_id, offset, n_tokens, ids_crc32[, ids]) of each document; offset counts within its file."""
    shared_dir(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                docs = unpack_file(content.as_py())
                n = np.array([len(x) for _, x in docs], np.int64)
                raw = [x.astype("<u4").tobytes() for _, x in docs]
                columns = {"file": pa.array([name] * len(docs), pa.string()), "doc_id": pa.array([d for d, _ in docs], pa.int64()), "offset": pa.array(np.cumsum(n) - n), "n_tokens": pa.array(n), "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64())}
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(raw, pa.binary())} if with_ids else {}))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")
    return files.mapInArrow(read, "file string, doc_id long, offset long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
