"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of parts. Each adjacent pair that the vocabulary can merge lies in the bucket of
its merge rank, and a two-level bitmap tells which buckets hold anything: find-first-set on the upper word
names a lower word, find-first-set on that one the rank. A bucket gives its leftmost position first; entries
whose pair has changed meanwhile are stale and skipped. A merge costs a constant number of bit operations, so
a pre-token of n bytes costs O(n log n) however long it is.

Ids of pre-tokens met before come from a bounded memo, as most pre-tokens of a corpus repeat.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, slices

#: Ranks of one lower word of the bitmap.
WORD = 256
#: Pre-tokens that a worker remembers, and the longest of them.
MEMO, MEMO_CHARS = 700_000, 64
CODE_SCHEMA = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"


class ByteBpe:
    """Encodes and decodes by a rank file: lines of base64 token and rank. Ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.words = ranks, regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        if ranks and min(self.byte) < 0:
            raise ValueError("the ranks lack single bytes, so that not every text can be encoded")
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    self.merged[a, b] = rank
        self.memo = Memo(self)

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token: always the pair of least rank merges, the leftmost of equals."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        merged, byte = self.merged, self.byte
        part = [byte[b] for b in word]
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        lower: dict[int, int] = {}
        upper = 0
        for i in range(n - 1):
            rank = merged.get((part[i], part[i + 1]))
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)  # ascending, so a heap
                else:
                    buckets[rank] = [i]
                    w = rank // WORD
                    lower[w] = lower.get(w, 0) | 1 << rank % WORD
                    upper |= 1 << w
        while upper:
            w = (upper & -upper).bit_length() - 1
            bits = lower[w]
            rank = w * WORD + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heapq.heappop(bucket)
            if not bucket:
                del buckets[rank]
                lower[w] = bits = bits & (bits - 1)
                if not bits:
                    upper &= upper - 1
            a = part[i]
            if a < 0 or (j := after[i]) >= n or merged.get((a, part[j])) != rank:
                continue  # stale
            part[i], part[j] = rank, -1
            k = after[i] = after[j]
            h = before[i]
            if k < n:
                before[k] = i
                fresh = merged.get((rank, part[k]))
                if fresh is not None:
                    if fresh in buckets:
                        heapq.heappush(buckets[fresh], i)
                    else:
                        buckets[fresh] = [i]
                        w = fresh // WORD
                        lower[w] = lower.get(w, 0) | 1 << fresh % WORD
                        upper |= 1 << w
            if h >= 0:
                fresh = merged.get((part[h], rank))
                if fresh is not None:
                    if fresh in buckets:
                        heapq.heappush(buckets[fresh], h)
                    else:
                        buckets[fresh] = [h]
                        w = fresh // WORD
                        lower[w] = lower.get(w, 0) | 1 << fresh % WORD
                        upper |= 1 << w
        return [p for p in part if p >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO // 2:
            self.memo.age()
        return b"".join(map(self.memo.__getitem__, self.words(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


class Memo(dict):
    """Ids of pre-tokens, worked out when first asked for; long ones aren't kept.

    What was asked for since the last age() but one is remembered, so that frequent pre-tokens stay.
    """

    def __init__(self, coder: ByteBpe):
        super().__init__()
        self.coder, self.old = coder, {}

    def age(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, word: str) -> bytes:
        if (packed := self.old.get(word)) is None:
            ids = self.coder.encode_word(word.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= MEMO_CHARS:
            self[word] = packed
        return packed


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """Once for each Python worker; the vocabulary is installed with the workers' Python."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return ByteBpe(ranks, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256, decoded_sha256.

    decoded_sha256 comes from the bytes that the ids decode to. A null text counts as empty and has no ids.
    Special tokens are ordinary text. Rows keep their place and nothing is shuffled; null or repeated ids and
    further columns don't matter.
    """
    shared_dir(docs.sparkSession)
    schema = CODE_SCHEMA if with_ids else CODE_SCHEMA.replace("ids binary, ", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for batch in slices(batches, "text", 4 << 20):
            counts, raw, sha, back = [], [], [], []
            for text in batch.column("text").to_pylist():
                data = coder.encode(text or "")
                counts.append(len(data) // 4)
                sha.append(hashlib.sha256(data).hexdigest())
                back.append(hashlib.sha256(coder.decode(data)).hexdigest())
                if with_ids:
                    raw.append(data)
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64())}
            columns |= {"ids": pa.array(raw, pa.binary())} if with_ids else {}
            columns |= {"ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
