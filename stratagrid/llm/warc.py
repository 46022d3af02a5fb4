"""WARC archives: writing pages as records, and reading them back with segments reassembled.

A page's HTTP response (status line, headers, chunked body) is a record, or a revisit that only names the
record with the same payload. Blocks over SEGMENT_BYTES go out as a first segment and continuation records,
which name their origin and their number; the last one has the total length. Reading takes the records of any
archives in any order: continuation records are grouped by the origin's id, ordered by number, checked for gaps
and against the total length, and the joined block is freed of its chunked framing.

Archives are files of gzip members, one for each record, of bounded size before compression, in a folder that driver and executors share. They are written under a
temporary name and renamed, so that a task that runs again leaves the same file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, make_dir, shared_dir, slices

SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 16_384, 4_096, 16 << 20
#: Leading part of the archives' names.
WHOLE, SEGMENTS = "pages", "segments"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PART_SCHEMA = "origin string, number int, total long, kind string, page_id long, url string, digest string, refers_to long, block binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    parts = [payload[a : a + CHUNK_BYTES] for a in range(0, len(payload), CHUNK_BYTES)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Body of chunked transfer framing; extensions and trailers are skipped. ValueError if it breaks off."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        if len(body) < end + 4 + n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("chunk breaks off")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(number: int, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, response_at: str | None) -> list[bytes]:
    """The page's record, and its continuations if it is long. number: the row's number within all archives."""
    own = f"<urn:page:{number}>"
    base = [("WARC-Date", DATE), ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", "" if page_id is None else str(page_id))]
    if response_at is not None:
        link = [("WARC-Refers-To", f"<urn:page:{response_at}>"), ("X-Refers-To-Page", "" if refers_to is None else str(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *base, *link, ("X-Payload-Length", str(len(payload)))], HTTP[: HTTP.index(b"Transfer")] + b"\r\n")]
    block = HTTP + chunked(payload)
    cuts = range(0, len(block), SEGMENT_BYTES)
    if len(cuts) == 1:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", own), *base], block)]
    out = []
    for k, a in enumerate(cuts, 1):
        kind = "response" if k == 1 else "continuation"
        segment = [("WARC-Segment-Number", str(k))] + ([("WARC-Segment-Origin-ID", own)] if k > 1 else []) + ([("WARC-Segment-Total-Length", str(len(block)))] if k == len(cuts) else [])
        out.append(record([("WARC-Type", kind), ("WARC-Record-ID", own if k == 1 else f"<urn:page:{number}:{k}>"), *base, *segment], block[a : a + SEGMENT_BYTES]))
    return out


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        n = int(headers["content-length"])
        if len(archive) < end + 4 + n:
            raise ValueError(f"record at byte {at} breaks off")
        yield headers, archive[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns (archive, kind, records) of the files.

    A task that runs again writes files under other names; those of the attempt that counts are in the result.

    Of equal payloads of least_bytes or more, the row with the smallest page_id is a response and the others
    revisit it; smaller ones are all responses. A null html is an empty payload; a null id sorts before others;
    of rows that repeat the smallest id, one is the response.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "warc-rows")
    make_dir(spark, path)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.cast("binary").alias("payload")).withColumn("number", F.monotonically_increasing_id())
    rows = scratch.table(rows.withColumn("sha", F.sha1("payload")), "rows")
    sizes = F.octet_length("payload")
    first = rows.where(sizes >= least_bytes).groupBy("sha").agg(F.min(F.struct("page_id", "number")).alias("first"), F.count("*").alias("n")).where("n > 1")
    named = rows.join(first.select(F.col("sha").alias("copy"), "first"), (F.col("sha") == F.col("copy")) & (sizes >= least_bytes), "left")
    named = named.select("page_id", "url", "payload", "sha", "number", F.col("first.page_id").alias("first_id"), F.col("first.number").alias("first_number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        part, done = pyspark.TaskContext.get().partitionId(), []
        target, folder = fs.FileSystem.from_uri(path)
        # whole records and segments go to archives of their own, so that reading shuffles only the latter
        held = {kind: [bytearray(), 0, 0, 0] for kind in (WHOLE, SEGMENTS)}  # bytes, size before compression, records, archive's number

        def close(kind: str) -> None:
            data, _, n, k = held[kind]
            name = f"{kind}-{part:06d}-{k:04d}-{pyspark.TaskContext.get().taskAttemptId()}.warc.gz"
            with target.open_output_stream(f"{folder}/.{name}", compression=None) as out:  # .gz would be detected and compressed twice
                out.write(bytes(data))
            target.move(f"{folder}/.{name}", f"{folder}/{name}")
            done.append((name, kind, n))
            held[kind] = [bytearray(), 0, 0, k + 1]

        for batch in slices(batches, "payload"):
            for row in batch.to_pylist():
                copy = row["first_number"] is not None and row["first_number"] != row["number"]
                digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                records = page_records(row["number"], row["page_id"], row["url"], row["payload"], digest, row["first_id"] if copy else None, row["first_number"] if copy else None)
                kind = SEGMENTS if len(records) > 1 else WHOLE
                for r in records:
                    own = held[kind]
                    own[0] += gzip.compress(r, 1, mtime=0)
                    own[1] += len(r)
                    own[2] += 1
                    if own[1] >= ARCHIVE_BYTES:  # the next segment may go to another archive
                        close(kind)
        for kind in (WHOLE, SEGMENTS):
            if held[kind][2]:
                close(kind)
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["archive", "kind", "records"])

    written = scratch.table(named.mapInArrow(run, "archive string, kind string, records long"), "written")
    scratch.drop("rows")
    return written


def read_archives(spark: SparkSession, path: str, whole_in: str = f"{WHOLE}-*.warc.gz", segments_in: str = f"{SEGMENTS}-*.warc.gz", with_payload: bool = True, archives: DataFrame | None = None) -> DataFrame:
    """A row for each page of the archives in the folder: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload (null for revisits)].

    archives: those to read, as write_archives returns them; without it all in the folder. An empty folder gives no rows.
    whole_in and segments_in name the archives that hold records without and with segment numbers. Both may be the
    same pattern, for archives that hold both kinds; they are then read twice.
    Fails where a segment is missing, where the total length or the payload's digest differs from the record's.
    """
    shared_dir(spark)

    def records_of(archive: bytes, segmented: bool) -> Iterator[tuple]:
        """Fields as in PART_SCHEMA."""
        for h, block in parse(gzip.GzipFile(fileobj=io.BytesIO(archive)).read()):  # streams; decompress() copies the rest for each member
            if ("warc-segment-number" in h) is not segmented:
                if whole_in == segments_in:
                    continue
                raise ValueError(f"{h['warc-record-id']}: not the kind of record that this archive's name stands for")
            total = h.get("warc-segment-total-length") if segmented else h.get("x-payload-length", str(len(block))) if h["warc-type"] == "revisit" else str(len(block))
            origin, digest = h.get("warc-segment-origin-id", h["warc-record-id"]), h["warc-payload-digest"].partition(":")[2]
            page, refers = h["x-page-id"], h.get("x-refers-to-page")
            yield origin, int(h.get("warc-segment-number", 1)), total and int(total), h["warc-type"], int(page) if page else None, h["warc-target-uri"], digest, int(refers) if refers else None, block

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("content"):
                rows = list(records_of(archive.as_py(), True))
                if rows:
                    types = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in PART_SCHEMA.split(", ")])

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        """Of (page_id, url, kind, total, digest, refers_to, numbers, blocks, origin): the pages."""
        out: list[list] = [[] for _ in range(7)]
        for page, url, kind, total, digest, refers, numbers, blocks, origin in found:
            size, payload = total, None
            if kind != "revisit":
                block = blocks[0] if len(blocks) == 1 else b"".join(blocks)
                if numbers != list(range(1, len(numbers) + 1)) or len(block) != total:
                    raise ValueError(f"{origin}: segments {numbers} hold {len(block)} of {total} bytes")
                head, _, body = block.partition(b"\r\n\r\n")
                payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                if (got := digest_of(payload)) != digest:
                    raise ValueError(f"{origin}: payload digest {got}, not {digest}")
                size = len(payload)
            for column, value in zip(out, (page, url, size, digest, kind, refers, payload), strict=True):
                column.append(value)
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        n = 7 if with_payload else 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], types[:n], strict=True)], names=names[:n])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "blocks"):
            yield rows_of([(r["page_id"], r["url"], r["kind"], r["total"], r["digest"], r["refers_to"], r["numbers"], r["blocks"], r["origin"]) for r in batch.to_pylist()])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("content"):
                found = list(records_of(archive.as_py(), False))
                for at in range(0, len(found), 500):
                    yield rows_of([(page, url, kind, total, digest, refers, [number], [block], origin) for origin, number, total, kind, page, url, digest, refers, block in found[at : at + 500]])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{folder}/{name}", compression=None) as file:
                    yield pa.RecordBatch.from_arrays([pa.array([file.read()], pa.binary())], names=["content"])

    def files(names: str) -> DataFrame:
        if archives is None:
            return spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select("content")
        own = archives.where(F.col("kind") == names.partition("-")[0]).select("archive")
        return own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(opened, "content binary")

    seen = files(segments_in).mapInArrow(parts, PART_SCHEMA)
    # an origin's segments: as many as one page has; records that are whole aren't shuffled
    joined = seen.groupBy("origin").agg(
        F.max("total").alias("total"), F.max_by("kind", -F.col("number")).alias("kind"), F.max("page_id").alias("page_id"), F.max("url").alias("url"), F.max("digest").alias("digest"), F.max("refers_to").alias("refers_to"),
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("segments"),
    ).select("origin", "total", "kind", "page_id", "url", "digest", "refers_to", F.col("segments.number").alias("numbers"), F.col("segments.block").alias("blocks"))
    return files(whole_in).mapInArrow(alone, schema).union(joined.mapInArrow(whole, schema))
