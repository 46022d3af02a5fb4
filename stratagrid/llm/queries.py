"""Queries of the training-data operators for the driver's contract, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact, langid, shard, simhash, suffix, tokens, toxicity, warc
from .common import Scratch, holdout, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign_shards(table(spark, sf_dir, "documents"), shards=16, vnodes=64)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), words=3, radius=3)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", holdout().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).drop("row")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Scratch(spark, "ids").path("files")
    files = tokens.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    docs = tokens.read_tokens(spark, path).join(files.select("file", "start"), "file")
    return docs.select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents"), least=400)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predicted(docs, langid.train(docs))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archives")
    written = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path, least_bytes=0)
    return warc.read_archives(spark, path, with_payload=False, archives=written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance) of each benchmark item that a document holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matched(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") > 0)
    return found.select("doc_id", F.inline("leaks")).select("doc_id", "item_id", "distance")


#: base32 takes five hexadecimal digits to four of its own.
OP9_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
     d AS (SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY h) AS least, row_number() OVER (PARTITION BY h ORDER BY page_id) AS k,
                  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN least END AS refers_to FROM d
"""

OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
     r AS (SELECT doc_id, sha256(norm) AS text_sha256, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
                  count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS k FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, text_sha256 FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_sharding": op1_sharding, "op2_byte_bpe": op2_byte_bpe, "op3_simhash": op3_simhash, "op4_toxicity": op4_toxicity, "op5_exact_dedup": op5_exact_dedup, "op6_token_ids": op6_token_ids, "op7_suffix_dedup": op7_suffix_dedup, "op8_language_id": op8_language_id, "op9_warc": op9_warc, "op10_decontamination": op10_decontamination}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op9_warc": OP9_SQL}
