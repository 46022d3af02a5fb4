"""The pipeline's stages against brute force, and the driver's queries."""

import collections
import hashlib
import random
import re
import time
from pathlib import Path

import duckdb
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from stratagrid.llm import bpe, decontaminate, queries, toxicity
from stratagrid.llm.common import Scratch, shared_dir
from stratagrid.llm.simhash import _mixed, fingerprint_of, shingle_hashes

from .test_operators import edit_distance_within

SF = "/root/testdata/sf0.001"


def brute_components(n, alike):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and alike(i, j):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_stages_do_what_brute_force_does(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {i: t for i, t in rows.items() if model.score(t) < toxicity.THRESHOLD}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i] or ""), i)
    left = {i: left[i] for i in first.values()}
    ids = sorted(left)
    sets = [set(shingle_hashes(left[i], 5).tolist()) for i in ids]
    prints = [[fingerprint_of(_mixed(shingle_hashes(left[i], 3), k)) for k in range(corpus_pipeline.PRINTS)] for i in ids]
    near = lambda a, b: any((x ^ y).bit_count() <= corpus_pipeline.RADIUS for x, y in zip(prints[a], prints[b], strict=True))
    roots = brute_components(len(ids), lambda a, b: near(a, b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    left = {i: left[i] for k, i in enumerate(ids) if roots[k] == k}
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = lambda t: any(p[a : a + 20] in t and edit_distance_within(p, t) <= int(len(p) * decontaminate.ERROR_SHARE) for p in items for a in range(0, len(p) - 19, 4))
    left = {i: t for i, t in left.items() if not leaky(plain(t))}
    coder = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: coder.encode(t or "") for i, t in left.items()}


def test_appended_and_cut_copies_are_candidates():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    for edit in (lambda b: b + [word() for _ in range(61)], lambda b: b[:201]):
        found = 0
        for _ in range(100):
            base = [word() for _ in range(250)]
            a, b = (shingle_hashes(" ".join(t), 3) for t in (base, edit(base)))
            found += any((fingerprint_of(_mixed(a, k)) ^ fingerprint_of(_mixed(b, k))).bit_count() <= corpus_pipeline.RADIUS for k in range(corpus_pipeline.PRINTS))
        assert found >= 90


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            docs = stage(spark, docs, SF)
            assert k == 4 or docs.columns == columns
        found = docs.collect()
        assert all(hashlib.sha256(bytes(r.ids)).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens for r in found)


def test_oracles(spark, tmp_path):
    db = duckdb.connect()
    for name in ("documents", "pages"):
        spark.read.parquet(f"{SF}/{name}.parquet").toPandas().to_parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    made = queries.queries()
    for name, sql in queries.oracle_sql().items():
        want = db.sql(sql)
        got = made[name](spark, SF).select(*want.columns)
        assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want.fetchall()), name


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_kept_rows_are_found_without_moving_texts(spark, monkeypatch):
    docs, row = corpus_pipeline._numbered(spark, spark.range(0, 1000, 1, 7).select(F.col("id").alias("doc_id"), F.lit("x").alias("kept_word")))
    decided = docs.select(F.col(row).alias("row"), (F.col("doc_id") % 3 != 0).alias("kept"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, moved in ((1 << 20, False), (0, True)):
            monkeypatch.setattr(corpus_pipeline, "BITS_MOST", most)
            kept = corpus_pipeline._of(spark, docs, row, decided)
            assert kept.columns == ["doc_id", "kept_word"]
            assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(1000) if i % 3]
            assert ("hashpartitioning" in kept._jdf.queryExecution().executedPlan().toString()) == moved
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_dedup_stages_leave_no_texts_in_scratch(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.randbytes(8).hex() for _ in range(200)) for _ in range(150)]
    rows = [(i % 300, texts[i % 150]) for i in range(450)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs, shared = spark.read.parquet(f"{tmp_path}/docs"), Path(shared_dir(spark).removeprefix("file://"))
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        before = set(shared.iterdir())
        assert sorted(map(tuple, stage(spark, docs, SF).collect())) == sorted(rows[:150])
        left = sum(f.stat().st_size for d in set(shared.iterdir()) - before for f in d.rglob("*") if f.is_file())
        assert left < 0.05 * sum(len(t) for _, t in rows)


def test_rows_of_files_keep_their_numbers(spark, tmp_path):
    path = f"{tmp_path}/a b%20c"
    spark.range(0, 500, 1, 5).selectExpr("id % 7 AS doc_id", "CAST(id AS string) AS row_path").write.parquet(path)
    whole = spark.read.parquet(path)
    for docs, rows, stored in ((whole, 500, True), (spark.read.parquet(path, path), 1000, False), (whole.where("doc_id > 2"), 284, False), (whole.union(whole), 1000, False)):
        found, row = corpus_pipeline._numbered(spark, docs)
        assert corpus_pipeline._stored(docs) == stored and found.columns == ["doc_id", "row_path", row]
        first = sorted(map(tuple, found.collect()))
        assert len({r[-1] for r in first}) == len(first) == rows and first == sorted(map(tuple, found.repartition(3).collect()))


def test_shuffle_files_go_with_their_write(spark):
    files = lambda: {f for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    counted = Scratch(spark, "cleaning").table(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and sorted(map(tuple, counted.collect())) == [(k, 100) for k in range(10)]
