"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed features of a text (its distinct words and their beginnings), each divided by the
root of the number of distinct words, learns from confirmed toxic texts and from unlabelled ones. With class prior p, the risk is
p R_P(+) + max(0, R_U(-) - p R_P(-)): the second term is the risk of the unlabelled texts as negatives, corrected
for the positives among them; where it falls below zero, the step goes up its slope instead of down, so that the
model doesn't fit the unlabelled positives as negatives.

Learning takes bounded samples (MOST_POSITIVE of either label, MOST_UNLABELLED documents, chosen by a hash of the
id). Executors find and count their features and choose CHOSEN of them; the driver gets each sampled document's
features among these. Scoring reads every whole text where it lies, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, holdout, shared_dir, slices

MOST_POSITIVE, MOST_UNLABELLED = 4000, 8000
#: Hashed features; those that the model weighs, of all that LEAST_DOCS sampled documents have; letters of words' beginnings.
BINS, CHOSEN, LEAST_DOCS, STARTS = 1 << 18, 512, 4, (4, 5, 6, 7)
#: Features count this much divided by the root of the number of the text's distinct words.
SCALE = 7.0
#: Words whose features a worker remembers.
MEMO = 200_000
#: A text whose score is at least this counts as toxic.
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


class Features:
    """Numbers of a text's features: its distinct words and their beginnings, hashed into BINS bins; of these, those in only."""

    def __init__(self, only: frozenset[int] | None = None):
        self.only, self.memo = only, {}

    def _of_word(self, word: str) -> tuple[int, ...]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        parts = [word, *(f"^{word[:k]}" for k in STARTS if len(word) > k)]
        found = (zlib.crc32(x.encode()) % BINS for x in parts)
        self.memo[word] = found = tuple(i for i in found if self.only is None or i in self.only)
        return found

    def of(self, text: str | None) -> tuple[set[int], int]:
        """Features, and the number of distinct words, 1 at least."""
        get, found, words = self.memo.get, set(), words_of(text)
        for word in words:
            if (own := get(word)) is None:
                own = self._of_word(word)
            if own:
                found.update(own)
        return found, max(1, len(words))


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 800, rate: float = 0.05, decay: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with logistic loss (Adam, mini-batches)."""
    rng, d = np.random.default_rng(seed), positive.shape[1]
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        p = positive[rng.integers(0, len(positive), min(256, len(positive)))]
        u = unlabelled[rng.integers(0, len(unlabelled), min(1024, len(unlabelled)))]
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        as_negative = lambda z: np.logaddexp(0, z)
        slack = as_negative(zu).mean() - prior * as_negative(zp).mean()
        gp, gu = sigmoid(zp), sigmoid(zu)
        pull = lambda x, g: np.r_[x.T @ g, g.sum()] / len(x)
        negative_part = pull(u, gu) - prior * pull(p, gp)
        g = prior * pull(p, gp - 1) + negative_part if slack >= 0 else -negative_part
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def settle(scores: np.ndarray, prior: float) -> float:
    """Shift of the log-odds after which the class prior's share of unlabelled texts reaches THRESHOLD.

    The cut lies in the widest gap between neighbouring scores around that share.
    """
    ranked, n = np.sort(scores)[::-1], len(scores)
    lo, hi = max(0, int(n * prior * 0.7) - 1), min(n - 1, int(n * prior * 1.3) + 2)
    near = ranked[lo : hi + 1]
    if len(near) < 2:
        return 0.0
    at = int(np.argmax(near[:-1] - near[1:]))
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - (near[at] + near[at + 1]) / 2)


def cut_of(positive: np.ndarray, negative: np.ndarray, weight: float = 1.0) -> float:
    """Log-odds that part labelled scores at least loss: a miss costs 1 - THRESHOLD, a false alarm THRESHOLD times weight.

    Of the cuts with the least loss, the middle of the widest gap; how many texts lie over it isn't bounded.
    """
    at = np.unique(np.concatenate([positive, negative]))
    cuts = np.r_[at[0] - 1, (at[:-1] + at[1:]) / 2, at[-1] + 1]
    gaps = np.r_[0.0, at[1:] - at[:-1], 0.0]
    missed = np.searchsorted(np.sort(positive), cuts)
    alarms = len(negative) - np.searchsorted(np.sort(negative), cuts)
    loss = (1 - THRESHOLD) * missed + THRESHOLD * weight * alarms
    best = np.flatnonzero(loss <= loss.min() + 1e-9)
    return float(cuts[best[np.argmax(gaps[best])]])


class ToxicModel:
    """Log-odds weights of features; score() is the probability of label 1."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.features = weights, bias, Features(frozenset(weights))

    def score(self, text: str | None) -> float:
        found, words = self.features.of(text)
        z = self.bias + sum(self.weights[i] for i in sorted(found)) * SCALE / words**0.5
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _found(docs: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(kind, doc_id, words, features) of the documents whose ids keys (doc_id, kind) has, a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches, "text"):
            found = [features.of(t) for t in batch.column("text").to_pylist()]
            columns = pa.array([n for _, n in found], pa.int32()), pa.array([sorted(f) for f, _ in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("doc_id"), *columns], names=["kind", "doc_id", "words", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(keys), "doc_id").select("kind", "doc_id", "text")
    return scratch.table(rows.mapInArrow(run, "kind string, doc_id long, words int, features array<int>"), "sample")


def _chosen(found: DataFrame, toxic: int, any_: int) -> np.ndarray:
    """Features that tell the toxic documents from any, by the two-proportion z statistic; ties by their numbers."""
    k, c = F.col("k") / toxic, F.col("c") / any_
    counts = found.where("kind <> 'clean'").select("kind", F.explode("features").alias("i")).groupBy("i").agg(F.count_if(F.col("kind") == "toxic").alias("k"), F.count_if(F.col("kind") == "any").alias("c"))
    pooled = (F.col("k") + F.col("c")) / (toxic + any_)
    z = F.abs(k - c) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / toxic + 1 / any_))
    rows = counts.where((F.col("k") > 0) & (F.col("k") + F.col("c") >= LEAST_DOCS)).select("i", z.alias("z")).orderBy(F.desc("z"), "i").limit(CHOSEN).collect()
    return np.array([r["i"] for r in rows], np.int64)


def _matrices(found: DataFrame, chosen: np.ndarray) -> dict[str, np.ndarray]:
    """By kind: a row for each sampled document, in order of the ids, a column for each chosen feature."""
    own = F.array_intersect("features", F.array(*(F.lit(int(i)).cast("int") for i in chosen)))
    rows = found.select("kind", "doc_id", "words", own.alias("own")).orderBy("kind", "doc_id", "words", "own").toArrow()  # the samples' bounds times CHOSEN
    column = {int(i): k for k, i in enumerate(chosen)}
    kinds, words, lists, out = rows.column("kind").to_pylist(), rows.column("words").to_pylist(), rows.column("own").to_pylist(), {}
    for kind in sorted(set(kinds)):
        at = [k for k, x in enumerate(kinds) if x == kind]
        out[kind] = x = np.zeros((len(at), len(chosen)), np.float32)
        for i, k in enumerate(at):
            x[i, [column[f] for f in lists[k]]] = SCALE / words[k] ** 0.5
    return out


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> ToxicModel:
    """Learns from documents outside the holdout. Without a toxic example every text scores 0.

    Labels with a null id or a null label don't count, repeated ones count once for each label; documents that
    repeat an id each count. An empty table of documents or labels gives the model without an example.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    usable = labels.where(~holdout()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    n, positives = usable.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0))).first()
    if not positives:
        return ToxicModel({}, -30.0)
    prior = min(0.9, positives / n)
    # a hash below a share of its range is a sample of bounded expected size, whatever the input
    below = lambda share, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40))
    total = docs.count()
    toxic = usable.where("toxic = 1").where(below(most_positive / positives, 1)).select("doc_id", F.lit("toxic").alias("kind"))
    clean = usable.where("toxic = 0").where(below(most_positive / max(1, n - positives), 3)).select("doc_id", F.lit("clean").alias("kind"))
    any_ = docs.where(~holdout()).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("any").alias("kind")).where(below(most_unlabelled / max(1, total) * 4 / 3, 2))
    found = _found(docs, toxic.union(clean).union(any_).distinct(), scratch)
    counts = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    if "toxic" not in counts or "any" not in counts:
        return ToxicModel({}, -30.0)
    chosen = _chosen(found, counts["toxic"], counts["any"])
    if not len(chosen):
        return ToxicModel({}, float(np.log(prior / (1 - prior))))
    samples = _matrices(found, chosen)
    weights, bias = nnpu(samples["toxic"], samples["any"], prior)
    if "clean" in samples:  # without a labelled negative the bias of the risk stays
        share = min(1.0, most_positive / max(1, n - positives)) / min(1.0, most_positive / positives)
        bias += float(np.log(THRESHOLD / (1 - THRESHOLD))) - cut_of(samples["toxic"] @ weights + bias, samples["clean"] @ weights + bias, 1 / share)
    return ToxicModel({int(i): float(w) for i, w in zip(chosen, weights, strict=True) if abs(w) > 1e-3}, bias)


def scored(docs: DataFrame, model: ToxicModel, name: str = "toxic_score") -> DataFrame:
    """docs with a column of that name, which docs mustn't have yet: the probability that labels.toxic would be 1.

    Null and empty texts have the score of a text without words; rows that repeat get equal scores. An empty table
    stays empty. Rows keep their columns and place.
    """
    shared_dir(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # CHOSEN entries at most
    columns, text_at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicModel(*shared.value)
        for batch in slices(batches, text_at):
            score = pa.array([own.score(t) for t in batch.column(text_at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*columns, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
