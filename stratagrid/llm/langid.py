"""Language identification of mixed texts by Viterbi decoding over words.

Each word's letters name a script, and a script has the few languages that training texts wrote in it. Within
these, character n-grams (naive Bayes) score the word for each language. Viterbi finds the sequence of
languages with the highest sum of scores, where each change of language costs a penalty; words of one language
in a row are a span. A text's language is the one whose spans hold the most letters.

Many texts decode in step as numpy lanes, the longest first, so that a step costs the same for one or a
thousand. Learning takes a bounded sample of documents (SAMPLE_DOCS, by a hash of the id).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import holdout, shared_dir, slices

SAMPLE_DOCS = 6000
SWITCH = 6.0
#: Size of the hashed table of character n-grams, and the orders of these.
GRAMS, ORDERS = 1 << 15, (1, 2, 3)
#: Scores of words (one for each language) that a worker remembers.
MEMO_SCORES = 4_000_000
_WORD = re.compile(r"[^\W\d_]+")
#: First and last code point of the letters of scripts, from the Unicode block chart.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F)], "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)], "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)], "tamil": [(0xB80, 0xBFF)], "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}


def words_of(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L) in lower case."""
    found = _WORD.findall((text or "").lower())
    if "".join(found).isalpha() or not found:
        return found
    # the pattern takes numerals that aren't decimal digits, such as a half or a raised two, for letters
    return [p for w in found for p in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def script_of(word: str) -> str:
    """Script of the word's first letter; `other` outside the known ranges."""
    at = ord(word[0])
    return next((name for name, ranges in SCRIPTS.items() for a, b in ranges if a <= at <= b), "other")


def grams_of(word: str) -> list[int]:
    padded = f"^{word}$".encode()
    return [zlib.crc32(padded[i : i + n]) % GRAMS for n in ORDERS for i in range(len(padded) - n + 1)]


class LangModel:
    """table[language, n-gram]: log probabilities. allowed[script]: True for the script's languages."""

    def __init__(self, langs: list[str], table: np.ndarray, allowed: dict[str, np.ndarray], switch: float = SWITCH):
        self.langs, self.table, self.allowed, self.switch = langs, table, allowed, switch
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)), np.float32)

    def _learn(self, words: list[str]) -> None:
        """Scores of words not met before, appended to the memo."""
        grams = [grams_of(w) for w in words]
        ends = np.cumsum([len(g) for g in grams])
        sums = np.add.reduceat(self.table.T[np.concatenate([np.array(g) for g in grams])], np.r_[0, ends[:-1]], axis=0)
        # a word's evidence is bounded: one odd word shouldn't outweigh a sentence
        sums = np.maximum(sums - sums.max(1, keepdims=True), -2 * self.switch)
        for i, w in enumerate(words):
            if (fits := self.allowed.get(script_of(w))) is not None and fits.any():
                sums[i, ~fits] = -4 * self.switch
        for w in words:
            self.rows[w] = len(self.rows)
        self.scores = np.concatenate([self.scores, sums.astype(np.float32)])

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """Of each text: (language, words, letters) of each span, in order."""
        if len(self.rows) * len(self.langs) > MEMO_SCORES:
            self.rows, self.scores = {}, self.scores[:0]
        found = [words_of(t) for t in texts]
        if fresh := sorted({w for words in found for w in words} - self.rows.keys()):
            for at in range(0, len(fresh), 50_000):
                self._learn(fresh[at : at + 50_000])
        row = self.rows.__getitem__
        order = sorted(range(len(texts)), key=lambda i: -len(found[i]))
        lengths = np.array([len(found[i]) for i in order])
        total, k = int(lengths.sum()), len(self.langs)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not total:
            return out
        # words of step t of all texts that are so long lie together
        flat = np.concatenate([np.fromiter(map(row, found[i]), np.int64, len(found[i])) for i in order])
        letters = np.concatenate([np.fromiter(map(len, found[i]), np.int64, len(found[i])) for i in order])
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        longest = int(lengths[0])
        live = np.searchsorted(-lengths, -np.arange(longest), side="left")
        value = np.zeros((len(texts), k), np.float32)
        back = np.zeros((total, k), np.int8 if k < 128 else np.int16)
        for t in range(longest):
            n = live[t]
            at = starts[:n] + t
            now = value[:n]
            best = now.argmax(1)
            top = now[np.arange(n), best] - self.switch
            stay = now >= top[:, None]
            back[at] = np.where(stay, np.arange(k), best[:, None])
            np.maximum(now, top[:, None], out=now)
            now += self.scores[flat[at]]
            now -= now.max(1, keepdims=True)
        state = value.argmax(1)
        path = np.zeros(total, np.int64)
        for t in range(longest - 1, -1, -1):
            n = live[t]
            at = starts[:n] + t
            path[at] = state[:n]
            state[:n] = back[at, state[:n]]
        for j, i in enumerate(order):
            if n := int(lengths[j]):
                own, size = path[starts[j] : starts[j] + n], letters[starts[j] : starts[j] + n]
                cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                out[i] = list(zip(own[cuts].tolist(), np.diff(np.r_[cuts, n]).tolist(), np.add.reduceat(size, cuts).tolist(), strict=True))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list]]:
        """Language, its share of the letters (0 to 1), spans; `und` and 0 without a letter."""
        out = []
        for spans in self.spans(texts):
            held = np.zeros(len(self.langs))
            for lang, _, n in spans:
                held[lang] += n
            best = int(held.argmax()) if spans else -1
            out.append((self.langs[best], float(held[best] / held.sum()), spans) if spans else ("und", 0.0, spans))
        return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, switch: float = SWITCH) -> LangModel | None:
    """Learns from texts and non-null languages of documents outside the holdout; None if there are none."""
    shared_dir(docs.sparkSession)
    total = docs.count()
    share = min(1.0, sample_docs / max(1, total) * 4 / 3)
    rows = docs.where(~holdout()).where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 40)) < int(share * (1 << 40)))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        letters: dict[tuple[str, str], int] = {}
        for batch in slices(batches, "text"):
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
            for lang, found in words.items():  # each different word once, by its number
                grams = [grams_of(word) for word in found]
                weights = np.repeat(np.fromiter(found.values(), np.int64, len(found)), [len(g) for g in grams])
                counted = np.bincount(np.concatenate([np.zeros(0, np.int64), *map(np.array, grams)]).astype(np.int64), weights, GRAMS)
                tables[lang] = tables.get(lang, 0) + counted.astype(np.int64)
                for word, n in found.items():
                    key = (lang, script_of(word))
                    letters[key] = letters.get(key, 0) + n * len(word)
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "kind": pa.array(at.astype("str")), "n": pa.array(table[at], pa.int64())})
        for (lang, script), n in letters.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "kind": pa.array([script]), "n": pa.array([n], pa.int64())})

    sums = rows.mapInArrow(count, "lang string, kind string, n long").groupBy("lang", "kind").agg(F.sum("n").alias("n")).toPandas()  # languages x GRAMS rows at most
    langs = sorted(set(sums["lang"]))
    if not langs:
        return None
    table, shares = np.full((len(langs), GRAMS), 0.5), {}
    for lang, kind, n in sums.itertuples(index=False):
        if kind.isdigit():
            table[langs.index(lang), int(kind)] += n
        else:
            shares.setdefault(kind, np.zeros(len(langs)))[langs.index(lang)] = n
    per_lang = sum(shares.values())
    allowed = {script: n / np.maximum(per_lang, 1) >= 0.01 for script, n in shares.items()}
    return LangModel(langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32), allowed, switch)


def predicted(docs: DataFrame, model: LangModel | None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, n_spans. Whole texts; nothing is shuffled.

    Null and empty texts, and those without a letter, are `und` with score 0, as are all texts without a model. A null
    id is held out or not as an empty text would be; rows that repeat get equal predictions. An empty table gives no
    rows; further columns aren't read.
    """
    shared_dir(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.langs, model.table, model.allowed, model.switch))  # languages x GRAMS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LangModel(*shared.value) if shared.value else None
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            got = own.predict(texts) if own else [("und", 0.0, [])] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([len(g[2]) for g in got], pa.int64())],
                names=["doc_id", "held_out", "lang_pred", "score", "n_spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), holdout().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_spans long")
