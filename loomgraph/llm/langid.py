"""Language identification, word first with back-off.

A known word scores by its log frequency in each language. An unseen word falls
back to its character n-grams: the longest order of which any is known decides,
progressively shorter ones are tried after it. A text's score is the sum over its
words; the answer is the language with the highest posterior.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _exchange as X
from ._bytes import Texts, mix, powers

ORDERS = (5, 4, 3, 2, 1)
WORD = 0
#: Letters beyond this code point do not exist yet.
_TOP = 0x33480
U64 = np.uint64


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter, and its lower case where that is one code point."""
    letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for c in range(_TOP):
        x = chr(c)
        if x.isalpha():
            letter[c] = True
            y = x.lower()
            if len(y) == 1:
                lower[c] = ord(y)
    return letter, lower


class _Runs:
    """Words (runs of letters, lower-cased) of texts, as code points."""

    def __init__(self, texts: Texts):
        letter, lower = _letters()
        points = np.frombuffer(texts.buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], np.cumsum((texts.buf & 0xC0) != 0x80)])
        offs = begins[texts.offs]
        inside = letter[points]
        self.points = lower[points]
        start, end = inside.copy(), inside.copy()
        if len(points):
            start[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            at = offs[:-1][offs[:-1] < len(points)]
            start[at] = inside[at]
            at = offs[1:][offs[1:] > 0] - 1
            end[at] = inside[at]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offs)
        total = np.zeros(len(points) + 1, U64)
        forward, self.back = powers(len(points) + 1)
        np.cumsum(mix(self.points.astype(U64), 77) * forward[: len(points)], out=total[1:])
        self.total = total

    def hash(self, a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        return mix((self.total[b] - self.total[a]) * self.back[a], 100 + salt)

    def words(self) -> np.ndarray:
        return self.hash(self.start, self.end, WORD)

    def grams(self, n: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each n-gram, index of its word) for words long enough; the ends of a word count."""
        size = end - start - n + 1
        at = np.flatnonzero(size > 0)
        word = np.repeat(at, size[at])
        a = start[word] + np.arange(len(word)) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
        edge = (a == start[word]).astype(np.int64) + 2 * (a + n == end[word])
        return self.hash(a, a + n, n) + edge.astype(U64) * U64(0x9E3779B97F4A7C15), word


@dataclass
class LanguageModel:
    """For each table (0: words, n: n-grams) sorted hashes and the log frequency of each in each language."""

    languages: list[str]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    prior: np.ndarray

    def look(self, kind: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.tables[kind]
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros((len(h), len(self.languages)))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[at] == h, values[at]

    def word_scores(self, runs: _Runs, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores of each distinct word, which distinct word each word is)."""
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        known, scores = self.look(WORD, h[first])
        scores = np.where(known[:, None], scores, 0.0)
        start, end = runs.start[first], runs.end[first]
        left = np.flatnonzero(~known)
        for n in ORDERS:
            if not len(left):
                break
            grams, word = runs.grams(n, start[left], end[left])
            hit, values = self.look(n, grams)
            word = word[hit]
            count = np.bincount(word, minlength=len(left))
            for k in range(len(self.languages)):
                total = np.bincount(word, values[hit, k], len(left))
                scores[left, k] = np.where(count > 0, total / np.maximum(count, 1), scores[left, k])
            left = left[count == 0]
        return scores, which

    def predict(self, texts: Texts) -> tuple[list[str], np.ndarray]:
        out, sure = [], []
        for _, _, t in texts.chunks():
            runs = _Runs(t)
            count = np.diff(runs.first)
            scores = np.zeros((len(count), len(self.languages)))
            if len(runs.start) and self.languages:
                distinct, which = self.word_scores(runs, runs.words())
                doc = np.repeat(np.arange(len(count)), count)
                for k in range(len(self.languages)):
                    scores[:, k] = np.bincount(doc, distinct[which, k], len(count)) + self.prior[k]
            if not self.languages:
                out += ["und"] * len(count)
                sure.append(np.zeros(len(count)))
                continue
            best = scores.argmax(axis=1)
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p = p[np.arange(len(best)), best] / p.sum(axis=1)
            out += [self.languages[b] if c else "und" for b, c in zip(best.tolist(), count.tolist(), strict=True)]
            sure.append(np.where(count > 0, p, 0.0))
        return out, np.concatenate(sure) if sure else np.zeros(0)


def fit_languages(docs: DataFrame, lang: str = "lang", sample: int = 8000, most: int = 150_000, least: int = 2) -> LanguageModel:
    """A model from at most `sample` labelled docs of each language, those with the least hash of the text; equal texts of a
    language count once.

    Words and n-grams that come at least `least` times are kept, of each order the `most` with the largest share of any one
    language. A language's prior is its share of words, its sample scaled to all its texts. Null languages and null texts
    teach nothing.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col("text").alias("text"), F.xxhash64("text").alias("h"))
    texts = rows.groupBy("lang", "h").count().drop("count")
    # the least hashes of a language lie below this with certainty for practical purposes, so a window sees few more than it keeps
    near = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.lit(sample + 8 * sample**0.5 + 64) / F.col("texts")
    low = texts.join(F.broadcast(texts.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))), "lang").where(F.col("h") <= near)
    low = low.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample)
    cuts = X.settle(low.groupBy("lang").agg(F.max("h").alias("cut"), F.count(F.lit(1)).alias("chosen"), F.first("texts").alias("texts")))
    scale = {r.lang: r.texts / r.chosen for r in cuts.collect()}
    chosen = rows.join(F.broadcast(cuts.select("lang", "cut")), "lang").where("h <= cut").dropDuplicates(["h", "lang"]).select("lang", "text")

    def count(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            names, kinds, hashes, counts = [], [], [], []
            for lang_ in sorted(set(langs)):
                texts = Texts.of(batch.column(1).filter(pa.array([x == lang_ for x in langs])))
                for _, _, t in texts.chunks():
                    runs = _Runs(t)
                    for kind, h in [(WORD, runs.words()), *((n, runs.grams(n, runs.start, runs.end)[0]) for n in ORDERS)]:
                        u, c = np.unique(h, return_counts=True)
                        names.append(np.repeat(lang_, len(u)))
                        kinds.append(np.full(len(u), kind, np.int32))
                        hashes.append(u.view(np.int64))
                        counts.append(c)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).tolist(), pa.string()), pa.array(np.concatenate(kinds)), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(counts))], names=["lang", "kind", "h", "n"])

    counted = chosen.mapInArrow(X.tidy(count), "lang string, kind int, h long, n long").groupBy("kind", "h", "lang").agg(F.sum("n").alias("n"))
    counted = X.settle(counted)
    sums = {(r.kind, r.lang): r.n for r in counted.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({lang_ for _, lang_ in sums})
    tables = {}
    pivot = counted.groupBy("kind", "h").agg(F.sum("n").alias("total"), *(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{k}") for k, x in enumerate(languages)))
    for kind in (WORD, *ORDERS):
        share = languages and F.array_max(F.array(*(F.col(f"n{k}") / F.lit(float(sums.get((kind, x), 0) or 1)) for k, x in enumerate(languages))))
        top = pivot.where((F.col("kind") == kind) & (F.col("total") >= least)).orderBy(F.desc(share), "h").limit(most).drop("kind", "total").toPandas() if languages else None
        if top is None or not len(top):
            tables[kind] = np.zeros(0, U64), np.zeros((0, len(languages)), np.float32)
            continue
        h = top["h"].to_numpy().view(U64)
        order = np.argsort(h)
        n = np.stack([top[f"n{k}"].to_numpy(float) for k in range(len(languages))], axis=1)
        volume = np.array([sums.get((kind, x), 0) for x in languages], float)
        tables[kind] = h[order], np.log((n + 0.5) / (volume + 0.5 * len(h)))[order].astype(np.float32)
    volume = np.array([sums.get((WORD, x), 0) * scale[x] for x in languages], float)
    return LanguageModel(languages, tables, np.log((volume + 1) / (volume.sum() + len(languages))))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred (a learned language, or `und` for null texts, texts without a letter and a model that learned none)
    and score (the posterior; 0 with `und`), a row for each input row. Other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            lang, score = held.value.predict(Texts.of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(X.tidy(run), "doc_id long, lang_pred string, score double")
