"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams (operator 5).

Features are character 1- to 3-grams of the lower-cased text (every ASCII
non-letter counts as a space), hashed into ``DIM`` slots, weighted
``(1 + ln tf) * idf`` and scaled to unit length.  Document frequencies are
counted over *all* rows that may be learned from.  Weights are trained with
follow-the-regularised-leader and elastic-net penalties (the L1 part keeps
them sparse) on a bounded sample (at most ``FIT_ROWS`` rows, split evenly
over the languages, texts above ``FIT_CHARS`` characters left out of the
fit).  A fifth of the sample is kept for the temperature that calibrates the
probabilities.

A text that is null or has no letter is ``und`` with score 0.  Without rows
to learn from, every text is ``und`` with score 0.  Repeated rows count as
often as they occur; other columns are never read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagegrove.llm.common import crc_mod

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIM, ORDERS = 1 << 15, 3
FIT_ROWS, FIT_CHARS = 3000, 100_000
PART = 1 << 12
LETTER = regex.compile(r"\p{L}")
#: Characters that one vectorised step hashes.
STEP_CHARS = 1 << 19


def doc_features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the slots that occur and their counts."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= STEP_CHARS):
            size += len(texts[j])
            j += 1
        low = [f" {t.lower()} " for t in texts[i:j]]
        cp = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32).copy()
        cp[(cp < 97) | ((cp > 122) & (cp < 128))] = 32
        off = np.concatenate(([0], np.cumsum([len(t) for t in low])))
        grams, h = [], np.zeros(len(cp), np.uint32)
        for k in range(ORDERS):
            h = h[:len(cp) - k] * np.uint32(0x9E3779B1) + (cp[k:] + np.uint32(k + 1)) * np.uint32(0x85EBCA6B)
            grams.append(((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 15))
        for a, b in zip(off[:-1], off[1:], strict=True):
            counts = np.bincount(np.concatenate([g[a:max(a, b - k)] for k, g in enumerate(grams)]), minlength=DIM)
            at = np.flatnonzero(counts)
            yield at, counts[at]
        i = j


def vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(1e-12, float(np.sqrt(x @ x)))


class LangModel:
    def __init__(self, langs: list[str], idf: np.ndarray) -> None:
        self.langs, self.idf = langs, idf
        self.w = np.zeros((DIM, len(langs)))
        self.temperature = 1.0

    def fit(self, feats, y: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> LangModel:
        """FTRL-proximal, one example at a time; w follows from z and n in closed form."""
        z, n = np.zeros_like(self.w), np.zeros_like(self.w)

        def weights(zi, ni):
            return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

        order = np.random.default_rng(5)
        for _ in range(epochs):
            for i in order.permutation(len(feats)):
                at, x = feats[i]
                zi, ni = z[at], n[at]
                w = weights(zi, ni)
                p = self.softmax(x @ w)
                p[y[i]] -= 1
                g = x[:, None] * p[None, :]
                after = ni + g * g
                z[at] = zi + g - (np.sqrt(after) - np.sqrt(ni)) / alpha * w
                n[at] = after
        self.w = weights(z, n)
        return self

    @staticmethod
    def softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max())
        return e / e.sum()

    def calibrate(self, feats, y: np.ndarray) -> LangModel:
        """The temperature of least log loss on rows that the weights were not fitted to."""
        if len(feats):
            s = np.stack([x @ self.w[at] for at, x in feats])
            s -= s.max(1, keepdims=True)
            grid = np.exp(np.linspace(np.log(0.25), np.log(20), 100))
            loss = [float(np.mean(np.log(np.exp(s / t).sum(1)) - s[np.arange(len(y)), y] / t)) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def predict(self, at: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        p = self.softmax((vector(at, counts, self.idf) @ self.w[at]) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


def _frequencies(batches):
    df, rows = np.zeros(DIM, np.int64), 0
    for b in batches:
        for at, _ in doc_features(b.column("text").to_pylist()):
            df[at] += 1
            rows += 1
    parts = list(range(DIM // PART))
    yield pa.RecordBatch.from_arrays([pa.array([*parts, -1], pa.int32()),
                                      pa.array([*(df[p * PART:(p + 1) * PART].tobytes() for p in parts), np.array([rows]).tobytes()], pa.binary())], ["part", "counts"])


def _sum_parts(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for p, c in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
            total[p] = total.get(p, 0) + np.frombuffer(c, np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "counts"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """idf over all rows of ``texts(text)``; what reaches the driver has a fixed size."""
    df, rows = np.zeros(DIM, np.int64), 0
    parts = texts.select("text").mapInArrow(_frequencies, "part int, counts binary").repartition(9, "part")
    for r in parts.mapInArrow(_sum_parts, "part int, counts binary").collect():
        c = np.frombuffer(r.counts, np.int64)
        if r.part < 0:
            rows += int(c[0])
        else:
            df[r.part * PART:(r.part + 1) * PART] += c
    return np.log((1 + rows) / (1 + df)) + 1


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32(doc_id) mod 4 is not 2, text and lang not null."""
    return docs.where((crc_mod("doc_id", 4) != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull())


def fit_sample(docs: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS):
    """At most ``fit_rows`` rows, as many of each language as there are, in the order of a hash."""
    spark = docs.sparkSession
    ids = learnable(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("doc_id").alias("h"))
    # hashes, not rows, are counted: rows may share an id, and then its hash
    langs = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("h").alias("count")).orderBy(F.desc("rows"), "lang").limit(fit_rows).collect()
    each = max(1, fit_rows // max(1, len(langs)))
    # only hashes under a bound of each language, some four times its part, are put in order, so the sort does not grow with the rows
    cuts = [(r.lang, min((1 << 63) - 1, -(1 << 63) + (4 * each + 100) * (1 << 64) // max(1, r["count"]))) for r in langs]
    ids = ids.join(F.broadcast(spark.createDataFrame(cuts, "lang string, most long")), "lang").where("h <= most").drop("most")
    ids = ids.distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= each)
    ids = spark.createDataFrame(ids.orderBy("k", "h", "doc_id").limit(fit_rows).select("doc_id").distinct().collect(), "doc_id long")
    rows = learnable(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where(F.length("text") <= fit_chars)
    rows = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    return sorted((r for r in rows if LETTER.search(r.text)), key=lambda r: (r.doc_id, r.lang))


def train(docs: DataFrame, **limits) -> LangModel | None:
    rows = fit_sample(docs, **limits)
    if not rows:
        return None
    idf = inverse_frequencies(learnable(docs))
    langs = sorted({r.lang for r in rows})
    y = np.array([langs.index(r.lang) for r in rows])
    feats = [(at, vector(at, c, idf)) for at, c in doc_features([r.text for r in rows])]
    later = np.arange(len(rows)) % 5 == 4
    pick = lambda m: ([feats[i] for i in np.flatnonzero(m)], y[m])
    return LangModel(langs, idf).fit(*pick(~later)).calibrate(*pick(later))


def detect(docs: DataFrame, model: LangModel | None, text_col: str = "text", out: str = "lang_id") -> DataFrame:
    """All rows and columns of ``docs`` and a struct ``(lang, score)`` in column ``out``."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def predict(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in it:
            texts = [t if t is not None else "" for t in arr.to_pylist()]
            got = [model.predict(at, c) if model and LETTER.search(t) else ("und", 0.0) for t, (at, c) in zip(texts, doc_features(texts), strict=True)]
            yield pa.array([{"lang": a, "score": b} for a, b in got], kind)
    return docs.withColumn(out, F.arrow_udf(predict, "lang string, score double").asNondeterministic()(text_col))
