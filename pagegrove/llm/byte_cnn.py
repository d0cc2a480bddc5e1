"""Quality classifier: a byte-level convolutional network in numpy (operator 1).

The network reads the UTF-8 bytes of the whole document in overlapping chunks
(each window of ``WIDTH`` bytes lies in exactly one chunk; neighbouring chunks
share ``WIDTH - 1`` bytes).  Bytes are embedded, convolved with learned
filters, max-pooled within each chunk, and the chunk maxima are combined over
the document by their mean and maximum into one logistic probability.

Training runs on the driver over a bounded sample: at most ``FIT_ROWS``
labelled documents, taken by a hash of their id, texts above ``FIT_CHARS``
characters left out of the fit (not of scoring).  Only the sampled rows reach
the driver.  Scoring is an Arrow UDF over all rows; for speed the embedding
and the filters are multiplied out into tables over byte pairs.

Null and empty texts score like one chunk of padding; with no labelled row
every score is 0.5.  Ids that repeat count once in the fit (least text, least
label).  Other columns are never read.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrove.llm.common import crc_mod, doc_groups, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH, FILTERS, DIM, CHUNK = 6, 16, 8, 256
FIT_ROWS, FIT_CHARS = 2000, 200_000
EPOCHS, BATCH, RATE = 8, 32, 0.02
#: Bytes that one vectorised step convolves.
STEP_BYTES = 1 << 17


def _layout(data: np.ndarray, off: np.ndarray):
    """Documents padded to at least one window each; starts of their chunks; document of each chunk."""
    size = np.diff(off)
    at = np.concatenate(([0], np.cumsum(np.maximum(size, 1) + WIDTH - 1)))
    out = np.zeros(at[-1] + 1, np.uint8)
    out[np.arange(len(data)) + np.repeat(at[:-1] - off[:-1], size)] = data
    n_chunks = -(-np.maximum(size, 1) // CHUNK)
    doc = np.repeat(np.arange(len(size)), n_chunks)
    first = np.concatenate(([0], np.cumsum(n_chunks)[:-1]))
    start = at[doc] + (np.arange(len(doc)) - first[doc]) * CHUNK
    pad = (at[1:, None] - np.arange(1, WIDTH)[None, :]).ravel()  # windows that would reach into the next document
    return out, at, start, doc, n_chunks, pad


class ByteCNN:
    """Parameters: byte embedding, filters, their bias, and the output layer."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.p = {"embed": r.normal(0, 0.5, (256, DIM)), "filt": r.normal(0, 0.3, (WIDTH, DIM, FILTERS)), "bias": np.zeros(FILTERS),
                  "out": r.normal(0, 0.3, 2 * FILTERS), "base": np.zeros(1)}

    def pair_tables(self) -> list[np.ndarray]:
        """For each pair of window positions, what two bytes add to the filters."""
        t = [(self.p["embed"] @ self.p["filt"][j]).astype(np.float32) for j in range(WIDTH)]
        return [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]

    def windows(self, out: np.ndarray, pad: np.ndarray, tables) -> np.ndarray:
        pair = (out[:-1].astype(np.int32) << 8) | out[1:]
        n = len(out) - WIDTH
        act = tables[0][pair[:n]]
        for k in range(1, len(tables)):
            act += tables[k][pair[2 * k:2 * k + n]]
        act[pad[pad < n]] = -np.inf
        return act

    def combine(self, top: np.ndarray, doc: np.ndarray, n_chunks: np.ndarray):
        first = np.concatenate(([0], np.cumsum(n_chunks)[:-1]))
        a = np.maximum(top + self.p["bias"].astype(np.float32), 0)
        mean = np.add.reduceat(a, first, axis=0) / n_chunks[:, None]
        most = np.maximum.reduceat(a, first, axis=0)
        z = np.concatenate([mean, most], axis=1)
        logit = np.clip(z @ self.p["out"] + self.p["base"][0], -30, 30)
        return a, z, 1 / (1 + np.exp(-logit))

    def scores(self, data: np.ndarray, off: np.ndarray, tables) -> np.ndarray:
        out, _at, start, doc, n_chunks, pad = _layout(data, off)
        top = np.empty((len(start), FILTERS), np.float32)
        i = 0
        while i < len(start):  # a very long document takes several steps
            j = max(i + 1, int(np.searchsorted(start, start[i] + STEP_BYTES)))
            lo = start[i]
            hi = start[j] if j < len(start) else len(out) - WIDTH
            here = pad[(pad >= lo) & (pad < hi)] - lo
            act = self.windows(out[lo:hi + WIDTH], here, tables)
            top[i:j] = np.maximum.reduceat(act, start[i:j] - lo, axis=0)
            i = j
        return self.combine(top, doc, n_chunks)[2]

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> ByteCNN:
        """Adam on the log loss; the gradient flows through the window that won each chunk."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        total = epochs * -(-len(texts) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for s in range(0, len(order), BATCH):
                pick = order[s:s + BATCH]
                g = self._gradient([texts[i] for i in pick], labels[pick])
                step += 1
                rate = RATE * (1 - 0.9 * step / total)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
        return self

    def _gradient(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        out, _at, start, doc, n_chunks, pad = _layout(np.frombuffer(b"".join(texts), np.uint8), off)
        t = [(self.p["embed"] @ self.p["filt"][j]).astype(np.float32) for j in range(WIDTH)]
        n = len(out) - WIDTH
        act = t[0][out[:n]]
        for j in range(1, WIDTH):
            act += t[j][out[j:j + n]]
        act[pad[pad < n]] = -np.inf
        top = np.maximum.reduceat(act, start, axis=0)
        a, z, prob = self.combine(top, doc, n_chunks)
        chunk_of = np.zeros(n, np.int64)
        chunk_of[start[1:]] = 1
        chunk_of = np.cumsum(chunk_of)
        pos, f = np.nonzero(act == top[chunk_of])
        _, one = np.unique(chunk_of[pos] * FILTERS + f, return_index=True)  # of ties the first window
        pos, f = pos[one], f[one]
        d_logit = (prob - y) / len(texts)
        d_z = d_logit[:, None] * self.p["out"][None, :]
        best = a == z[doc, FILTERS:]
        first = np.concatenate(([0], np.cumsum(n_chunks)[:-1]))
        d_a = d_z[doc, :FILTERS] / n_chunks[doc][:, None] + best * (d_z[:, FILTERS:] / np.maximum(np.add.reduceat(best, first, axis=0, dtype=np.int64), 1))[doc]
        d_a *= a > 0
        w = d_a[chunk_of[pos], f]
        g = {"out": d_logit @ z + 1e-4 * self.p["out"], "base": np.array([d_logit.sum()]), "bias": np.bincount(f, w, FILTERS),
             "embed": np.zeros_like(self.p["embed"]), "filt": np.zeros_like(self.p["filt"])}
        for j in range(WIDTH):
            d_t = np.bincount(out[pos + j].astype(np.int64) * FILTERS + f, w, 256 * FILTERS).reshape(256, FILTERS)
            g["filt"][j] = self.p["embed"].T @ d_t
            g["embed"] += d_t @ self.p["filt"][j].T
        return g


def fit_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS):
    """At most ``fit_rows`` labelled texts whose crc32(doc_id) mod 3 is not 1, in the order of a hash."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(crc_mod("doc_id", 3) != 1)
    ids = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    ids = docs.sparkSession.createDataFrame(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect(), "doc_id long, y int")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = text.join(F.broadcast(ids), "doc_id").where(F.length("text") <= fit_chars).groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    return sorted(rows, key=lambda r: r.doc_id)


def train(docs: DataFrame, labels: DataFrame, **limits) -> ByteCNN | None:
    rows = fit_sample(docs, labels, **limits)
    if not rows:
        return None
    return ByteCNN().fit([r.text.encode() for r in rows], np.array([r.y for r in rows], float))


def scorer(model: ByteCNN | None) -> Callable[[Column], Column]:
    """A UDF text -> probability that the quality is 1."""
    def score(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = model.pair_tables() if model else None
        for arr in it:
            out = np.full(len(arr), 0.5)
            if model:
                data, off = utf8(arr)
                for i, j in doc_groups(off, STEP_BYTES):
                    out[i:j] = model.scores(data[off[i]:off[j]], off[i:j + 1] - off[i], tables)
            yield pa.array(out, pa.float64())
    return F.arrow_udf(score, "double").asNondeterministic()


def quality_scores(docs: DataFrame, labels: DataFrame, out: str = "score", **limits) -> DataFrame:
    """All rows and columns of ``docs`` with the probability in column ``out`` (an equal-named column is replaced)."""
    return docs.withColumn(out, scorer(train(docs, labels, **limits))("text"))
