"""Helpers shared by the training-data operators.

* ``stage``: a DataFrame written to the shared folder and read back.  It cuts
  the lineage with a table that survives lost executors, and it fixes rows
  that a recomputed task could otherwise give in another order.
* ``key_marks`` / ``where_marked``: a bitmap of keys, of fixed size, that tells
  rows which a join on the key cannot touch, so that they need not move for it.
* ``shared_dir`` / ``open_store``: the folder named by ``spark.checkpoint.dir``
  and a file system handle on it that also works inside tasks.
* ``utf8`` / ``doc_groups`` / ``Words``: Arrow text columns as byte arrays,
  split into groups of bounded size, and the words of those bytes with 64-bit
  hashes, all without a Python loop over characters.
"""

from __future__ import annotations

import re
import sys
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrove.session import checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = (9, 10, 11, 12, 13, 32)
#: Bytes of text that one vectorised step handles (a longer text is one step).
GROUP_BYTES = 2 << 20
#: Bits of a bitmap of keys.
MARK_BITS = 24


# ---- shared folder -------------------------------------------------------

def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode without one, a fresh folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + checkpoint_dir(spark)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, read back with its schema."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _mark(key) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << MARK_BITS))


def key_marks(keys: DataFrame) -> DataFrame:
    """``(part, words)``: a bitmap with a bit set for each value of the only column of ``keys``.

    Its size is fixed, 2 MB in 4,096 rows of 64 words at most, however many keys there are.
    """
    at = keys.select(_mark(keys.columns[0]).alias("at"))
    words = at.groupBy(F.shiftright("at", 12).alias("part"), F.shiftright("at", 6).bitwiseAND(63).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits"))
    rows = words.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("of"))
    return rows.select("part", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda w: F.coalesce(F.try_element_at("of", w), F.lit(0).cast("long"))).alias("words"))


def where_marked(df: DataFrame, key: str, marks: DataFrame, marked: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``key`` has its bit in ``marks``, or has not; nothing is shuffled.

    A row without its bit certainly has none of the keys; one with it may have
    none of them either, so a join on the key must follow.
    """
    at = _mark(df[key])
    both = df.join(F.broadcast(marks), F.shiftright(at, 12) == marks["part"], "left")
    word = F.get(marks["words"], F.shiftright(at, 6).bitwiseAND(63).cast("int"))
    held = F.coalesce(F.getbit(word, at.bitwiseAND(63).cast("int")) == 1, F.lit(False))
    return both.where(held if marked else ~held).select(*[df[c] for c in df.columns])


def open_store(uri: str):
    """``(file system, path)`` of a shared URI, usable on executors."""
    from pyarrow import fs
    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))  # Spark's names of one store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int):
    """crc32 of an integer column's decimal text, modulo ``n`` (null: null)."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


# ---- text as bytes -------------------------------------------------------

def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    bufs = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def doc_groups(off: np.ndarray, limit: int = GROUP_BYTES):
    """Ranges of rows that hold at most ``limit`` bytes (one row may hold more)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), in place on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rand64(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """Finds words in bytes and hashes them.

    ``keep``: the bytes that belong to words.  A-Z hash as a-z when ``fold``.
    A word's hash is a polynomial over random 64-bit byte values, normalised
    by its position, so that one running sum serves all words of a block.
    """

    BLOCK = 1 << 20

    def __init__(self, keep: np.ndarray, fold: bool = True) -> None:
        self.keep = keep
        self.value = rand64(256, 77)
        if fold:
            self.value[65:91] = self.value[97:123]
        base = 0x2545F4914F6CDD1D
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.pow = self.ipow = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, self.BLOCK + 4096)
            b = np.full(n, self.base)
            c = np.full(n, self.inverse)
            b[0] = c[0] = 1
            self.pow, self.ipow = np.multiply.accumulate(b), np.multiply.accumulate(c)

    def spans(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word starts, ends, and for each document its first word (one more at the end)."""
        if not len(data):
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(len(off), np.int64)
        m = self.keep[data]
        first = m.copy()
        first[1:] &= ~m[:-1]
        last = m.copy()
        last[:-1] &= ~m[1:]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut] = m[cut]
        last[cut - 1] = m[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        return s, e, np.searchsorted(s, off)

    def hashes(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = np.empty(len(s), np.uint64)
        i = 0
        with np.errstate(over="ignore"):
            while i < len(s):
                j = max(i + 1, int(np.searchsorted(e, s[i] + self.BLOCK, side="right")))
                lo, hi = s[i], e[j - 1]
                self._powers(hi - lo + 1)
                c = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum(self.value[data[lo:hi]] * self.pow[:hi - lo], out=c[1:])
                a, b = s[i:j] - lo, e[i:j] - lo
                out[i:j] = (c[b] - c[a]) * self.ipow[a] + (b - a).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
                i = j
            return mix64(out)


def space_words() -> Words:
    """Words by ``[^\\x20\\x09-\\x0D]+``, A-Z as a-z."""
    keep = np.ones(256, bool)
    keep[list(SPACES)] = False
    return Words(keep)


def bits_of(n: int) -> int:
    """The least power of two that is at least ``n``."""
    return 1 << max(0, int(n - 1).bit_length())


def crc_of(text: str) -> int:
    return zlib.crc32(text.encode())
