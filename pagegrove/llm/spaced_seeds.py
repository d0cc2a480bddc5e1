"""Benchmark decontamination by spaced seeds (operator 10).

Words are runs of ASCII letters and digits or non-ASCII characters of the
lower-cased text, so punctuation does not matter.  Each fixed mask takes some
positions of a word window and ignores the others; a window's seed is a hash
of the taken words.  Seeds of documents and of benchmark items are joined;
around each hit the words are compared along the hit's diagonal, and the hit
counts if some aligned stretch of ``overlap`` words (the whole item if that
is shorter) has at least ``identity`` equal words.  So substituted words
within a copied passage do not hide it, and a short common phrase does not
make a passage.

At scale: documents are scanned once; a bitmap of fixed size (4 MB) made from
the benchmark's seeds lets through nearly only true seeds, and only those are
shuffled, with the words around them stored once per stretch of hits.  The
bitmap may let others through, never fewer; the join that follows is exact.
Texts are known by their MD5, so copies of one text are checked once per task.

Which masks an item has follows from its length (``masks_of``): the usual
ones from ``LONG`` words on, lighter ones for shorter items, which a few substitutions
would hide from the others, and one that takes all words for items with fewer
than ``MIN_ITEM``, which count only word for word.  Documents are scanned with the masks
that the benchmark's lengths ask for.

Null and empty texts match nothing, nor do texts without words.
Repeated rows give the same matches each; empty tables give empty results.
Other columns are never read.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrove.llm.common import Words, doc_groups, mix64, rand64, stage, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Masks of weight 6, and of weight 3 for short items; 1 takes the word, 0 ignores it.
MASKS = ["111111", "1101011001", "1011001011", "110011011"]
LIGHT = ["111", "1101", "1011"]
OVERLAP, IDENTITY, MIN_ITEM, LONG = 14, 0.75, 8, 14
BITMAP_BITS = 25
#: Hits at most so many words apart share one stretch of stored words.
GAP = 16


def word_finder() -> Words:
    keep = np.zeros(256, bool)
    keep[48:58] = keep[65:91] = keep[97:123] = True
    keep[128:] = True
    return Words(keep)


def masks_of(n: int, min_item: int = MIN_ITEM) -> list[str]:
    """The masks of an item of ``n`` words."""
    return [] if not n else ["1" * n] if n < min_item else LIGHT if n < LONG else MASKS


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each window start; the array ends with the last whole window."""
    take = [i for i, c in enumerate(mask) if c == "1"]
    n = max(0, len(h) - len(mask) + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        c = rand64(len(take), 1000 + (int(mask, 2) & 0xFFFFFFFF)) | np.uint64(1)
        for k, i in zip(c, take, strict=True):
            out += h[i:i + n] * k
        return mix64(out)


def _probes(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64((1 << BITMAP_BITS) - 1)
    return (seed & m).astype(np.int64), ((seed >> np.uint64(32)) & m).astype(np.int64)


def _item_rows(min_item: int):
    """Rows of the benchmark: a text's words, its seeds, and their positions."""
    def run(batches):
        finder = word_finder()
        for b in batches:
            data, off = utf8(b.column("text"))
            s, e, at = finder.spans(data, off)
            h = finder.hashes(data, s, e)
            words, seed, pos = [], [], []
            for i in range(len(off) - 1):
                w = h[at[i]:at[i + 1]]
                own = [seeds(w, m) for m in masks_of(len(w), min_item)]
                words.append(w.tobytes())
                seed.append(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64))
                pos.append(np.concatenate([np.arange(len(x), dtype=np.int32) for x in own]) if own else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(words, pa.binary()), pa.array(seed, pa.list_(pa.int64())),
                                              pa.array(pos, pa.list_(pa.int32()))], ["item", "words", "seed", "pos"])
    return run


def _bitmap_rows(batches):
    out = np.zeros(1 << BITMAP_BITS, bool)
    for b in batches:
        for p in _probes(b.column("seed").to_numpy().view(np.uint64)):
            out[p] = True
    packed = np.packbits(out)
    size = len(packed) >> 6
    rows = [(p, packed[p * size:(p + 1) * size]) for p in range(64)]
    rows = [(p, x.tobytes()) for p, x in rows if x.any()]
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["part", "bits"])


def bitmap(item_seeds: DataFrame) -> np.ndarray:
    """Two bits for each seed in a packed bitmap whose size does not depend on the input."""
    out = np.zeros(1 << BITMAP_BITS >> 3, np.uint8)
    size = len(out) >> 6
    for r in item_seeds.select("seed").coalesce(8).mapInArrow(_bitmap_rows, "part int, bits binary").toLocalIterator():
        out[r.part * size:(r.part + 1) * size] |= np.frombuffer(r.bits, np.uint8)
    return out


def _scan(marks, overlap: int, masks: list[str]):
    """Stretches of documents around seeds that the bitmap lets through."""
    span = max(map(len, masks), default=0)

    def there(probe):
        return (marks.value[probe >> 3] >> (7 - (probe & 7)).astype(np.uint8)) & 1 > 0

    def run(batches):
        finder, seen = word_finder(), set()
        for b in batches:
            data, off = utf8(b.column("text"))
            keys = b.column("key")
            rows = []
            for i, j in doc_groups(off):
                s, e, at = finder.spans(data[off[i]:off[j]], off[i:j + 1] - off[i])
                h = finder.hashes(data[off[i]:off[j]], s, e)
                pos, seed = [], []
                for mask in masks:
                    x = seeds(h, mask)
                    p1, p2 = _probes(x)
                    hit = np.flatnonzero(there(p1))
                    hit = hit[there(p2[hit])]
                    end = at[np.searchsorted(at, hit, side="right")]  # where the hit's document ends
                    hit = hit[hit + len(mask) <= end]
                    pos.append(hit)
                    seed.append(x[hit])
                if not any(map(len, pos)):
                    continue
                pos, seed = np.concatenate(pos), np.concatenate(seed)
                order = np.lexsort((seed, pos))
                pos, seed = pos[order], seed[order]
                doc = np.searchsorted(at, pos, side="right") - 1
                cut = np.flatnonzero((doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > GAP)) + 1
                for a, z in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(pos)])), strict=True):
                    d = doc[a]
                    key = keys[i + int(d)].as_py()
                    lo, hi = max(at[d], pos[a] - overlap), min(at[d + 1], pos[z - 1] + span + overlap)
                    if (key, int(pos[a] - at[d])) in seen:
                        continue
                    seen.add((key, int(pos[a] - at[d])))
                    rows.append((key, int(lo - at[d]), h[lo:hi].tobytes(), seed[a:z].view(np.int64), (pos[a:z] - at[d]).astype(np.int32)))
            if rows:
                k, lo, w, sd, ps = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(lo, pa.int32()), pa.array(w, pa.binary()),
                                                  pa.array(sd, pa.list_(pa.int64())), pa.array(ps, pa.list_(pa.int32()))], ["key", "lo", "ctx", "seed", "pos"])
    return run


def best_stretch(doc: np.ndarray, item: np.ndarray, diagonal: int, overlap: int) -> tuple[int, int]:
    """Most equal words in an aligned stretch, and the stretch's length; word ``i`` of the item meets ``i + diagonal``."""
    m = min(overlap, len(item))
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi - lo < m:
        return 0, m
    c = np.concatenate(([0], np.cumsum(doc[lo + diagonal:hi + diagonal] == item[lo:hi])))
    return int((c[m:] - c[:-m]).max()), m


def _verify(overlap: int, identity: float, min_item: int):
    def run(batches):
        for b in batches:
            got = [best_stretch(np.frombuffer(c.as_buffer(), np.uint64), np.frombuffer(w.as_buffer(), np.uint64), d.as_py(), overlap)
                   for c, w, d in zip(b.column("ctx"), b.column("words"), b.column("diagonal"), strict=True)]
            keep = pa.array([n >= (identity if m >= min(min_item, overlap) else 1) * m > 0 for n, m in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("key").filter(keep), b.column("item").filter(keep), pa.array([n for n, _ in got], pa.int32()).filter(keep),
                                              pa.array([m for _, m in got], pa.int32()).filter(keep)], ["key", "item", "n_equal", "n_compared"])
    return run


def text_key(text_col: str = "text"):
    """What a text is known by: the MD5 of its UTF-8 (null: that of the empty text)."""
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))


def contaminations(docs: DataFrame, bench: DataFrame, text_col: str = "text", bench_col: str = "text", overlap: int = OVERLAP,
                   identity: float = IDENTITY, min_item: int = MIN_ITEM) -> DataFrame:
    """``(key, item, n_equal, n_compared)``: MD5 of document text and item text for each verified pair."""
    spark = docs.sparkSession
    lower = lambda c: F.lower(F.col(c).cast("string"))
    texts = bench.where(F.col(bench_col).isNotNull()).select(text_key(bench_col).alias("item"), lower(bench_col).alias("text")).dropDuplicates(["item"])
    items = stage(texts.mapInArrow(_item_rows(min_item), "item string, words binary, seed array<long>, pos array<int>"), "seeds-items")
    lengths = items.select(F.least(F.octet_length("words") / 8, F.lit(LONG)).cast("int").alias("n")).distinct().collect()  # at most LONG of them
    masks = sorted({m for r in lengths for m in masks_of(r.n, min_item)})
    item_seeds = items.select("item", F.explode(F.arrays_zip("seed", "pos")).alias("x")).select("item", "x.seed", F.col("x.pos").alias("item_pos"))
    marks = spark.sparkContext.broadcast(bitmap(item_seeds))
    found = docs.select(text_key(text_col).alias("key"), lower(text_col).alias("text")).mapInArrow(
        _scan(marks, overlap, masks), "key string, lo int, ctx binary, seed array<long>, pos array<int>")
    found = stage(found, "seeds-found")
    found = found.withColumn("first", F.col("pos")[0])  # tells stretches apart that begin with the same words
    hits = found.select("key", "lo", "first", F.explode(F.arrays_zip("seed", "pos")).alias("x")).select("key", "lo", "first", "x.seed", F.col("x.pos").alias("doc_pos"))
    pairs = hits.distinct().join(item_seeds, "seed").select("key", "lo", "first", "item", (F.col("doc_pos") - F.col("lo") - F.col("item_pos")).alias("diagonal")).distinct()
    around = pairs.join(found.select("key", "lo", "first", "ctx").dropDuplicates(["key", "first"]), ["key", "lo", "first"]).join(items.select("item", "words"), "item")
    good = around.select("key", "item", "diagonal", "ctx", "words").mapInArrow(_verify(overlap, identity, min_item), "key string, item string, n_equal int, n_compared int")
    return good.groupBy("key", "item").agg(F.max("n_equal").alias("n_equal"), F.max("n_compared").alias("n_compared"))


def document_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", **kw) -> DataFrame:
    """One row for each document and benchmark item that it holds: ``(id, item, n_equal, n_compared)``."""
    good = stage(contaminations(docs, bench, **kw), "seeds-good")
    ids = docs.select(F.col(id_col), text_key().alias("key"))
    items = bench.select(F.col(item_col), text_key().alias("item")).distinct()
    return good.join(ids, "key").join(items, "item").select(id_col, item_col, "n_equal", "n_compared")
