"""Ranked lexical search by pair-bound MaxScore (operator 12).

Ranks all documents for each query item by an integer BM25 score and returns
each item's ``k`` best; exact, with skipping that never loses a document.

Index
    Documents are cut into *shards* of a few thousand.  A shard holds, for the
    terms that the queries of a block ask for, postings (document, count) in
    document order, and the length of each document.  Corpus counts (documents,
    terms, document frequencies) are summed over all shards; then each shard is
    written again with the postings' scores (*impacts*), each term's largest
    one, and for pairs of terms that lie next to each other in an item by
    weight the *intersection list*: the documents that hold both, their joint
    impacts and the largest of these.
Search
    In a shard an item's terms are matched into disjoint pairs, those first
    whose joint maximum lies farthest under the sum of their own maxima; a
    pair's bound is the larger of its joint maximum and its two own maxima.  A
    shard whose bounds sum up to less than the item's threshold is skipped.  Else
    pairs and terms are put in order of their bounds: as long as the sum stays
    below the threshold they are not essential, and only documents of essential
    ones are candidates.  A candidate's bound for each pair that is left falls
    to the joint maximum or to one own maximum as the intersection list tells;
    who cannot reach the threshold goes before postings are read.
Thresholds
    The k-th best score of a sixteenth of the shards is a lower bound of the
    k-th best score of all, so it starts the search of all; each task raises it.
    Documents that reach a threshold exactly stay, since ids decide ties.

Queries go in blocks of bounded size, a whole search each.  Input
``(doc_id, text)`` and ``(item_id, text)``; other columns are ignored.  Terms are
runs of ASCII letters and digits and of all characters above ASCII, A-Z as
a-z.  Null and empty texts hold no terms: such documents rank nowhere, such
items get no rows.  Rows with one item_id are one item with all their terms; a
null item_id is an item too.  A repeated document row counts and ranks for itself;
of equal scores a null doc_id comes last.  Empty tables give an empty result.
"""

from __future__ import annotations

import sys
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagegrove.llm.common import Words, doc_groups, stage, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents and postings that close a shard; (item, term) rows of one block of queries; shards of which one gives first thresholds.
SHARD_DOCS, SHARD_POSTINGS, BLOCK_TERMS, SEED_SHARDS = 8192, 1 << 20, 1 << 20, 16
#: Each term is paired with so many of the next ones by weight.
NEIGHBOURS = 2
SHARD = "shard long, rows long, size long, docs long, terms long, ids binary, nulls binary, n binary, term binary, doc binary, tf binary"
IMPACTS = ("shard long, rows long, sizes array<long>, ids binary, nulls binary, term binary, first binary, doc binary, impact binary, most binary, "
           "pair binary, pair_first binary, pair_doc binary, pair_most binary")


def term_words() -> Words:
    """Terms by ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z as a-z."""
    keep = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        keep[a:b] = True
    return Words(keep)


def packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True) if len(x) else b""


def unpacked(raw: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, "zstd"), kind) if n else np.zeros(0, kind)


# ---- queries -------------------------------------------------------------

def _item_terms(batches):
    words = term_words()
    for b in batches:
        data, off = utf8(b.column("text"))
        s, e, at = words.spans(data, off)
        ids = b.column("id").take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(at))))
        yield pa.RecordBatch.from_arrays([ids, pa.array(words.hashes(data, s, e).view(np.int64))], ["id", "term"])


class Queries:
    """A block of items: the ids, the sorted term hashes, and each item's places in them."""

    def __init__(self, rows) -> None:
        self.ids = sorted({r.id for r in rows}, key=lambda x: (x is None, x or 0))
        place = {x: i for i, x in enumerate(self.ids)}
        term = np.array([r.term for r in rows], np.int64).view(np.uint64)
        self.vocabulary = np.unique(term)
        at, item = np.searchsorted(self.vocabulary, term), np.array([place[r.id] for r in rows], np.int64)
        order = np.lexsort((at, item))
        self.terms = np.split(at[order], np.flatnonzero(np.diff(item[order])) + 1)

    def weigh(self, weight: np.ndarray) -> None:
        """Puts each item's terms in order of weight and lists the pairs of neighbours, as numbers of ``self.pairs``."""
        ordered = [t[np.lexsort((t, weight[t]))] for t in self.terms]
        size = np.int64(len(self.vocabulary))
        codes = []
        for t in ordered:
            near = [np.stack([t[:-d], t[d:]]) for d in range(1, NEIGHBOURS + 1) if len(t) > d]
            a, b = np.concatenate(near, axis=1) if near else np.zeros((2, 0), np.int64)
            codes.append(np.minimum(a, b) * size + np.maximum(a, b))
        self.pairs = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        self.item_pairs = [np.searchsorted(self.pairs, c) for c in codes]
        self.pair_a, self.pair_b = self.pairs // size, self.pairs % size


# ---- index ---------------------------------------------------------------

def _shards(queries):
    """Shards of a task's documents, with the postings of the queries' terms."""
    names = [c.split()[0] for c in SHARD.split(", ")]

    def run(batches):
        vocabulary, words = queries.value.vocabulary, term_words()
        task, count = TaskContext.get().partitionId(), 0
        ids, nulls, ns, posts = [], [], [], []
        docs = postings = 0

        def shard():
            n = np.concatenate(ns)
            term, doc, tf = (np.concatenate(x) for x in zip(*posts, strict=True))
            order = np.lexsort((doc, term))
            cols = [(task << 32) + count, len(n), len(term), int((n > 0).sum()), int(n.sum()), packed(np.concatenate(ids)), packed(np.concatenate(nulls)), packed(n),
                    packed(term[order].astype(np.int32)), packed(doc[order].astype(np.int32)), packed(tf[order].astype(np.int32))]
            kinds = [pa.int64()] * 5 + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(cols, kinds, strict=True)], names)
        for b in batches:
            data, off = utf8(b.column("text"))
            own = b.column("id")
            own_null, own = own.is_null().to_numpy(zero_copy_only=False), own.fill_null(0).to_numpy()
            for i, j in doc_groups(off):
                chunk, rel = data[off[i]:off[j]], off[i:j + 1] - off[i]
                s, e, at = words.spans(chunk, rel)
                h = words.hashes(chunk, s, e)
                place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[place] == h)
                doc = np.searchsorted(at, hit, side="right") - 1
                code, tf = np.unique(doc * len(vocabulary) + place[hit], return_counts=True)
                posts.append((code % len(vocabulary), code // len(vocabulary) + docs, tf))
                ids.append(own[i:j])
                nulls.append(own_null[i:j])
                ns.append(np.diff(at))
                docs, postings = docs + j - i, postings + len(code)
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield shard()
                    ids, nulls, ns, posts, docs, postings, count = [], [], [], [], 0, 0, count + 1
        if docs:
            yield shard()
    return run


def _frequencies(size: int):
    """Documents for each term in a task's shards."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for raw, n in zip(b.column("term").to_pylist(), b.column("size").to_pylist(), strict=True):
                total += np.bincount(unpacked(raw, np.int32, n), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])
    return run


def impact_of(weight, tf, n, documents: int, terms: int):
    """The score of one posting, in 64-bit integers."""
    m = 50 + 50 * n * documents // terms
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def _impacts(queries, weight: np.ndarray, documents: int, terms: int):
    """Shards with impacts, their maxima and the intersection lists of the queries' pairs."""
    names = [c.split()[0] for c in IMPACTS.split(", ")]

    def run(batches):
        q = queries.value
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                n = unpacked(r["n"], np.int64, r["rows"])
                term, doc, tf = (unpacked(r[c], np.int32, r["size"]) for c in ("term", "doc", "tf"))
                impact = impact_of(weight[term], tf.astype(np.int64), n[doc], documents, terms)
                head = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
                first = np.append(head, len(term))
                own = term[head]
                most = np.maximum.reduceat(impact, head) if len(head) else np.zeros(0, np.int64)
                slot = np.full(len(q.vocabulary), -1)
                slot[own] = np.arange(len(own))
                both = np.flatnonzero((slot[q.pair_a] >= 0) & (slot[q.pair_b] >= 0))
                place = np.full(r["rows"], -1)
                pair, size, found, top = [], [], [], []
                order = both[np.argsort(q.pair_a[both], kind="stable")]
                now = -1
                for p in order.tolist():  # pairs of one first term share its table of places
                    a, c = slot[q.pair_a[p]], slot[q.pair_b[p]]
                    if a != now:
                        if now >= 0:
                            place[doc[first[now]:first[now + 1]]] = -1
                        place[doc[first[a]:first[a + 1]]] = np.arange(first[a], first[a + 1])
                        now = a
                    d = doc[first[c]:first[c + 1]]
                    at = place[d]
                    hit = np.flatnonzero(at >= 0)
                    if len(hit):
                        joint = impact[at[hit]] + impact[first[c] + hit]
                        pair.append(p)
                        size.append(len(hit))
                        found.append(d[hit])
                        top.append(int(joint.max()))
                listed = np.concatenate(found) if found else np.zeros(0, np.int32)
                by = np.argsort(pair, kind="stable") if pair else np.zeros(0, np.int64)
                start = np.cumsum([0, *size])
                listed = np.concatenate([listed[start[k]:start[k + 1]] for k in by]) if pair else listed
                cols = [r["ids"], r["nulls"], own.astype(np.int32), first.astype(np.int32), doc, impact, most,
                        np.array(pair, np.int32)[by], np.cumsum([0, *np.array(size, np.int64)[by]]).astype(np.int32), listed, np.array(top, np.int64)[by]]
                cols = [x if isinstance(x, bytes) else pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True) for x in cols]
                sizes = [len(own), len(own) + 1, len(doc), len(doc), len(own), len(pair), len(pair) + 1, len(listed), len(pair)]
                head = [pa.array([r["shard"]], pa.int64()), pa.array([r["rows"]], pa.int64()), pa.array([sizes], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array([x], pa.binary()) for x in cols)], names)
    return run


class Shard:
    """One shard of the impact index, read back."""

    def __init__(self, r: dict, n_terms: int, n_pairs: int) -> None:
        sizes = iter(r["sizes"])
        self.ids, self.nulls = unpacked(r["ids"], np.int64, r["rows"]), unpacked(r["nulls"], bool, r["rows"])
        own, self.first, self.doc, self.impact, most = (unpacked(r[c], k, next(sizes)) for c, k in (
            ("term", np.int32), ("first", np.int32), ("doc", np.int32), ("impact", np.int64), ("most", np.int64)))
        pair, self.pair_first, self.pair_doc, joint = (unpacked(r[c], k, next(sizes)) for c, k in (
            ("pair", np.int32), ("pair_first", np.int32), ("pair_doc", np.int32), ("pair_most", np.int64)))
        self.slot, self.most = np.full(n_terms, -1), np.zeros(n_terms, np.int64)
        self.slot[own], self.most[own] = np.arange(len(own)), most
        self.pair_slot, self.joint = np.full(n_pairs, -1), np.zeros(n_pairs, np.int64)
        self.pair_slot[pair], self.joint[pair] = np.arange(len(pair)), joint

    def postings(self, term: int):
        s = self.slot[term]
        return self.doc[self.first[s]:self.first[s + 1]], self.impact[self.first[s]:self.first[s + 1]]

    def listed(self, pair: int) -> np.ndarray:
        s = self.pair_slot[pair]
        return self.pair_doc[self.pair_first[s]:self.pair_first[s + 1]] if s >= 0 else self.pair_doc[:0]


def inside(docs: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the docs would stand in a sorted list, and whether they do."""
    if not len(listed):
        return np.zeros(len(docs), np.int64), np.zeros(len(docs), bool)
    at = np.minimum(np.searchsorted(listed, docs), len(listed) - 1)
    return at, listed[at] == docs


# ---- search --------------------------------------------------------------

def units_of(shard: Shard, terms: np.ndarray, pairs: np.ndarray, a: np.ndarray, b: np.ndarray):
    """``(bound, term, term or -1, pair or -1)`` of an item's disjoint pairs and other terms, least bounds first.

    Pairs are chosen by how far their bound lies under the sum of the two maxima.
    """
    here = terms[shard.slot[terms] >= 0]
    ma, mb = shard.most[a], shard.most[b]
    bound = np.maximum(np.maximum(ma, mb), shard.joint[pairs])
    saving = np.where((ma > 0) & (mb > 0), ma + mb - bound, 0)
    used, units = set(), []
    for k in np.argsort(-saving, kind="stable").tolist():
        if saving[k] <= 0:
            break
        x, y = int(a[k]), int(b[k])
        if x not in used and y not in used:
            used |= {x, y}
            units.append((int(bound[k]), x, y, int(pairs[k])))
    units += [(int(shard.most[t]), int(t), -1, -1) for t in here.tolist() if t not in used]
    return sorted(units)


def search_shard(shard: Shard, terms, pairs, a, b, threshold: int, work: np.ndarray):
    """Docs of the shard that score at least ``threshold`` (1 or more), with their scores; ``work``: zeros, one for each doc."""
    units = units_of(shard, terms, pairs, a, b)
    below = np.cumsum([u[0] for u in units])
    none = np.zeros(0, np.int64)
    if not units or below[-1] < threshold:
        return none, none
    split = int(np.searchsorted(below, threshold))  # units before it are not essential
    touched = []
    for _bound, x, y, _pair in units[split:]:
        for t in (x, y):
            if t >= 0:
                doc, impact = shard.postings(t)
                work[doc] += impact
                touched.append(doc)
    docs = np.unique(np.concatenate(touched))
    score = work[docs]
    work[docs] = 0
    for k in range(split - 1, -1, -1):
        bound, x, y, pair = units[k]
        rest = int(below[k - 1]) if k else 0
        stay = score + (rest + bound) >= threshold
        if pair >= 0:
            docs, score = docs[stay], score[stay]
            most = np.where(inside(docs, shard.listed(pair))[1], shard.joint[pair], max(shard.most[x], shard.most[y]))
            stay = score + rest + most >= threshold
        docs, score = docs[stay], score[stay]
        if not len(docs):
            return none, none
        for t in (x, y):
            if t >= 0:
                doc, impact = shard.postings(t)
                at, there = inside(docs, doc)
                score = score + np.where(there, impact[at], 0)
    stay = score >= threshold
    return docs[stay], score[stay]


def _search(queries, thresholds, k: int):
    """Each item's best ``k`` documents of a task: ``(item, item_id, doc_id, score)``."""
    def run(batches):
        q = queries.value
        least = [int(x) for x in thresholds]
        best = [[] for _ in q.ids]
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                shard = Shard(r, len(q.vocabulary), len(q.pairs))
                work = np.zeros(r["rows"], np.int64)
                for i, terms in enumerate(q.terms):
                    p = q.item_pairs[i]
                    docs, score = search_shard(shard, terms, p, q.pair_a[p], q.pair_b[p], least[i], work)
                    if not len(docs):
                        continue
                    if len(docs) > k:
                        order = np.lexsort((shard.ids[docs], shard.nulls[docs], -score))[:k]
                        docs, score = docs[order], score[order]
                    rows = best[i] + list(zip((-score).tolist(), shard.nulls[docs].tolist(), shard.ids[docs].tolist(), strict=True))
                    best[i] = sorted(rows)[:k]
                    if len(best[i]) == k:
                        least[i] = max(least[i], -best[i][-1][0])
        rows = [(i, q.ids[i], None if null else d, -s) for i, found in enumerate(best) for s, null, d in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["item", "item_id", "doc_id", "score"])
    return run


def _ranked(shards: DataFrame, queries, thresholds, k: int) -> DataFrame:
    found = shards.mapInArrow(_search(queries, thresholds, k), "item long, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, rows, k: int) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    queries = Queries(rows)
    sent = sc.broadcast(queries)
    shards = stage(docs.mapInArrow(_shards(sent), SHARD), "search-shards")
    total = shards.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    documents, terms = total.docs or 0, total.terms or 0
    df = np.zeros(len(queries.vocabulary), np.int64)
    counted = shards.select("term", "size").mapInArrow(_frequencies(len(df)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in counted.collect():  # a row for each term of the block
        df[r.term] = r.df
    weight = np.array([floor(1000 * log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    queries.weigh(weight)
    weighed = sc.broadcast(queries)
    index = shards.select("shard", "rows", "size", "ids", "nulls", "n", "term", "doc", "tf")
    index = stage(index.mapInArrow(_impacts(weighed, weight, documents, max(terms, 1)), IMPACTS), "search-impacts")

    seeds = _ranked(index.where(F.pmod(F.xxhash64("shard"), F.lit(SEED_SHARDS)) == 0), weighed, [1] * len(queries.ids), k)
    first = [1] * len(queries.ids)
    for r in seeds.where(F.col("rank") == k).select("item", "score").collect():  # a row for each item of the block
        first[r.item] = r.score
    return _ranked(index, weighed, first, k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` of each item's ``k`` best documents with a score above 0; see the module's text."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    asked = stage(asked.mapInArrow(_item_terms, "id long, term long").distinct(), "search-queries")
    blocks = asked.count() // block_terms + 1
    out = None
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()  # about ``block_terms`` rows
        if rows:
            found = _block(texts, rows, k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
            out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
