"""Conversation prefix trie by range minima over sorted LCPs (operator 11).

Every node of the trie of all conversations, with its members, children,
leaves and the words that sharing its subtree saves.

How it works
    A turn is the MD5 of its role and text and its number of words; texts never
    move.  A conversation is the row of its turns' digests, 16 bytes a turn, so
    the row's bytes sort as the turns do.  Equal rows are folded into one with
    their number and least id; their ids are digested in ascending order by
    a stream over pieces of bounded size, so a row that a third of all
    conversations share costs one task its pieces and no memory.
    Distinct rows lie in ranges; in each range one sparse table holds minima of
    the longest common prefixes (LCPs) of neighbours.  Each candidate prefix
    (row, depth) finds its leftmost and its rightmost member by binary search
    over that table, each on its own, without any stack; prefix sums over
    rows and candidates then give all its numbers.
Ranges
    A range knows the last row of the range before (one key a range passes the
    driver), so it counts no node, leaf or word that was counted before.  Nodes
    that touch a range's ends carry a digest of their prefix and are
    summed up over ranges; there are at most two paths of them a range.

``rebuild`` gives each conversation the first turns of another one, so that
prefixes are shared; ``trie`` takes any ``(conv_id, turns)``.

Input ``(conv_id, turn, role, text)``; other columns are ignored.  Turns are
ordered by ``turn``, null first, equal ones by their digests; repeated rows
are turns of their own.  Null roles and texts count as empty.  Rows without a
conv_id belong to no conversation.  An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrove.llm.common import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGEST = 16
#: Bytes of joined ids in one piece; distinct rows of one range.
PIECE, RANGE_ROWS = 1 << 16, 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"
NODE = ("key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")


# ---- conversations as rows of digests --------------------------------------

def conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the digests (hex) and word counts of each conversation's turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    one = F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"], t["words"])).alias("turns"))


def rebuild(convs: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversation c with the first h turns of conversation ``c - c % group`` in place of its own; h = crc32(c) % most."""
    heads = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    own = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


# ---- equal rows ------------------------------------------------------------

def _pieces(batches):
    """Runs of equal keys as ``(key, words, n, least, ids)``, cut where the joined ids reach ``PIECE`` bytes."""
    names = ["key", "words", "n", "least", "ids"]
    key = words = None
    ids: list[str] = []
    size, out = 0, []

    def batch(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.int64()),
                                           pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())], names)
    for b in batches:
        for c, k, w in zip(b.column("conv_id").to_pylist(), b.column("key").to_pylist(), b.column("words").to_pylist(), strict=True):
            if ids and (k != key or size >= PIECE):
                out.append((key, words, len(ids), int(ids[0]), ",".join(ids)))
                ids, size = [], 0
            key, words = k, w
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if len(out) >= 1000:
            yield batch(out)
            out = []
    if ids:
        out.append((key, words, len(ids), int(ids[0]), ",".join(ids)))
    if out:
        yield batch(out)


def _folded(batches):
    """One row for each key: ``(key, words, n, least, ends)``; pieces come sorted by key and least id."""
    names = ["key", "words", "n", "least", "ends"]
    now, out = None, []

    def batch(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.int64()),
                                           pa.array(cols[3], pa.int64()), pa.array([h.hexdigest() for h in cols[4]], pa.string())], names)
    for b in batches:
        for k, w, n, least, ids in zip(*(b.column(c).to_pylist() for c in ("key", "words", "n", "least", "ids")), strict=True):
            if now and now[0] == k:
                now[2] += n
                now[4].update(b"," + ids.encode())
            else:
                if now:
                    out.append(now)
                now = [k, w, n, least, hashlib.sha256(ids.encode())]
        if len(out) >= 1000:
            yield batch(out)
            out = []
    if now:
        out.append(now)
    if out:
        yield batch(out)


# ---- range minima ----------------------------------------------------------

def common(a: bytes, b: bytes) -> int:
    """The number of turns with which both rows begin."""
    lo, hi = 0, min(len(a), len(b)) // DIGEST
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * DIGEST:mid * DIGEST] == b[lo * DIGEST:mid * DIGEST]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def sparse_table(x: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minima of all stretches of 2^k values."""
    levels = [x]
    while 2 << (len(levels) - 1) <= len(x):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def range_min(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of ``x[a..b]``, ends included."""
    k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), levels[0].dtype)
    for level in np.unique(k):
        i = np.flatnonzero(k == level)
        out[i] = np.minimum(levels[level][a[i]], levels[level][b[i] - (1 << int(level)) + 1])
    return out


def leftmost(lcps: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first row that shares ``depth`` turns with row ``at``, by binary search."""
    pos = at.copy()
    for k in range(len(lcps) - 1, -1, -1):
        to = pos - (1 << k)
        ok = to >= 0
        ok[ok] = lcps[k][to[ok]] >= depth[ok]
        pos[ok] = to[ok]
    return pos


def rightmost(lcps: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last row that shares ``depth`` turns with row ``at``, by binary search."""
    pos, n = at.copy(), len(lcps[0])
    for k in range(len(lcps) - 1, -1, -1):
        ok = pos + (1 << k) <= n
        ok[ok] = lcps[k][pos[ok]] >= depth[ok]
        pos[ok] += 1 << k
    return pos


def path_keys(row: bytes) -> list[bytes]:
    """A digest of each prefix of a row, the empty one first."""
    h = hashlib.md5()
    out = [h.digest()]
    for i in range(0, len(row), DIGEST):
        h.update(row[i:i + DIGEST])
        out.append(h.copy().digest())
    return out


def range_nodes(keys: list[bytes], words: list[list[int]], n: np.ndarray, least: np.ndarray, ends: list[str], before: bytes | None) -> pa.RecordBatch:
    """The nodes of one range of sorted distinct rows; ``before`` is the last row of the range before."""
    rows = len(keys)
    size = np.array([len(k) // DIGEST for k in keys])
    lcp = np.array([common(a, b) for a, b in zip(keys, keys[1:], strict=False)], np.int64)
    lcps = sparse_table(lcp)
    carry = -1 if before is None else common(before, keys[0])
    first = np.concatenate(([0], lcp + 1))  # a row's candidates: its prefixes that no row before it has
    count = size - first + 1
    base = np.cumsum(count) - count
    at = np.repeat(np.arange(rows), count)
    depth = np.arange(len(at)) - base[at] + first[at]
    left, right = leftmost(lcps, at, depth), rightmost(lcps, at, depth)
    new = (left > 0) | (depth > carry)

    flat = np.concatenate([[0], *words]).astype(np.int64)
    so_far = np.cumsum(flat)
    start = np.cumsum(size) - size
    own = np.where(depth > 0, flat[start[at] + depth], 0)
    above = so_far[start[at] + np.maximum(depth - 1, 0)] - so_far[start[at]]
    total = so_far[start + size] - so_far[start]
    sums = lambda x: np.concatenate(([0], np.cumsum(x)))
    n_sum, word_sum, new_sum = sums(n), sums(n * total), sums(new * own)
    convs = n_sum[right + 1] - n_sum[left]
    saved = word_sum[right + 1] - word_sum[left] - convs * above - (new_sum[base[right] + count[right]] - new_sum[base[left] + depth - first[left]])

    # a row is no leaf if the next one goes on from it; that is counted where the next one is
    goes_on = sums(np.concatenate(([0], lcp == size[:-1])))
    leaves = right - left + 1 - (goes_on[right + 1] - goes_on[left + 1])
    if before is not None and carry == len(before) // DIGEST:
        leaves -= (left == 0) & (depth <= carry)
    up = leftmost(lcps, at, depth - 1)
    parent = np.where(depth > 0, base[up] + depth - 1 - first[up], -1)
    children = np.bincount(parent[new & (depth > 0)], minlength=len(at))

    conv = range_min(sparse_table(least), left, right)
    open_left, open_right = path_keys(keys[0]), path_keys(keys[-1])
    key = [open_left[d] if i == 0 else open_right[d] if j == rows - 1 else None for i, j, d in zip(left.tolist(), right.tolist(), depth.tolist(), strict=True)]
    parent_key = [key[p] if p >= 0 else None for p in parent.tolist()]
    known = np.array([p < 0 or key[p] is not None for p in parent.tolist()])
    sha = [ends[i] if d == s else None for i, d, s in zip(left.tolist(), depth.tolist(), size[left].tolist(), strict=True)]
    cols = [pa.array(key, pa.binary()), pa.array(parent_key, pa.binary()), pa.array(conv), pa.array(depth), pa.array(conv[np.maximum(parent, 0)], mask=known),
            pa.array(convs), pa.array(children.astype(np.int64)), pa.array(leaves), pa.array(saved), pa.array(sha, pa.string())]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in NODE.split(", ")])


def _ranges(before: dict[int, bytes]):
    """Nodes of all ranges of a partition sorted by range and key; one range is held at a time."""
    def nodes(p, held):
        t = pa.Table.from_batches(held)
        return range_nodes(t.column("key").to_pylist(), t.column("words").to_pylist(), t.column("n").to_numpy(), t.column("least").to_numpy(),
                           t.column("ends").to_pylist(), before.get(p))

    def run(batches):
        held, now = [], None
        for b in batches:
            p = b.column("p").to_numpy()
            cut = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
            for s, e in zip(cut, cut[1:], strict=False):
                if s == e:
                    continue
                if held and p[s] != now:
                    yield nodes(now, held)
                    held = []
                now = int(p[s])
                held.append(b.slice(s, e - s))
        if held:
            yield nodes(now, held)
    return run


# ---- the trie --------------------------------------------------------------

def trie(convs: DataFrame, range_rows: int = RANGE_ROWS, salts: int = 16) -> DataFrame:
    """All nodes of ``(conv_id, turns)`` with distinct ids; see the module's text."""
    spark = convs.sparkSession
    hexes = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    rows = stage(convs.select("conv_id", F.unhex(hexes).alias("key"), F.transform("turns", lambda t: t["words"].cast("int")).alias("words")), "trie-rows")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // range_rows + 1)
    folded = "key binary, words array<int>, n long, least long"
    pieces = rows.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, folded + ", ids string")
    distinct = pieces.repartitionByRange(parts, "key").sortWithinPartitions("key", "least").mapInArrow(_folded, folded + ", ends string")
    distinct = stage(distinct.withColumn("p", F.spark_partition_id()), "trie-distinct")

    before, last = {}, None
    for r in sorted(distinct.groupBy("p").agg(F.max("key").alias("key")).collect()):  # a row for each range
        before[r.p], last = last, bytes(r.key)
    nodes = distinct.repartition(parts, "p").sortWithinPartitions("p", "key").mapInArrow(_ranges(before), NODE)
    nodes = stage(nodes, "trie-nodes")

    summed = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    ends = nodes.where("key is not null").groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
                                                             F.lit(None).cast("long").alias("parent_conv_id"), *summed, F.max("ends_sha256").alias("ends_sha256"))
    ends = stage(ends.select(*nodes.columns), "trie-ends")
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    parents = ends.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"), salt)
    every = nodes.where("key is null").union(ends).withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(salts)).cast("int"))  # a node may have very many children
    return every.join(parents, ["parent_key", "salt"], "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
