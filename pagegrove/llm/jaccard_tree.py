"""N-gram Jaccard join by signature trees (operator 4).

Links all documents whose sets of word shingles have a Jaccard similarity of
at least ``num / den``; exact, without caps, and without expanding groups of
copies into pairs.

How the work is spread
    Equal sets are one *class* (a 64-bit digest of the set).  If two sets
    link, they share a shingle among the first ``n - ceil(t n) + 1`` shingles
    of each in any common order; the order used takes shingles by a sketch
    of their corpus counts (2^24 slots of one byte, all rows counted; exact
    below 64, eight steps for each doubling above), rare ones first.
    So every link lies inside the block of one such shingle, and blocks are
    what Spark shuffles.  Very frequent shingles are salted into sub-blocks
    of bounded size, and blocks of sub-block pairs cover the rest.
First links
    Every class is offered at most one partner of each of three kinds from its
    blocks; those that link give first components.
Trees
    Blocks that still touch two components are *open*.  Classes that share open
    blocks, directly or in a chain, form a cluster, and each class goes with a
    small bitmap to its cluster's tree, once however many blocks it is in (a
    cluster beyond ``TREE_ROWS`` or ``TREE_TOKENS`` is dealt into sub-clusters that
    meet in pairs).  Classes that these bitmaps let link form the clusters to
    which whole sets go; most classes are in none, and their sets stay where they
    are.  Leaves have a bitmap of their tokens, an inner node the OR of
    its children's bitmaps, their size range and their largest excess of
    tokens over bits.  A dual traversal starts at (root, root) and drops a node
    pair if the sizes cannot fit, if both nodes already lie in one component,
    or if the largest possible overlap ``min(excess) + popcount(A & B)`` is too small for the
    least sizes.  Leaf pairs that remain are compared exactly on their whole
    sets, in the task that has them, and only links that join two components
    leave it.  Pairs inside one component need no test, since only components are asked for.

Input ``(id, text)``; other columns are ignored.  Result: one row per input
row with ``n_shingles`` (0 for null, empty or blank texts), ``component``
(least id reachable by links, itself included), ``n_verified`` (partner classes
verified on the way; not the number of links, since pairs inside one component
are not tested).  Repeated rows and ids form one
component if their sets are equal and not empty; a row with a null id gets
the least non-null id of its component, else null.  An empty table gives an
empty result.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrove.llm.common import bits_of, doc_groups, key_marks, mix64, rand64, space_words, stage, utf8, where_marked
from pagegrove.llm.graph import block_links, components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SKETCH_BITS = 24
SKETCH_PART = 1 << 20
#: The largest count of a task's own table; a fuller one is given out and begun anew.
COUNT_MOST = (1 << 16) - 1
FILTER_BITS = 24
#: Rows of one block handled by one tree; the salt of a frequent shingle follows from it.
BLOCK_ROWS = 100_000
PAIR_RUN = 128
#: Bits of a bitmap for each token, at least: of classes that are offered to each other, and of leaves.
TOKEN_BITS, LEAF_BITS = 4, 16
#: Leaves, and tokens of leaves, of one tree.
TREE_ROWS, TREE_TOKENS = 3000, 2_000_000


# ---- sets ----------------------------------------------------------------

def shingle_sets(data: np.ndarray, off: np.ndarray, width: int, words) -> list[np.ndarray]:
    """For each document its sorted distinct shingle hashes."""
    s, e, at = words.spans(data, off)
    h = words.hashes(data, s, e)
    with np.errstate(over="ignore"):
        c = rand64(width, 5)
        n = max(0, len(h) - width + 1)
        sh = np.zeros(n, np.uint64)
        for i in range(width):
            sh += h[i:i + n] * (c[i] | np.uint64(1))
        sh = mix64(sh)
        out = []
        for i in range(len(off) - 1):
            a, b = at[i], at[i + 1]
            if b - a >= width:
                out.append(np.unique(sh[a:b - width + 1]))
            elif b > a:  # fewer words: the whole sequence is the one shingle
                out.append(mix64((h[a:b] * (rand64(b - a, 91) | np.uint64(1))).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def digest(toks: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    with np.errstate(over="ignore"):
        x = mix64(toks ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(toks))
        return int(mix64(np.array([x])).view(np.int64)[0])


def _sets(batches, width):
    words = space_words()
    for b in batches:
        data, off = utf8(b.column("text"))
        for i, j in doc_groups(off):
            yield b, i, shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i], width, words)


def _scan(width: int):
    """Per row ``(id, n, cid, kept)``; per task the counts of its shingles as ``(part, counts)``, compressed."""
    names = ["id", "n", "cid", "kept", "part", "counts"]

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint16)
        kept = pa.nulls(0)

        def given():
            for p in range(len(counts) // SKETCH_PART):
                own = counts[p * SKETCH_PART:(p + 1) * SKETCH_PART]
                if own.any():
                    yield pa.RecordBatch.from_arrays([
                        pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, kept.type), pa.array([p], pa.int32()),
                        pa.array([pa.compress(own.tobytes(), "zstd", asbytes=True)], pa.binary())], names)
                    own[:] = 0

        for b, i, sets in _sets(batches, width):
            kept = b.column("kept").slice(i, len(sets))
            if sets:
                slot, times = np.unique((np.concatenate(sets) & np.uint64(len(counts) - 1)).astype(np.uint32), return_counts=True)
                while len(slot):
                    fit = np.minimum(times, COUNT_MOST - counts[slot].astype(np.int64))
                    counts[slot] += fit.astype(np.uint16)
                    slot, times = slot[times > fit], (times - fit)[times > fit]
                    if len(slot):  # full: what there is goes out
                        yield from given()
            n = [len(x) for x in sets]
            yield pa.RecordBatch.from_arrays([
                b.column("id").slice(i, len(sets)), pa.array(n, pa.int64()),
                pa.array([digest(x) if len(x) else None for x in sets], pa.int64()), kept,
                pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names)
        yield from given()
    return run


def steps(count: np.ndarray) -> np.ndarray:
    """Counts as one byte: exact below 64, eight steps for each doubling above, up to about 2^30."""
    high = 64 + np.floor(8 * (np.log2(np.maximum(count, 64)) - 6))
    return np.where(count < 64, count, np.minimum(high, 255)).astype(np.uint8)


def most_of(step: np.ndarray) -> np.ndarray:
    """The largest count of a step."""
    return np.where(step < 64, step, np.ceil(2.0 ** (6 + (step.astype(np.float64) - 63) / 8))).astype(np.int64)


def _sum_counts(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for p, c in zip(b.column("part").to_pylist(), b.column("counts"), strict=True):
            raw = pa.decompress(c.as_buffer(), 2 * SKETCH_PART, "zstd")
            if p not in total:
                total[p] = np.zeros(SKETCH_PART, np.int64)
            total[p] += np.frombuffer(raw, np.uint16)
    for p, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([int(v.sum())], pa.int64()),
                                          pa.array([steps(v).tobytes()], pa.binary())], ["part", "total", "steps"])


def sketch_of(parts: DataFrame) -> tuple[np.ndarray, int]:
    """The summed counts as steps, a table of fixed size (2^24 bytes) for any input, and the number of shingles."""
    out, total = np.zeros(1 << SKETCH_BITS, np.uint8), 0
    for r in parts.repartition(16, "part").mapInArrow(_sum_counts, "part int, total long, steps binary").toLocalIterator():
        out[r.part * SKETCH_PART:(r.part + 1) * SKETCH_PART] = np.frombuffer(r.steps, np.uint8)
        total += r.total
    return out, total


def _prefixes(width: int, num: int, den: int, sketch, block_rows: int):
    """The prefix of each class as rows ``(key, cid, np, salt)``; a class once per task.

    np = n * 2^32 + position in the prefix; salt = (number of salts) * 2^16 + own salt.
    """
    def run(batches):
        counts, seen = sketch.value, set()
        for _b, _i, sets in _sets(batches, width):
            key, cid, npos, salt = [], [], [], []
            for toks in sets:
                n = len(toks)
                if not n or (c := digest(toks)) in seen:
                    continue
                seen.add(c)
                k = n - -(-num * n // den) + 1
                often = counts[(toks & np.uint64(len(counts) - 1)).astype(np.int64)]
                first = np.lexsort((toks, often))[:k]
                split = np.minimum(-(-most_of(often[first]) // block_rows), 1 << 14)
                key.append(toks[first].view(np.int64))
                cid.append(np.full(k, c, np.int64))
                npos.append((n << 32) + np.arange(k, dtype=np.int64))
                salt.append((split << 16) + np.where(split > 1, (c & 0x7FFFFFFF) % np.maximum(split, 1), 0))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (key, cid, npos, salt)], ["key", "cid", "np", "salt"])
    return run


def _gather(batches, names):
    cols = [[] for _ in names]
    for b in batches:
        for c, name in zip(cols, names, strict=True):
            c.append(b.column(name).to_numpy(zero_copy_only=False))
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]


def _needed(a, b, num, den):
    """The least overlap with which sets of sizes a and b link."""
    return -(-num * (a + b) // (num + den))


def _blocks(num: int, den: int):
    """Rows that have a possible partner in their block, with up to three partners to try first."""
    def run(batches):
        key, cid, npos, salt = _gather(batches, ["key", "cid", "np", "salt"])
        if not len(key):
            return
        n, pos = npos >> 32, npos & 0xFFFFFFFF
        order = np.lexsort((cid, n, salt, key))
        key, cid, n, pos, salt = (x[order] for x in (key, cid, n, pos, salt))
        same = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
        one = np.concatenate(([True], ~(same & (cid[1:] == cid[:-1]))))  # a class may come from several tasks
        key, cid, n, pos, salt = (x[one] for x in (key, cid, n, pos, salt))
        head = np.concatenate(([True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, len(key)))
        run_of = np.cumsum(head) - 1
        ok = np.zeros(len(key), bool)
        mate = np.full((3, len(key)), -1, np.int64)
        rest = size[run_of] > PAIR_RUN  # in long runs all rows stay
        for d in range(1, min(PAIR_RUN, int(size.max()))):
            i = np.flatnonzero(run_of[d:] == run_of[:-d])
            j = i + d
            need = _needed(n[i], n[j], num, den)
            fit = (den * n[i] >= num * n[j]) & (pos[i] <= n[i] - need) & (pos[j] <= n[j] - need)
            i, j = i[fit], j[fit]
            ok[i] = ok[j] = True
            new = mate[0, j] < 0
            mate[0, j[new]] = i[new]
        first = start[run_of]
        by_cid = np.lexsort((cid, run_of))
        least, most = by_cid[first], by_cid[first + size[run_of] - 1]
        for k, m in ((1, least), (2, most)):
            lo, hi = np.minimum(n[m], n), np.maximum(n[m], n)
            good = (cid[m] != cid) & (den * lo >= num * hi) & (ok | rest)
            mate[k, good] = m[good]
        # in a longer run: the least overlap that any partner of the run could ask for
        code = run_of * (int(n.max()) + 2)
        least_n = n[np.minimum(np.searchsorted(code + n, code - (-num * n // den)), len(n) - 1)]
        ok |= rest & (pos <= n - _needed(n, np.minimum(least_n, n), num, den))
        stay = ok | (salt >= 2 << 16)
        partner = np.where(mate >= 0, cid[np.maximum(mate, 0)], cid[None, :])  # itself: none
        yield pa.RecordBatch.from_arrays([pa.array(x[stay]) for x in (key, cid, n, pos, salt, *partner)], ["key", "cid", "n", "pos", "salt", "m0", "m1", "m2"])
    return run


# ---- the sets of candidate classes ---------------------------------------

def signature(toks: np.ndarray, bits: int) -> np.ndarray:
    """Token bitmap of ``bits`` (a power of two, at least 64) as 64-bit words."""
    mark = np.zeros(bits, np.uint8)
    mark[((toks >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(mark, bitorder="little").view(np.uint64)


def _marks(batches):
    out = np.zeros(1 << FILTER_BITS, bool)
    for b in batches:
        out[b.column("cid").to_numpy() & ((1 << FILTER_BITS) - 1)] = True
    packed = np.packbits(out)
    size = len(packed) >> 6
    rows = [(p, packed[p * size:(p + 1) * size]) for p in range(64)]
    rows = [(p, x.tobytes()) for p, x in rows if x.any()]
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["part", "bits"])


def filter_of(cids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (2 MB) with the bits of all candidate classes; it may let others through."""
    out = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    size = len(out) >> 6
    for r in cids.coalesce(8).mapInArrow(_marks, "part int, bits binary").toLocalIterator():
        out[r.part * size:(r.part + 1) * size] |= np.frombuffer(r.bits, np.uint8)
    return out


def _tokens(width: int, wanted):
    def run(batches):
        marks, seen = wanted.value, set()
        for _b, _i, sets in _sets(batches, width):
            rows = []
            for toks in sets:
                if len(toks) and marks[(at := (c := digest(toks)) & ((1 << FILTER_BITS) - 1)) >> 3] >> (7 - (at & 7)) & 1 and c not in seen:
                    seen.add(c)
                    rows.append((c, toks))
            if rows:
                cid, toks = zip(*rows, strict=True)
                sig = [leaf_bitmap(t, TOKEN_BITS).tobytes() for t in toks]
                yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array([len(t) for t in toks], pa.int64()), pa.array([t.tobytes() for t in toks], pa.binary()),
                                                  pa.array(sig, pa.binary())], ["cid", "size", "toks", "sig"])
    return run


def most_shared(n, x: np.ndarray, m, y: np.ndarray) -> int:
    """The largest overlap of two sets of sizes n and m that their bitmaps allow."""
    w = min(len(x), len(y))
    x, y = x if len(x) == w else fold(x, w), y if len(y) == w else fold(y, w)
    return int(min(n - np.bitwise_count(x).sum(dtype=np.int64), m - np.bitwise_count(y).sum(dtype=np.int64)) + np.bitwise_count(x & y).sum(dtype=np.int64))


def _hopeful(num: int, den: int):
    """Pairs whose leaves' bitmaps do not rule them out."""
    def run(batches):
        for b in batches:
            keep = [most_shared(n, np.frombuffer(x, np.uint64), m, np.frombuffer(y, np.uint64)) >= _needed(n, m, num, den)
                    for n, x, m, y in zip(*(b.column(c).to_pylist() for c in ("n", "x", "m", "y")), strict=True)]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])
    return run


def _verify(num: int, den: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])
    return run


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets link."""
    x = pairs.join(sets.select(F.col("cid").alias("a"), F.col("toks").alias("x")), "a")
    xy = x.join(sets.select(F.col("cid").alias("b"), F.col("toks").alias("y")), "b")
    return stage(xy.select("a", "b", "x", "y").mapInArrow(_verify(num, den), "a long, b long"), name)


# ---- trees ---------------------------------------------------------------

def fold(sig: np.ndarray, words: int) -> np.ndarray:
    """A wider bitmap ORed down to ``words`` 64-bit words."""
    return np.bitwise_or.reduce(sig.reshape(-1, words), axis=0)


def possible(n, pos, comp, num: int, den: int) -> np.ndarray:
    """Rows of a block with a partner of another component that sizes and prefix positions allow; n ascending."""
    out = np.zeros(len(n), bool)
    last = np.searchsorted(n, den * n // num, side="right")
    i = 0
    while i < len(n):
        j = min(len(n), i + max(1, 1_000_000 // max(1, int(last[i]) - i)))
        top = int(last[j - 1])
        a, b = np.arange(i, j)[:, None], np.arange(i, top)[None, :]
        need = _needed(n[a], n[b], num, den)
        fit = (b > a) & (den * n[a] >= num * n[b]) & (comp[a] != comp[b]) & (pos[a] <= n[a] - need) & (pos[b] <= n[b] - need)
        out[i:j] |= fit.any(1)
        out[i:top] |= fit.any(0)
        i = j
    return out


def _open(num: int, den: int):
    """Rows of blocks ``(key, i, j)`` that a pair of two components may need."""
    names = ["key", "i", "j", "cid", "n", "pos", "comp"]

    def run(batches):
        cols = _gather(batches, names)
        if not len(cols[0]):
            return
        order = np.lexsort([cols[k] for k in (3, 4, 2, 1, 0)])
        cols = [c[order] for c in cols]
        key, i, j, cid, n, pos, comp = cols
        new = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cut = np.concatenate(([0], np.flatnonzero(new) + 1, [len(key)]))
        stay = np.zeros(len(key), bool)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            stay[a:b] = possible(n[a:b], pos[a:b], comp[a:b], num, den)
        yield pa.RecordBatch.from_arrays([pa.array(c[stay]) for c in cols], names)
    return run


def tree_pairs(n, pos, comp, sig, num: int, den: int, fan: int = 8):
    """Leaf pairs ``(i, j)`` that a dual traversal cannot rule out, in arrays.

    n: sizes; pos: the block's place in the prefix of each leaf, so that at
    most ``n - pos`` shingles can be shared if it is the first one in common;
    comp: component of each leaf; sig: a row of bitmap words for each leaf.
    Similar sizes and equal components should lie together.
    """
    levels = [(n, n, n - np.bitwise_count(sig).sum(1, dtype=np.int64), n - pos, comp, sig)]
    while len(levels[-1][0]) > 1:
        lo, hi, over, room, c, bits = levels[-1]
        at = np.arange(0, len(lo), fan)
        c0, c1 = np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)
        mixed = (c0 != c1) | (np.minimum.reduceat(c, at) == np.iinfo(np.int64).min)
        levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(over, at), np.maximum.reduceat(room, at),
                       np.where(mixed, np.iinfo(np.int64).min, c0), np.bitwise_or.reduceat(bits, at, axis=0)))
    a = b = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        lo, hi, over, room, c, bits = levels[depth]
        if depth < len(levels) - 1:
            i, j = np.meshgrid(np.arange(fan), np.arange(fan), indexing="ij")
            a, b = (a[:, None] * fan + i.ravel()).ravel(), (b[:, None] * fan + j.ravel()).ravel()
            inside = (a < len(lo)) & (b < len(lo)) & (a <= b)
            a, b = a[inside], b[inside]
        if not depth:
            a, b = a[a < b], b[a < b]
        least = _needed(lo[a], lo[b], num, den)
        keep = (den * hi[a] >= num * lo[b]) & (den * hi[b] >= num * lo[a]) & (room[a] >= least) & (room[b] >= least)
        keep &= (c[a] != c[b]) | (c[a] == np.iinfo(np.int64).min)
        a, b, least = a[keep], b[keep], least[keep]
        keep = np.zeros(len(a), bool)
        for s in range(0, len(a), 65_536):  # bounded memory whatever the number of node pairs
            x, y = a[s:s + 65_536], b[s:s + 65_536]
            keep[s:s + 65_536] = np.minimum(over[x], over[y]) + np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64) >= least[s:s + 65_536]
        a, b = a[keep], b[keep]
    return a, b


def width_groups(n, sigs, num: int, den: int):
    """Members of bitmap widths that fitting sizes can have, their bitmaps folded to the narrowest one, and which own that width."""
    reach = bits_of(-(-den // num))  # sizes differ by den / num at most, widths by the power of two that covers it
    width = np.array([len(x) for x in sigs])
    for w in np.unique(width):
        pick = np.flatnonzero((width >= w) & (width <= reach * w))
        if len(pick) > 1:
            yield pick, np.stack([fold(sigs[i], w) for i in pick]), width[pick] == w


def block_pairs(cid, n, pos, comp, sigs, num: int, den: int):
    """Candidate pairs of one block by the dual traversal of a tree for each width and the wider ones within reach."""
    _, which, size = np.unique(comp, return_inverse=True, return_counts=True)
    order = np.lexsort((cid, n, np.where(size[which] > 8, which, -1)))  # leaves of a large component lie together
    cid, n, pos, comp, sigs = cid[order], n[order], pos[order], comp[order], [sigs[i] for i in order]
    out = [np.zeros((2, 0), np.int64)]
    for pick, bits, own in width_groups(n, sigs, num, den):
        a, b = tree_pairs(n[pick], pos[pick], comp[pick], bits, num, den)
        near = own[a] | own[b]  # two of the wider ones meet in their own tree
        out.append(np.stack([cid[pick[a[near]]], cid[pick[b[near]]]]))
    return np.concatenate(out, axis=1)


def leaf_bitmap(toks: np.ndarray, token_bits: int) -> np.ndarray:
    return signature(toks, min(1 << 19, max(64, 1 << int(token_bits * len(toks) - 1).bit_length())))


def first_of_part(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` vertices the least one that the edges ``(a, b)`` reach from it."""
    root = np.arange(size)
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _by_tree(links):
    """``links`` of the rows of each cluster of a partition sorted by ``(cluster, i, j)``; one tree is held at a time."""
    def run(batches):
        held, now = [], None
        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([b.column(c).to_numpy() for c in ("cluster", "i", "j")])
            cut = np.concatenate(([0], np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1, [b.num_rows]))
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                this = tuple(at[:, s].tolist())
                if held and this != now:
                    yield links(pa.Table.from_batches(held).combine_chunks())
                    held = []
                now = this
                held.append(b.slice(s, e - s))
        if held:
            yield links(pa.Table.from_batches(held).combine_chunks())
    return run


def _near(num: int, den: int):
    """Edges ``(a, b)`` that hold together the classes of each tree whose staged bitmaps let them link, one for a class at most."""
    def links(t):
        cid, comp, n = (t.column(c).to_numpy() for c in ("cid", "comp", "n"))
        sigs = [np.frombuffer(x, np.uint64) for x in t.column("sig").to_pylist()]
        a, b = block_pairs(np.arange(len(cid)), n, np.zeros(len(n), np.int64), comp, sigs, num, den)
        root = first_of_part(a, b, len(cid))
        at = np.flatnonzero(root != np.arange(len(cid)))
        return pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(cid[root[at]])], ["a", "b"])
    return _by_tree(links)


def _trees(num: int, den: int):
    """Links ``(a, b)`` of all clusters of a partition."""
    def links(t):
        cid, comp, n = (t.column(c).to_numpy() for c in ("cid", "comp", "n"))
        toks = [np.frombuffer(x, np.uint64) for x in t.column("toks").to_pylist()]
        place = np.arange(len(cid))
        pairs = block_pairs(place, n, np.zeros(len(n), np.int64), comp, [leaf_bitmap(x, LEAF_BITS) for x in toks], num, den)
        found = np.array(block_links(pairs[0], pairs[1], comp, toks, num, den), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(cid[found[:, k]]) for k in (0, 1)], ["a", "b"])
    return _by_tree(links)


def tree_leaves(classes: DataFrame, edges: DataFrame, tree_rows: int, name: str) -> DataFrame:
    """Leaves ``(cluster, i, j, cid, n, comp)``: the ``classes(cid, n, comp)`` that ``edges(a, b)`` join to clusters.

    A cluster beyond ``tree_rows`` or ``TREE_TOKENS`` is dealt into sub-clusters that meet in pairs.
    """
    cluster = components(edges, name)
    leaves = classes.join(cluster.select(F.col("v").alias("cid"), F.col("root").alias("cluster")), "cid")
    wide = leaves.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / tree_rows), F.ceil(F.sum("n") / TREE_TOKENS)).alias("salts"))
    leaves = leaves.join(wide, "cluster").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("salts"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    return stage(leaves.select("cluster", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "cid", "n", "comp"), name + "-leaves")


# ---- the join ------------------------------------------------------------

def jaccard_components(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id",
                       text_col: str = "text", block_rows: int = BLOCK_ROWS, tree_rows: int = TREE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """``(id_col, n_shingles, component, n_verified, *keep)`` for every row of ``docs``; see the module's text.

    ``keep``: small columns that are read once, in the same scan as the id.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                        F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep or [])]).alias("kept"))
    kept_type = texts.schema["kept"].dataType.simpleString()
    scan = stage(texts.mapInArrow(_scan(width), f"id long, n long, cid long, kept {kept_type}, part int, counts binary"), "jaccard-scan")
    texts = texts.drop("kept")
    sketch, total = sketch_of(scan.where("part is not null").select("part", "counts"))
    ids = scan.where("part is null").select("id", "n", "cid", "kept")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * (den - num) / den // 1_000_000) + 1)

    small = sc.broadcast(sketch)
    prefix = texts.mapInArrow(_prefixes(width, num, den, small, block_rows), "key long, cid long, np long, salt long")
    cand = stage(prefix.repartition(parts, "key", "salt").mapInArrow(
        _blocks(num, den), "key long, cid long, n long, pos long, salt long, m0 long, m1 long, m2 long"), "jaccard-blocks")
    small.unpersist()
    wanted = sc.broadcast(filter_of(cand.select("cid")))
    sets = stage(texts.mapInArrow(_tokens(width, wanted), "cid long, size long, toks binary, sig binary"), "jaccard-sets")  # a class once per task
    wanted.unpersist()
    sigs = sets.select("cid", "size", "sig").dropDuplicates(["cid"])
    whole = lambda cids: where_marked(sets.select("cid", "toks"), "cid", stage(key_marks(cids), "jaccard-marks")).dropDuplicates(["cid"])

    first = cand.groupBy("cid").agg(F.max_by("m0", "key").alias("m0"), F.min("m1").alias("m1"), F.max("m2").alias("m2"))
    pairs = first.select("cid", F.explode(F.array("m0", "m1", "m2")).alias("m")).where("cid != m")
    pairs = pairs.select(F.least("cid", "m").alias("a"), F.greatest("cid", "m").alias("b")).distinct()
    leaf = lambda cid, n, sig: sigs.select(F.col("cid").alias(cid), F.col("size").alias(n), F.col("sig").alias(sig))
    pairs = pairs.join(leaf("a", "n", "x"), "a").join(leaf("b", "m", "y"), "b").select("a", "b", "n", "x", "m", "y")
    pairs = stage(pairs.mapInArrow(_hopeful(num, den), "a long, b long"), "jaccard-offers")
    ends = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid")))
    links = verified(pairs, whole(ends), num, den, "jaccard-links")
    label = components(links, "jaccard-first")

    n_salts, own = F.shiftright("salt", 16), F.col("salt").bitwiseAND(0xFFFF)
    rest = cand.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n_salts - 1, F.lit(0)))))
    rest = rest.select("key", "cid", "n", "pos", F.least(own, "o").alias("i"), F.greatest(own, "o").alias("j"))
    rest = rest.join(label.withColumnRenamed("v", "cid"), "cid", "left").select("key", "i", "j", "cid", "n", "pos", F.coalesce("root", "cid").alias("comp"))
    rows = rest.repartition(parts, "key", "i", "j").mapInArrow(_open(num, den), "key long, i long, j long, cid long, n long, pos long, comp long")
    rows = stage(rows, "jaccard-open")

    heads = rows.groupBy("key", "i", "j").agg(F.min("cid").alias("head"))
    edges = rows.join(heads, ["key", "i", "j"]).select(F.col("cid").alias("a"), F.col("head").alias("b")).distinct()
    classes = rows.select("cid", "n", "comp").distinct()
    together = lambda leaves: leaves.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    leaves = tree_leaves(classes, edges, tree_rows, "jaccard-clusters")
    near = together(leaves.join(sigs.select("cid", "sig"), "cid")).select("cluster", "i", "j", "cid", "n", "comp", "sig").mapInArrow(_near(num, den), "a long, b long")
    leaves = tree_leaves(classes, near, tree_rows, "jaccard-near")
    leaves = together(leaves.join(whole(leaves.select("cid")), "cid")).select("cluster", "i", "j", "cid", "n", "comp", "toks")
    every = stage(links.union(leaves.mapInArrow(_trees(num, den), "a long, b long")), "jaccard-links")
    label = components(every, "jaccard-second")

    every = every.distinct()
    ends = every.select(F.col("a").alias("cid")).union(every.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count(F.lit(1)).alias("n_verified"))
    classes = ids.where("cid is not null").groupBy("cid").agg(F.min("id").alias("least"))
    classes = stage(classes.join(label.withColumnRenamed("v", "cid"), "cid", "left").join(ends, "cid", "left")
                    .select("cid", "least", F.coalesce("root", "cid").alias("root"), F.coalesce("n_verified", F.lit(0).cast("long")).alias("n_verified")), "jaccard-classes")
    roots = classes.groupBy("root").agg(F.min("least").alias("component"))
    classes = classes.join(roots, "root").select("cid", "component", "n_verified")
    out = ids.join(classes, "cid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"),
                      F.coalesce("n_verified", F.lit(0).cast("long")).alias("n_verified"),
                      *[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(keep or [])])
