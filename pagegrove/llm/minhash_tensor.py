"""MinHash near-duplicates by tensored banding (operator 13).

Links documents whose sets of word shingles have a Jaccard similarity of at
least ``num / den``; every link is confirmed on the whole sets.

Minhashes
    Equal sets are one *class* (a 64-bit digest of the set).  A class has
    ``collections`` small collections of ``rows`` minhashes.  A table's key is
    a *pair* of collections, so 12 collections of two minhashes (24 in all)
    stand for 66 tables of four minhashes (264 if each had its own).  Two sets
    meet in a table as soon as two of their collections agree; at a similarity
    of 0.85 that fails for 7 in a million pairs (``miss``), for one in a
    hundred million at 0.95.
Tables
    Values of single collections that no second class has are dropped first;
    only the others are paired up into keys.  Rows are dealt by ranges of
    (key, class), so a key that a third of all classes share is spread over
    many tasks; the runs that ranges cut are joined up by their first members.
Links
    First each member of a run is offered the run's first member.  Buckets
    that still touch two components are *open*: their rows meet in salted
    sub-blocks, where rows outside the largest component are compared with the
    others.  A pair may link if the sizes fit and enough bits of two sketches of 256
    one-bit minhashes agree (at the threshold one pair in 10^5 has fewer); it
    counts only in the table of the first two collections that agree.  Rows
    without such a pair leave; whole sets come to the blocks of the others, where all
    their pairs are confirmed in place.  A block gives back only links that join two
    components, never more than it has rows, since only components are asked for.

Input ``(id, text)``; other columns are ignored.  Result: one row per input
row with ``n_shingles`` (0 for null, empty or blank texts), ``component`` (least
id reachable by links, itself included) and ``kept`` (id = component).
Repeated rows and ids are of one component if their sets are equal and not
empty; a row with a null id gets the least non-null id of its component, else
null, and is not kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import sys
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrove.llm.common import bits_of, doc_groups, mix64, rand64, space_words, stage, utf8
from pagegrove.llm.graph import block_links, components
from pagegrove.llm.jaccard_tree import digest, shingle_sets, verified

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLLECTIONS, ROWS = 12, 2
#: Minhashes of one bit in the sketch that rules pairs out; rows of one sub-block of an open bucket; tables' numbers in a key's low bits.
BITS, BLOCK, TABLE_BITS = 256, 2000, 10
#: Bits of the filter that the second scan of the texts uses, at most (128 MB); what it lets through is joined exactly.
MOST_FILTER_BITS = 30
CHUNK_CELLS = 1 << 20


def miss(similarity: float, collections: int = COLLECTIONS, rows: int = ROWS) -> float:
    """The probability that fewer than two collections agree."""
    p = similarity ** rows
    return (1 - p) ** collections + collections * p * (1 - p) ** (collections - 1)


def agreement(similarity: float, hashes: int = BITS, lost: float = 1e-5) -> int:
    """The most one-bit minhashes that may be asked to agree so that at most ``lost`` of the pairs at ``similarity`` have fewer."""
    similarity = (1 + similarity) / 2  # others agree by chance half the time
    total, k = 0.0, 0
    while k < hashes:
        total += comb(hashes, k) * similarity ** k * (1 - similarity) ** (hashes - k)
        if total > lost:
            break
        k += 1
    return k


# ---- sketches ------------------------------------------------------------

def minhashes(sets: list[np.ndarray], hashes: int, seed: int = 1313) -> np.ndarray:
    """A row of 32-bit minhashes for each non-empty set; tokens are uniform already, so odd factors permute them."""
    toks, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    factor = rand64(hashes, seed) | np.uint64(1)
    out = np.empty((len(sets), hashes), np.uint32)
    with np.errstate(over="ignore"):
        for h in range(hashes):
            out[:, h] = np.minimum.reduceat(((toks * factor[h]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def bit_sketch(sets: list[np.ndarray]) -> np.ndarray:
    """``BITS`` one-bit minhashes for each set, as 64-bit words; a bit is the parity of a mixed minhash."""
    low = mix64(minhashes(sets, BITS, 4242).astype(np.uint64) + np.uint64(1)) & np.uint64(1)
    return np.packbits(low.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def _scan(width: int, hashes: int):
    """Rows ``(id, n, cid, sketch)``; the sketch with a class's first row in the task only."""
    def run(batches):
        words, seen = space_words(), set()
        for b in batches:
            data, off = utf8(b.column("text"))
            for i, j in doc_groups(off):
                sets = shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i], width, words)
                cids = [digest(x) if len(x) else None for x in sets]
                sketch = [None] * len(sets)
                new = [k for k, c in enumerate(cids) if c is not None and not (c in seen or seen.add(c))]
                if new:
                    for k, row in zip(new, minhashes([sets[k] for k in new], hashes), strict=True):
                        sketch[k] = row.tobytes()
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array([len(x) for x in sets], pa.int64()), pa.array(cids, pa.int64()),
                                                  pa.array(sketch, pa.binary())], ["id", "n", "cid", "sketch"])
    return run


def _matrix(col: pa.Array, kind=np.uint32) -> np.ndarray:
    rows = col.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _collections(collections: int, rows: int):
    """``(value, place, cid)``: the collections of each class, each as one number."""
    def run(batches):
        salt = rand64(collections * rows, 77) | np.uint64(1)
        for b in batches:
            if not b.num_rows:
                continue
            s = _matrix(b.column("sketch")).astype(np.uint64)
            with np.errstate(over="ignore"):
                value = mix64(((s + np.uint64(1)) * salt).reshape(len(s), collections, rows).sum(2, dtype=np.uint64) + rand64(collections, 5))
            yield pa.RecordBatch.from_arrays([pa.array(value.ravel().view(np.int64)), pa.array(np.tile(np.arange(collections, dtype=np.int32), len(s))),
                                              pa.array(np.repeat(b.column("cid").to_numpy(), collections))], ["value", "place", "cid"])
    return run


# ---- runs of equal keys in sorted partitions ------------------------------

def _shared(batches):
    """Rows whose value another row has too, or may have in the partition before or after."""
    names, held, known = ["value", "place", "cid"], None, True
    for b in batches:
        t = b.select(names) if held is None else pa.Table.from_batches([held, b.select(names)]).combine_chunks().to_batches()[0]
        if not t.num_rows:
            continue
        v, cid = t.column("value").to_numpy(), t.column("cid").to_numpy()
        one = np.concatenate(([True], (v[1:] != v[:-1]) | (cid[1:] != cid[:-1])))  # a class may come from several tasks
        t, v = t.filter(pa.array(one)), v[one]
        same = v[1:] == v[:-1]
        before = np.concatenate(([known], same))
        keep = before[:-1] | same
        yield t.slice(0, t.num_rows - 1).filter(pa.array(keep, pa.bool_()))
        held, known = t.slice(t.num_rows - 1), bool(before[-1])
    if held is not None:
        yield held


def _runs(batches):
    """``(key, cid, head)`` of runs of two members or more, and of the partition's first and last run, which ranges may have cut.

    Rows ``(key, null, head)`` name the first members of these two.
    """
    names = ["key", "cid", "head"]

    def rows(key, cid, head):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, cid, head)], names)
    last = head = None
    alone = False  # the last run has one member so far, which is still to be given
    for b in batches:
        key, cid = b.column("key").to_numpy(), b.column("cid").to_numpy()
        if not len(key):
            continue
        if last is None:
            yield rows(key[:1], [None], cid[:1])
        new = np.concatenate(([last is None or key[0] != last], key[1:] != key[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        heads = np.where(at >= 0, cid[np.maximum(at, 0)], head if head is not None else 0)
        if alone and not new[0]:
            yield rows([last], [head], [head])
        follows = np.append(~new[1:], False)
        pick = ~new | follows
        pick[0] |= last is None
        yield rows(key[pick], cid[pick], heads[pick])
        alone = bool(new[-1]) and not pick[-1]
        last, head = int(key[-1]), int(heads[-1])
    if last is not None:
        if alone:
            yield rows([last], [head], [head])
        yield rows([last], [None], [head])


# ---- pairs ---------------------------------------------------------------

def _fit(n, m, num, den):
    return den * np.minimum(n, m) >= num * np.maximum(n, m)


def _alike(num: int, den: int, agree: int):
    """Pairs ``(a, b)`` whose sizes and sketches allow a link."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b.column("x"), np.uint64), _matrix(b.column("y"), np.uint64)
                same = BITS - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                keep = pa.array((same >= agree) & _fit(b.column("n").to_numpy(), b.column("m").to_numpy(), num, den), pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])
    return run


def first_table(x: np.ndarray, y: np.ndarray, rows: int) -> np.ndarray:
    """For each two rows of minhashes the number of the table of the first two collections that agree (-1: none)."""
    same = (x == y).reshape(len(x), x.shape[1] // rows, rows).all(2)
    n = same.shape[1]
    i = same.argmax(1)
    rest = same & (np.arange(n)[None, :] > i[:, None])
    return np.where(rest.any(1), i * n + rest.argmax(1), -1)


def block_pairs(table: int, n, root, sketch, bits, rows: int, num: int, den: int, agree: int):
    """Places ``(x, y)`` of pairs of two components in one block that may link and belong to its table."""
    _, which, size = np.unique(root, return_inverse=True, return_counts=True)
    small = np.flatnonzero(which != size.argmax())  # a pair of two components has one member outside the largest
    out = [np.zeros((2, 0), np.int64)]
    step = max(1, CHUNK_CELLS // len(n))
    for s in range(0, len(small), step):
        x = small[s:s + step]
        same = np.full((len(x), len(n)), BITS, np.int16)
        for w in range(bits.shape[1]):
            same -= np.bitwise_count(bits[x, w][:, None] ^ bits[:, w][None, :])
        ok = (same >= agree) & (which[x][:, None] != which[None, :]) & _fit(n[x][:, None], n[None, :], num, den)
        i, y = np.nonzero(ok)
        x = x[i]
        own = first_table(sketch[x], sketch[y], rows) == table
        out.append(np.stack([x[own], y[own]]))
    return np.concatenate(out, axis=1)


def _blocks(rows: int, num: int, den: int, agree: int, confirm: bool):
    """Of all blocks ``(key, i, j)`` of a partition sorted by them the rows with a pair that may link, or links ``(a, b)``; one block is held at a time."""
    names = ["key", "i", "j", "cid", "root"]

    def done(held, key):
        t = pa.Table.from_batches(held).combine_chunks()
        col = lambda c: t.column(c).to_numpy()
        chunk = lambda c: t.column(c).combine_chunks()
        x, y = block_pairs(key & ((1 << TABLE_BITS) - 1), col("n"), col("root"), _matrix(chunk("sketch")), _matrix(chunk("bits"), np.uint64), rows, num, den, agree)
        if not confirm:
            stay = np.unique(np.concatenate([x, y]))
            return t.select(names).take(pa.array(stay)).combine_chunks().to_batches()
        toks = [np.frombuffer(v, np.uint64) for v in t.column("toks").to_pylist()]
        links = np.array(block_links(x, y, col("root"), toks, num, den), np.int64).reshape(-1, 2)
        return [pa.RecordBatch.from_arrays([pa.array(col("cid")[links[:, k]]) for k in (0, 1)], ["a", "b"])]

    def run(batches):
        held, now = [], None
        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([b.column(c).to_numpy() for c in ("key", "i", "j")])
            cut = np.concatenate(([0], np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1, [b.num_rows]))
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                this = tuple(at[:, s].tolist())
                if held and this != now:
                    yield from done(held, now[0])
                    held = []
                now = this
                held.append(b.slice(s, e - s))
        if held:
            yield from done(held, now[0])
    return run


# ---- the sets of candidate classes ----------------------------------------

def filter_of(cids: DataFrame, count: int) -> np.ndarray:
    """A bitmap of at most 2^30 bits (16 for each class until then) with the bits of all classes; words come summed up by Spark."""
    bits = min(1 << MOST_FILTER_BITS, bits_of(16 * max(count, 64)))
    slot = F.col("cid").bitwiseAND(bits - 1)
    words = cids.groupBy(F.shiftright(slot, 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(31).cast("int"))).alias("v"))
    out = np.zeros(bits >> 5, np.uint32)
    for r in words.toLocalIterator():
        out[r.w] = r.v
    return out


def _tokens(width: int, hashes: int, wanted):
    """``(cid, n, toks, sketch, bits)`` of classes that the filter lets through, once per task."""
    def run(batches):
        marks, words, seen = wanted.value, space_words(), set()
        for b in batches:
            data, off = utf8(b.column("text"))
            for i, j in doc_groups(off):
                cid, toks = [], []
                for x in shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i], width, words):
                    if not len(x) or (c := digest(x)) in seen:
                        continue
                    slot = c & ((len(marks) << 5) - 1)
                    if marks[slot >> 5] >> np.uint32(slot & 31) & np.uint32(1):
                        seen.add(c)
                        cid.append(c)
                        toks.append(x)
                if cid:
                    raw = [[v.tobytes() for v in rows] for rows in (toks, minhashes(toks, hashes), bit_sketch(toks))]
                    yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array([len(x) for x in toks], pa.int64()), *(pa.array(v, pa.binary()) for v in raw)],
                                                     ["cid", "n", "toks", "sketch", "bits"])
    return run


# ---- the join ------------------------------------------------------------

def near_duplicates(docs: DataFrame, width: int = 3, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
                    collections: int = COLLECTIONS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """``(id_col, n_shingles, component, kept)`` for every row of ``docs``; see the module's text."""
    spark = docs.sparkSession
    hashes = collections * rows
    agree = agreement(num / den)
    if collections**2 > 1 << TABLE_BITS:
        raise ValueError(f"at most {1 << (TABLE_BITS // 2)} collections")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scan = stage(texts.mapInArrow(_scan(width, hashes), "id long, n long, cid long, sketch binary"), "minhash-scan")
    ids = scan.select("id", "n", "cid")
    classes = scan.where("sketch is not null").select("cid", "n", "sketch")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), classes.count() * collections // 1_000_000 + 1)

    values = classes.mapInArrow(_collections(collections, rows), "value long, place int, cid long")
    shared = values.repartitionByRange(parts, "value", "cid").sortWithinPartitions("value", "cid").mapInArrow(_shared, "value long, place int, cid long")
    own = shared.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("c"))
    in_low = (1 << TABLE_BITS) - 1
    number = lambda x, y: F.xxhash64(x["value"], y["value"]).bitwiseAND(~in_low).bitwiseOR((x["place"] * collections + y["place"]).cast("long"))
    paired = F.flatten(F.transform("c", lambda x, k: F.transform(F.slice("c", k + 2, collections), lambda y: number(x, y))))
    keys = stage(own.select("cid", F.explode(paired).alias("key")), "minhash-keys")
    found = stage(keys.repartitionByRange(parts, "key", "cid").sortWithinPartitions("key", "cid").mapInArrow(_runs, "key long, cid long, head long"), "minhash-tables")
    table = found.where("cid is not null")
    cut = found.where("cid is null").groupBy("key").agg(F.collect_set("head").alias("heads")).where("size(heads) > 1")
    cut = cut.select(F.array_min("heads").alias("a"), F.explode("heads").alias("b"))
    pairs = table.select(F.least("head", "cid").alias("a"), F.greatest("head", "cid").alias("b")).union(cut).where("a != b").distinct()

    near = stage(table.select("cid").distinct(), "minhash-near")
    wanted = spark.sparkContext.broadcast(filter_of(near, near.count()))
    sets = texts.mapInArrow(_tokens(width, hashes, wanted), "cid long, n long, toks binary, sketch binary, bits binary").join(near, "cid", "left_semi")
    sets = stage(sets.dropDuplicates(["cid"]), "minhash-sets")

    side = lambda cid, n, bits: sets.select(F.col("cid").alias(cid), F.col("n").alias(n), F.col("bits").alias(bits))
    alike = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    alike = stage(alike.mapInArrow(_alike(num, den, agree), "a long, b long"), "minhash-pairs")
    both = alike.select("a").union(alike.select("b")).distinct().withColumnRenamed("a", "cid")
    links = verified(alike, sets.select("cid", "toks").join(both, "cid", "left_semi"), num, den, "minhash-links")
    label = components(links, "minhash-wave")

    rooted = table.select("key", "cid").join(label.withColumnRenamed("v", "cid"), "cid", "left").select("key", "cid", F.coalesce("root", "cid").alias("root"))
    opened = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size")).where("r0 != r1")
    rest = rooted.join(opened.select("key", F.ceil(F.col("size") / block).alias("salts")), "key")
    rest = rest.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("salts"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    rest = rest.select("key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "cid", "root")

    def dealt(rows: DataFrame, *cols: str) -> DataFrame:
        """Rows in their blocks, with columns of their sets."""
        return rows.join(sets.select("cid", *cols), "cid").select("key", "i", "j", "cid", "root", *cols).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    hopeful = dealt(rest, "n", "sketch", "bits").mapInArrow(_blocks(rows, num, den, agree, False), "key long, i long, j long, cid long, root long")
    hopeful = stage(hopeful, "minhash-open")
    last = dealt(hopeful, "n", "sketch", "bits", "toks").mapInArrow(_blocks(rows, num, den, agree, True), "a long, b long")
    links = stage(links.union(last), "minhash-links")
    label = components(links, "minhash-wave")

    least = ids.where("cid is not null").groupBy("cid").agg(F.min("id").alias("least"))
    least = least.join(label.withColumnRenamed("v", "cid"), "cid", "left").select("cid", "least", F.coalesce("root", "cid").alias("root"))
    roots = least.groupBy("root").agg(F.min("least").alias("component"))
    out = ids.join(least.join(roots, "root").select("cid", "component"), "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
