"""Variable-capacity best-fit packing (operator 9).

Packs documents into training sequences of several permitted lengths.  A
document longer than the largest length is cut into pieces (no token is
lost); whole-length pieces fill a sequence each.  All other pieces go through
best-fit-decreasing, largest first: a piece goes to the open bin that it
leaves the least room in; if none has room, a bin of the size is opened that
costs least per token it can be expected to hold, given all pieces that are
still to come (so the sizes are chosen jointly).  At the end each bin shrinks
to the smallest permitted length that holds its contents.

At scale: only ids and lengths are shuffled.  Pieces are dealt evenly, not by
a key, into shards of at most about ``SHARD`` pieces, and each shard is packed
on its own; what that loses is at most some part-filled bins per shard.

Null ids are packed like others; a null length counts as 0 and a length of 0
takes no room but keeps its place in a bin.  Repeated rows are packed each.
No rows give no bins.  Other columns are never read.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrove.llm.common import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITIES = (256, 512, 1024, 2048)
SHARD = 20_000
#: Tokens at which attention costs as much as everything else.
HALF_COST = 8192


def cost(capacity: int) -> float:
    """What a sequence costs: linear work and attention, which grows with the square."""
    return capacity * (1 + capacity / HALF_COST)


def best_fit(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES) -> tuple[np.ndarray, list[int]]:
    """``(bin of each piece, final capacity of each bin)``; lengths must not exceed the largest capacity."""
    caps = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order].tolist()
    tail = np.concatenate((np.cumsum(lengths[order][::-1])[::-1], [0])).tolist()  # tokens from here on
    rising = lengths[order][::-1]
    room: list[list[int]] = [[] for _ in range(caps[-1] + 1)]  # bins by the room they have left
    full = 0  # bit r: some bin has r left
    bin_of, left, cap_of = [0] * len(size), [], []
    for k, n in enumerate(size):
        fits = full >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                full &= ~(1 << r)
        else:
            def per_token(c, n=n, k=k):
                first = max(k + 1, len(size) - int(np.searchsorted(rising, c - n, side="right")))
                return cost(c) / max(1, min(c, n + tail[first]))
            c = min((c for c in caps if c >= n), key=lambda c: (per_token(c), c))
            b, r = len(left), c
            left.append(c)
            cap_of.append(c)
        bin_of[k] = b
        left[b] = r - n
        room[left[b]].append(b)
        full |= 1 << left[b]
    out = np.zeros(len(size), np.int64)
    out[order] = bin_of
    used = np.bincount(out, weights=lengths, minlength=len(left)).astype(np.int64) if len(size) else np.zeros(0, np.int64)
    return out, [next(c for c in caps if c >= u) for u in used.tolist()]


def _pack_shard(capacities):
    def run(batches):
        parts = [b.to_pandas() for b in batches]
        if not parts:
            return
        import pandas as pd
        t = pd.concat(parts, ignore_index=True).sort_values(["length", "id", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        shard = TaskContext.get().partitionId()
        bin_of, cap = best_fit(t["length"].to_numpy(np.int64), capacities)
        order = np.argsort(bin_of, kind="stable")
        at = np.searchsorted(bin_of[order], np.arange(len(cap) + 1))
        ids = pa.array(t["id"], pa.int64(), from_pandas=True).take(pa.array(order))
        start, length = t["start"].to_numpy(np.int64)[order], t["length"].to_numpy(np.int64)[order]
        lists = lambda x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), x)
        used = np.add.reduceat(length, at[:-1])
        yield pa.RecordBatch.from_arrays([
            pa.array(shard * (1 << 32) + np.arange(len(cap), dtype=np.int64)), pa.array(cap, pa.int64()), pa.array(used),
            lists(ids), lists(pa.array(start)), lists(pa.array(length))], ["bin_id", "capacity", "used", "doc_ids", "starts", "lengths"])
    return run


BINS = "bin_id long, capacity long, used long, doc_ids array<long>, starts array<long>, lengths array<long>"


def pack(items: DataFrame, id_col: str = "doc_id", length: Column | str = "length", capacities: Sequence[int] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """Bins ``(bin_id, capacity, used, doc_ids, starts, lengths)``; entry i of the lists is one piece."""
    top = max(capacities)
    n = F.greatest(F.coalesce((F.col(length) if isinstance(length, str) else length).cast("long"), F.lit(0)), F.lit(0))
    rows = items.select(F.col(id_col).cast("long").alias("id"), n.alias("n"))
    last = F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0)).cast("long")
    pieces = rows.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    pieces = stage(pieces.select("id", (F.col("k") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("n") - F.col("k") * top).alias("length")), "pack-pieces")
    whole = pieces.where(F.col("length") == top)
    rest = pieces.where(F.col("length") < top)
    shards = max(1, -(-rest.count() // shard))
    packed = rest.repartition(shards).mapInArrow(_pack_shard(tuple(capacities)), BINS)
    own = whole.select((F.lit(-1) - F.monotonically_increasing_id()).alias("bin_id"), F.lit(top).cast("long").alias("capacity"), F.col("length").alias("used"),
                       F.array("id").alias("doc_ids"), F.array("start").alias("starts"), F.array("length").alias("lengths"))
    return packed.union(own)


def word_length(text_col: str = "text") -> Column:
    """Words by ``[^\\x20\\x09-\\x0D]+`` and one end token."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")) + 1
