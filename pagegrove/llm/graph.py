"""Connected components of an edge table by alternating star contractions, and links of one block that join components."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrove.llm.common import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pairs for each row of a block up to which they are confirmed one by one.
FEW_PAIRS = 4


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(v, root)`` for every vertex of ``edges(a, b)``; root = its component's least vertex.

    Each round links all larger neighbours of a vertex to its least neighbour
    and then all smaller ones, which at least halves path lengths; edges
    never grow in number and no neighbour list is gathered anywhere.  A round
    is staged, so its lineage stays short.  No edges give no rows; loops and
    repeated edges do not matter.
    """
    def low(df: DataFrame) -> DataFrame:
        return df.groupBy("u").agg(F.min("v").alias("m"))

    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), name)
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = low(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.join(low(large), "u")
        e = stage(small.select("u", F.col("m").alias("v")).union(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
                  .distinct(), name)
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = e.select(F.col("v")).distinct()
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).union(roots.select("v", F.col("v").alias("root")))


def block_links(x: np.ndarray, y: np.ndarray, root: np.ndarray, toks: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Of the pairs ``(x, y)`` links that join up components as far as all links would; confirmed on whole sets."""
    up = {int(r): int(r) for r in root}

    def find(r):
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    def join(i, j):
        a, b = find(int(root[i])), find(int(root[j]))
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((i, j))
    out: list[tuple[int, int]] = []
    if len(x) <= FEW_PAIRS * len(toks):
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            if find(int(root[i])) != find(int(root[j])):
                both = len(np.intersect1d(toks[i], toks[j], assume_unique=True))
                if den * both >= num * (len(toks[i]) + len(toks[j]) - both):
                    join(i, j)
        return out
    size = np.array([len(t) for t in toks])
    code, count = np.unique(np.concatenate(toks), return_inverse=True, return_counts=True)[1:]
    shared = np.cumsum(count > 1) - 1  # a column for each token of two rows
    row = np.repeat(np.arange(len(toks)), size)
    keep = count[code] > 1
    row, col = row[keep], shared[code[keep]]
    left, at = np.unique(x, return_inverse=True)
    place = np.full(len(toks), -1)
    place[left] = np.arange(len(left))
    both = np.zeros((len(left), len(toks)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for s in range(0, int(shared[-1]) + 1, 2048):
        a, b = np.searchsorted(col, [s, s + 2048])
        m = np.zeros((len(toks), 2048), np.float32)
        m[row[a:b], col[a:b] - s] = 1
        both += m[left] @ m.T
    found = both[at, y].astype(np.int64)
    for k in np.flatnonzero(den * found >= num * (size[x] + size[y] - found)).tolist():
        join(int(x[k]), int(y[k]))
    return out
