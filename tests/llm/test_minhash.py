"""Tensored banding against brute force."""

import random
from itertools import combinations

import numpy as np

from pagegrove.llm import minhash_tensor
from pagegrove.llm.common import rand64
from pagegrove.llm.graph import block_links
from tests.llm.test_joins import brute, corpus


def rows_of(df):
    return sorted((r.doc_id, r.n_shingles, r.component) for r in df.collect())


def test_equals_brute_force(spark, docs_of, prose):
    rows = corpus(prose)
    for block in (2000, 3):  # the second salts nearly every open bucket
        got = minhash_tensor.near_duplicates(docs_of(rows, extra=True).repartition(5), block=block)
        assert got.columns == ["doc_id", "n_shingles", "component", "kept"]
        assert rows_of(got) == sorted(brute(rows, 3))
    assert all(r.kept == (r.doc_id == r.component) for r in got.collect())
    assert rows_of(minhash_tensor.near_duplicates(docs_of(rows), width=5, num=80, den=100)) == sorted(brute(rows, 5, 80, 100))


def test_groups_of_near_copies_around_the_threshold(docs_of, prose):
    r, rows = random.Random(9), []
    for g in range(4):
        chain = prose(3000 + g, 120).split()
        for _ in range(60):  # a walk: neighbours link, the ends do not
            chain = list(chain)
            for _ in range(r.randrange(1, 4)):
                chain[r.randrange(len(chain))] = f"y{r.random()}"
            rows.append((len(rows), " ".join(chain)))
    r.shuffle(rows)
    assert rows_of(minhash_tensor.near_duplicates(docs_of(rows).repartition(7), block=16)) == sorted(brute(rows, 3))


def test_edges(docs_of):
    got = minhash_tensor.near_duplicates(docs_of([(None, "a b c d"), (4, "A b c D"), (None, ""), (None, "q"), (9, None), (9, " \t"), (8, "one two"), (7, "one two"), (7, "one two")])).collect()
    key = lambda r: (r.doc_id or -1, r.n_shingles, r.component or -1, r.kept)
    assert sorted(map(key, got)) == sorted([(-1, 2, 4, False), (4, 2, 4, True), (-1, 0, -1, False), (-1, 1, -1, False), (9, 0, 9, True), (9, 0, 9, True),
                                            (8, 1, 7, False), (7, 1, 7, True), (7, 1, 7, True)])
    assert minhash_tensor.near_duplicates(docs_of([])).count() == 0


def test_collections_meet_as_often_as_stated():
    base = rand64(400_000, 1)
    met = agreed = 0
    for k in range(400):
        core, x, y = base[1000 * k:1000 * k + 850], base[1000 * k + 850:1000 * k + 925], base[1000 * k + 925:1000 * k + 1000]
        a, b = minhash_tensor.minhashes([np.concatenate([core, x]), np.concatenate([core, y])], 24)
        agreed += (a == b).sum()
        met += ((a == b).reshape(12, 2).all(1).sum() >= 2)
    assert abs(agreed / 400 / 24 - 0.85) < 0.01 and met == 400
    assert minhash_tensor.miss(0.85) < 7e-6 and minhash_tensor.agreement(0.85) > 200 and minhash_tensor.agreement(1.0) == 256


def test_runs_cut_by_partitions_and_batches_are_whole():
    import pyarrow as pa
    r = random.Random(5)
    rows = sorted({(r.randrange(30), r.randrange(1000)) for _ in range(120)})
    for cuts in ([], [40, 41, 90]):
        out, ends = set(), []
        edge = [0, *cuts, len(rows)]
        for s, e in zip(edge, edge[1:], strict=False):
            part = rows[s:e]
            batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in part[i:i + 3]], pa.int64()), pa.array([x[1] for x in part[i:i + 3]], pa.int64())], ["key", "cid"])
                       for i in range(0, len(part), 3)]
            for b in minhash_tensor._runs(iter(batches)):
                for key, cid, head in zip(*(b.column(c).to_pylist() for c in ("key", "cid", "head")), strict=True):
                    if cid is None:
                        ends.append((key, head))
                    else:
                        assert (key, cid) not in out
                        out.add((key, cid))
                        assert (key, head) in part and head <= cid
        for key in {k for k, _ in rows}:
            members = [c for k, c in rows if k == key]
            assert len(members) == 1 or {c for k, c in out if k == key} == set(members)


def test_blocks_join_what_all_links_would():
    r = np.random.default_rng(4)
    base = rand64(400, 9)
    sets = []
    for _ in range(150):  # a cloud around the threshold
        t = base.copy()
        at = r.choice(400, int(r.integers(5, 60)), replace=False)
        t[at] = r.integers(1, 1 << 62, len(at)).astype(np.uint64)
        sets.append(np.unique(t))
    n, root = np.array([len(t) for t in sets]), np.arange(150) // 2 * 2
    sketch, bits = minhash_tensor.minhashes(sets, 24), minhash_tensor.bit_sketch(sets)
    agree = minhash_tensor.agreement(0.85)

    def parts(pairs):
        up = {int(x): int(x) for x in root}

        def find(x):
            return x if up[x] == x else find(up[x])
        for a, b in pairs:
            x, y = sorted((find(int(root[a])), find(int(root[b]))))
            up[y] = x
        return [find(int(x)) for x in root]
    links = [(a, b) for a, b in combinations(range(150), 2) if 100 * (k := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (n[a] + n[b] - k)]
    tables = {}
    for a, b in links:
        t = int(minhash_tensor.first_table(sketch[[a]], sketch[[b]], 2)[0])
        tables.setdefault(t, []).append((a, b))
    assert -1 not in tables and len(tables) > 2
    every = []
    for t in range(144):
        x, y = minhash_tensor.block_pairs(t, n, root, sketch, bits, 2, 85, 100, agree)
        few = [tuple(sorted(p)) for p in block_links(x[:40], y[:40], root, sets, 85, 100)]
        got = [tuple(sorted(p)) for p in block_links(x, y, root, sets, 85, 100)]
        assert set(got) | set(few) <= set(links) and len(got) < 75
        every += got
    assert parts(every) == parts(links)
    assert minhash_tensor.block_pairs(1, n, np.zeros(150), sketch, bits, 2, 85, 100, agree).shape[1] == 0
