"""Signature-tree join and spaced seeds against brute force."""

import random
import re
from itertools import combinations

import numpy as np

from pagegrove.llm import jaccard_tree, spaced_seeds
from pagegrove.llm.graph import components


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(rows, k=4, num=85, den=100):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and den * len(x & y) >= num * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    groups = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            groups[find(a)] = min(groups.get(find(a), i), i)
    return sorted((i, len(s), groups.get(find(a)) if s else i) for a, (i, s) in enumerate(sets) if i is not None)


def corpus(prose):
    r = random.Random(3)
    rows = [(i, prose(i, r.choice([1, 2, 3, 5, 30, 80, 200]))) for i in range(60)]
    for g in range(6):  # groups of near copies around the threshold
        base = prose(1000 + g, 150).split()
        for _ in range(12):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = f"x{r.random()}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, "a b") for i in range(4)] + [(200 + i, t) for i, t in enumerate(["", None, " \n\t", "A B", "one"])]
    return rows + [(7, rows[7][1]), (300, prose(5, 5000)), (301, prose(5, 5000).upper())]


def test_jaccard_matches_brute_force(docs_of, prose):
    rows = corpus(prose)
    for block_rows, tree_rows in ((100_000, 3000), (3, 4)):  # the second salts nearly every shingle and every cluster
        got = jaccard_tree.jaccard_components(docs_of(rows, extra=True), block_rows=block_rows, tree_rows=tree_rows)
        got = sorted((r.doc_id, r.n_shingles, r.component) for r in got.collect())
        assert got == sorted(brute(rows))


def test_jaccard_other_thresholds_and_edges(docs_of, prose):
    rows = corpus(prose)
    got = jaccard_tree.jaccard_components(docs_of(rows), width=5, num=80, den=100)
    assert sorted((r.doc_id, r.n_shingles, r.component) for r in got.collect()) == sorted(brute(rows, 5, 80, 100))
    assert jaccard_tree.jaccard_components(docs_of([])).count() == 0
    got = jaccard_tree.jaccard_components(docs_of([(None, "a b c d e"), (4, "a b c d e"), (None, ""), (None, "q")])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component or -1) for r in got) == [(-1, 0, -1), (-1, 1, -1), (-1, 2, 4), (4, 2, 4)]


def test_tree_traversal_loses_no_pair():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 62, 3000).astype(np.uint64)
    sets = [np.unique(r.choice(base[k % 5 * 500:k % 5 * 500 + 110], int(r.integers(95, 110)), replace=False)) for k in range(150)]
    n, cid, comp = np.array([len(s) for s in sets]), np.arange(150), np.arange(150)
    sigs = [jaccard_tree.signature(s, 1024) for s in sets]
    got = set(zip(*(x.tolist() for x in jaccard_tree.block_pairs(cid, n, np.zeros(150, np.int64), comp, sigs, 85, 100)), strict=True))
    got = {(min(p), max(p)) for p in got}
    for a, b in combinations(range(150), 2):
        o = len(np.intersect1d(sets[a], sets[b]))
        if 100 * o >= 85 * (n[a] + n[b] - o):
            assert (a, b) in got
    assert len(got) < 150 * 149 / 2 / 3
    assert jaccard_tree.block_pairs(cid, n, np.zeros(150, np.int64), np.zeros(150, np.int64), sigs, 85, 100).shape[1] == 0


def test_tree_traversal_of_low_thresholds():
    sets = [np.unique(jaccard_tree.rand64(size, 1000 * k)) for k in range(40) for size in (100, 390)]  # Jaccard 100 / 390 in each two
    n = np.array([len(x) for x in sets])
    sigs = [jaccard_tree.signature(s, 1 << (4 * len(s) - 1).bit_length()) for s in sets]
    cid, pos = np.arange(80), np.zeros(80, np.int64)
    assert len({len(x) for x in sigs}) == 2 and max(map(len, sigs)) == 4 * min(map(len, sigs))
    a, b = jaccard_tree.block_pairs(cid, n, pos, cid, sigs, 1, 4)
    assert {(2 * k, 2 * k + 1) for k in range(40)} <= set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (105, 100), (7, 7), (200, 150), (150, 200)]
    got = {r.v: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[105] == got[101] == 100 and got[200] == 150
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_counts_beyond_a_full_table(docs_of, prose, monkeypatch):
    """Tables of two bytes a slot are given out when a slot is full; the sums are those of all rows."""
    import pyarrow as pa

    monkeypatch.setattr(jaccard_tree, "COUNT_MOST", 3)
    texts = pa.array([prose(i % 7, 30) for i in range(40)] + ["", None])
    none = pa.StructArray.from_arrays([pa.array([0] * 42, pa.int32())], ["none"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(42)), texts, none], ["id", "text", "kept"])
    out = pa.Table.from_batches(list(jaccard_tree._scan(4)(iter([batch, batch]))))
    assert out.column("id").drop_null().to_pylist() == [*range(42)] * 2
    parts = out.filter(pa.compute.is_valid(out.column("part"))).select(["part", "counts"]).to_batches()
    sums = pa.Table.from_batches(list(jaccard_tree._sum_counts(iter(parts)))).to_pylist()
    assert sum(r["total"] for r in sums) == 2 * 40 * 27
    assert sorted({x for r in sums for x in r["steps"] if x}) == [10, 12]  # of 40 rows, texts 0 to 4 have six and the others five, twice


def test_parts_of_a_graph():
    r = np.random.default_rng(4)
    for edges in (0, 5, 60, 150, 4000):
        a, b = r.integers(0, 200, (2, edges))
        want = list(range(200))
        for _ in range(200):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                want[x] = want[y] = min(want[x], want[y])
        assert jaccard_tree.first_of_part(a, b, 200).tolist() == want


def test_whole_sets_go_only_where_bitmaps_let_classes_link(docs_of, prose, monkeypatch):
    common = [prose(50 + k, 20) for k in range(10)]
    rows = [(i, " ".join([prose(900 + i // 2, 40), *(common[(i // 2 + 5 * (i % 2) + k) % 10] for k in range(4))])) for i in range(60)]  # two share rare words, which opens blocks but links nothing
    rows += [(100 + i, " ".join([*prose(7, 150).split()[:-1], f"x{i}"])) for i in range(4)]
    tables = {}

    def kept(df, name, put=jaccard_tree.stage):
        tables[name] = out = put(df, name)
        return out
    monkeypatch.setattr(jaccard_tree, "stage", kept)
    got = jaccard_tree.jaccard_components(docs_of(rows), width=5, num=55, den=100)
    assert sorted((r.doc_id, r.n_shingles, r.component) for r in got.collect()) == sorted(brute(rows, 5, 55, 100))
    assert tables["jaccard-clusters-leaves"].select("cid").distinct().count() >= 30
    assert tables["jaccard-near-leaves"].count() == 0


def test_marks_tell_rows_that_a_join_cannot_touch(spark):
    from pagegrove.llm.common import key_marks, where_marked

    keys = [f"k{i}" for i in range(0, 3000, 3)]
    df = spark.createDataFrame([(f"k{i}" if i % 7 else None, i, "x") for i in range(3000)], "key string, part long, words string")
    marks = key_marks(spark.createDataFrame([(k,) for k in keys * 2], "key string"))
    marked, apart = (where_marked(df, "key", marks, m) for m in (True, False))
    assert marked.columns == df.columns == apart.columns and "Exchange hash" not in apart._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    have, rest = {r.part for r in marked.collect()}, {r.part for r in apart.collect()}
    assert not have & rest and have | rest == set(range(3000))
    assert {i for i in range(0, 3000, 3) if i % 7} <= have and len(have) < 900 and {i for i in range(0, 3000, 7)} <= rest
    assert marks.count() <= 4096 and {len(r.words) for r in marks.collect()} == {64}
    none = key_marks(spark.createDataFrame([], "key long"))
    assert where_marked(df, "part", none).count() == 0 and where_marked(df, "part", none, False).count() == 3000


def words_of(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def brute_leaks(docs, items, overlap=14, identity=0.75):
    out = set()
    for i, t in docs:
        d = words_of(t)
        for k, u in items:
            w = words_of(u)
            m = min(overlap, len(w))
            if w and any(sum(d[p + q] == w[s + q] for q in range(m)) >= (identity if len(w) >= 8 else 1) * m for p in range(len(d) - m + 1) for s in range(len(w) - m + 1)):
                out.add((i, k))
    return out


def test_spaced_seeds(spark, docs_of, prose):
    items = [(k, prose(50 + k, n)) for k, n in enumerate([9, 14, 30, 60, 7])] + [(9, None), (10, ""), (2, prose(52, 30))]
    docs = [(i, prose(i, 120)) for i in range(20)] + [(90, ""), (91, None), (92, prose(3, 20_000))]
    r = random.Random(1)
    for i, (k, t) in enumerate(items[:5] * 4):
        w = t.split()
        for _ in range(i // 5):  # up to three substituted words
            w[r.randrange(len(w))] = "zz"
        docs.append((100 + i, prose(i, 40) + " -- " + ", ".join(w).title() + "! " + prose(i + 1, 40)))
    docs.append((150, prose(1, 30) + " " + " ".join(items[2][1].split()[:6]) + " " + prose(2, 30)))  # a short fragment only
    docs.append((100, docs[23][1]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = spaced_seeds.document_matches(docs_of(docs, extra=True), bench).collect()
    want = brute_leaks(docs, items)
    found = {(r.doc_id, r.item_id) for r in got}
    assert found <= want and len(want - found) <= 1  # one that no mask's window hits may be missed
    assert (150, 2) not in {(r.doc_id, r.item_id) for r in got} and {r.doc_id for r in got} >= {100, 101, 102, 103}
    assert sum(r.doc_id == 100 for r in got) == 2  # the repeated row has its own
    assert spaced_seeds.document_matches(docs_of([]), bench).count() == 0
    assert spaced_seeds.document_matches(docs_of(docs), bench.limit(0)).count() == 0


def test_short_items_are_found(spark, docs_of, prose):
    r = random.Random(7)
    items = [(n, prose(900 + n, n)) for n in range(1, 14)] + [(50, ".,;"), (51, prose(901, 1) + " " + prose(902, 2))]
    docs = [(i, prose(i, 60)) for i in range(30)]
    for n, t in items:
        for subs in range(4):
            for _ in range(3):
                w = t.split()
                for k in r.sample(range(len(w)), min(subs, len(w))):
                    w[k] = f"zz{k}"
                docs.append((len(docs), prose(5, 20) + " " + " ".join(w) + "; " + prose(6, 20)))
    docs += [(len(docs), items[5][1]), (len(docs) + 1, ""), (len(docs) + 2, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in spaced_seeds.document_matches(docs_of(docs), bench).collect()}
    assert got == brute_leaks(docs, items) and {k for _, k in got} >= set(range(1, 14))


def recall(n, subs, overlap=14, identity=0.75):
    """Of all placements of substitutions in an item of n words that still count, those that leave a window of some mask whole."""
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in spaced_seeds.masks_of(n)]
    m = min(overlap, n)
    found = total = 0
    for bad in combinations(range(n), subs):
        if any(m - sum(s <= b < s + m for b in bad) >= identity * m for s in range(n - m + 1)):
            total += 1
            found += any(not {p + i for i in take} & set(bad) for take in masks for p in range(n - take[-1]))
    return found / total if total else None


def test_recall_of_substituted_passages():
    for n in range(8, 25):
        m = min(14, n)
        for subs in range(0, m - -(-3 * m // 4) + 1):
            assert recall(n, subs) >= (1 if n < 14 or n >= 20 else 0.95), (n, subs)


def test_stretches_with_the_same_first_word_are_kept_apart(spark, docs_of, prose):
    items = [(1, prose(70, 10)), (2, prose(71, 40))]
    docs = [(i, items[0][1] + " " + prose(80 + i, 18, 10**6) + " " + items[1][1]) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = spaced_seeds.document_matches(docs_of(docs), bench, overlap=40, identity=1.0).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, k) for i in range(12) for k in (1, 2)}


def test_verified_partners_are_not_called_links(docs_of):
    assert jaccard_tree.jaccard_components(docs_of([(1, "a b c d e")])).columns == ["doc_id", "n_shingles", "component", "n_verified"]
