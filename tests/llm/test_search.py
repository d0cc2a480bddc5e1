"""Pair-bound MaxScore against brute force."""

import random
import re
from collections import Counter, defaultdict
from math import floor, log

import numpy as np

from pagegrove.llm import pair_maxscore as pm


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=50):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms_of(t))
    out = []
    for item, terms in asked.items():
        rows = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // n_terms if n_terms else 0
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in terms if b[t])
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(prose, n=400):
    r = random.Random(8)
    rows = [(i, prose(i, r.choice([1, 3, 20, 60, 200]), r.choice([30, 300, 3000]))) for i in range(n)]
    rows += [(900, None), (901, ""), (902, " .,;!"), (903, prose(5, 30_000, 300)), (None, prose(6, 40, 30)), (7, rows[7][1]), (7, rows[8][1])]
    rows += [(1000 + i, "w1 w2 w3, same text; w4 W5") for i in range(80)]  # ties beyond the k-th place
    return rows + [(950, "École über 東京 w1"), (951, "école 東京_über")]


def items_of(prose):
    return [(0, prose(50, 30, 300)), (1, "w1 w2 w3 w4 w5 same text"), (2, None), (3, ""), (4, "nowhere to be found"), (5, "École 東京!"), (6, prose(3, 60, 30)),
            (7, "w1"), (7, "w2"), (8, "W9 w9 w9"), (None, "w3 w4"), (9, prose(51, 200, 3000)), (9, prose(51, 200, 3000))]


def test_equals_brute_force(spark, docs_of, prose, monkeypatch):
    docs, items = corpus(prose), items_of(prose)
    bench = spark.createDataFrame([(*x, "x", "y") for x in items], "item_id long, text string, term string, score string")
    want = brute(docs, items)
    assert found(pm.search(docs_of(docs, extra=True), bench)) == want
    monkeypatch.setattr(pm, "SHARD_DOCS", 20)  # many shards a task, so that thresholds rise
    monkeypatch.setattr(pm, "SEED_SHARDS", 3)
    assert found(pm.search(docs_of(docs).repartition(5), bench, block_terms=100)) == want
    assert found(pm.search(docs_of(docs).coalesce(1), bench, k=3)) == brute(docs, items, 3)


def test_edges(spark, docs_of):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert found(pm.search(docs_of([]), bench)) == []
    assert found(pm.search(docs_of([(1, "a")]), bench.limit(0))) == []
    assert found(pm.search(docs_of([(1, None), (2, "")]), bench)) == []
    everywhere = [(i, "a") for i in range(3)]  # weight of a term in all documents
    assert found(pm.search(docs_of(everywhere), bench)) == brute(everywhere, [(1, "a b")])


def test_skipping_loses_nothing_and_pairs_tighten_bounds():
    r = np.random.default_rng(1)
    tighter = 0
    for _ in range(60):
        n_docs, n_terms = 200, 12
        lists = [np.sort(r.choice(n_docs, r.integers(1, 60), replace=False)).astype(np.int32) for _ in range(n_terms)]
        impacts = [r.integers(1, 1000, len(x)) for x in lists]
        shard = object.__new__(pm.Shard)
        shard.doc, shard.impact = np.concatenate(lists), np.concatenate(impacts)
        shard.first = np.cumsum([0, *map(len, lists)])
        shard.slot, shard.most = np.arange(n_terms), np.array([x.max() for x in impacts])
        a, b = np.arange(n_terms - 1), np.arange(1, n_terms)
        both = [np.intersect1d(lists[x], lists[y]).astype(np.int32) for x, y in zip(a, b, strict=True)]
        full = np.zeros((n_terms, n_docs), np.int64)
        for t in range(n_terms):
            full[t, lists[t]] = impacts[t]
        shard.pair_doc, shard.pair_first = np.concatenate(both), np.cumsum([0, *map(len, both)])
        shard.pair_slot = np.array([k if len(x) else -1 for k, x in enumerate(both)])
        shard.joint = np.array([(full[x, d] + full[y, d]).max() if len(d) else 0 for x, y, d in zip(a, b, both, strict=True)])
        exact = full.sum(0)
        bounds = sum(u[0] for u in pm.units_of(shard, np.arange(n_terms), np.arange(n_terms - 1), a, b))
        assert exact.max() <= bounds <= shard.most.sum()
        tighter += bounds < shard.most.sum()
        for threshold in (1, int(np.median(exact)), int(np.sort(exact)[-5]), int(exact.max()), int(exact.max()) + 1):
            work = np.zeros(n_docs, np.int64)
            docs, score = pm.search_shard(shard, np.arange(n_terms), np.arange(n_terms - 1), a, b, max(1, threshold), work)
            assert dict(zip(docs.tolist(), score.tolist(), strict=True)) == {d: s for d, s in enumerate(exact.tolist()) if s >= max(1, threshold)}
            assert not work.any()
    assert tighter > 30
