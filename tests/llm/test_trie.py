"""The conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np

from pagegrove.llm import conversation_trie as ct


def brute(turns, group=20, most=4):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = tuple(own.get(c - c % group, [])[:h] + x[h:])
    members = defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in cs if built[c] == p)))
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), sum(not kids[q] for q in below), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, turns, **more):
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], "conv_id long, turn long, role string, text string, key string, words string")
    got = ct.trie(ct.rebuild(ct.conversations(df.repartition(4))), **more)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_equals_brute_force(spark):
    r = random.Random(4)
    say = ["hi there", "tell me more", "", None, " \t", "no", "yes , it is", "é 世界 ok"]
    turns = []
    for c in range(130):
        for t in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
            turns.append((c, t, r.choice(["user", "assistant", None, ""]), r.choice(say[:2] if t < 2 else say)))
    turns += [(200, t, "user", "hi there") for t in range(300)] + [(201, 0, "user", "long " * 30_000)]  # very long ones
    turns += [(c, 0, "user", "hi there") for c in range(1000, 1100)]  # equal ones, of several groups
    turns += [(c, t, "user", "hi there") for c in range(2000, 2040) for t in range(2)]
    turns += [(300, None, "user", "first"), (300, -5, "user", "second"), (300, 0, "user", "third"), (None, 0, "user", "nobody's")]
    want = brute(turns)
    assert nodes(spark, turns) == want
    assert nodes(spark, turns, range_rows=7, salts=3) == want


def test_ends_are_digested_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(ct, "PIECE", 40)
    turns = [(c, 0, "user", "same") for c in range(0, 20 * 400, 20)]
    assert nodes(spark, turns) == brute(turns)


def test_edges(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 0, "user", "a")]) == []
    absent = [(41, 0, "user", "a"), (41, 1, "user", "b")]  # conversation 40 is not there
    assert nodes(spark, absent) == brute(absent)
    gone = [(c, 0, "user", "a") for c in range(41, 60)]  # those with h > 0 have no turn left
    got = nodes(spark, gone)
    assert got == brute(gone) and any(x[1] == 0 and x[7] != ct.NO_ENDS for x in got)
    twice = [(0, 0, "user", "a")] * 3 + [(0, 0, "bot", "a")]  # repeated rows are turns, equal turn numbers are put in order
    assert max(x[1] for x in nodes(spark, twice)) == 4


def test_extents_by_binary_search():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 100):
        lcp = r.integers(0, 5, n - 1)
        table = ct.sparse_table(lcp)
        at, depth = np.repeat(np.arange(n), 5), np.tile(np.arange(5), n)
        left, right = ct.leftmost(table, at, depth), ct.rightmost(table, at, depth)
        for i, d, a, b in zip(at, depth, left, right, strict=True):
            assert (lcp[a:i] >= d).all() and (lcp[i:b] >= d).all()
            assert (a == 0 or lcp[a - 1] < d) and (b == n - 1 or lcp[b] < d)
        x = r.integers(0, 1000, n)
        assert (ct.range_min(ct.sparse_table(x), left, right) == [x[a:b + 1].min() for a, b in zip(left, right, strict=True)]).all()
