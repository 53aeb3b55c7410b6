"""Prefix trie and its centroid rollup against a plain trie."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from panelworks.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs string, top_conv long"


def expected(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (*t[:2], t[2].encode(), t[3].encode()))] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        whole = own.get(c - c % 5, [])[:h] + own[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    out = {}
    for node, found in sorted(members.items(), key=lambda m: -len(m[0])):
        below = [out[n] for n in out if len(n) == len(node) + 1 and n[: len(node)] == node]
        saved = (len(found) - 1) * len(node[-1][1].encode()) if node else 0
        parent = members[node[:-1]][0] if node else None
        leaves, tokens = sum(b[5] for b in below), sum(b[6] for b in below)
        sha = hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest()
        out[node] = (found[0], len(node), parent, len(found), len(below), leaves or 1, saved + tokens, sha)
    return sorted(out.values())


def _rows(seed=1, convs=120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), convs):
        first = rng.choice(["hello", "hello", "hi", "größer"])
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", first if t == 0 else rng.choice(["yes", "no", "ok"])) for t in range(rng.choice([1, 2, 3, 5, 8, 12]))]
    rows += [(1000, t, "user", "a very long talk" if t < 70 else f"{t}") for t in range(90)] + [(1001, t, "user", "a very long talk") for t in range(80)]
    rows += [(2000, None, None, None), (2000, None, "user", ""), (2000, 3, "user", "x" * 100_000), (2000, 3, "user", "twin"), (2000, 3, "user", "twin"), (None, 1, "user", "no id"), (2003, 0, None, None)]
    return rows


@pytest.fixture(scope="module")
def want():
    return expected(_rows())


@pytest.mark.parametrize("part, stretch", [(prefix_trie.PART, prefix_trie.STRETCH), (12, 4)])
def test_rows(spark, want, part, stretch):
    """The second case splits components over the cluster and numbers long conversations in stretches."""
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in _rows()], SCHEMA).repartition(5)
    got = prefix_trie.prefix_trie(df, part, stretch).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == want


def test_ids_of_a_node_are_listed_by_ranges(spark, want, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 7)
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "x", "y", 1) for r in _rows()], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == want


def test_no_rows(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_local_decomposition():
    rng = np.random.default_rng(0)
    for kind in ("random", "chain", "star", "forest"):
        n = 300
        up = {"random": [-1] + [int(rng.integers(0, i)) for i in range(1, n)], "chain": range(-1, n - 1), "star": [-1] + [0] * (n - 1), "forest": [-1 if i % 7 == 0 else i - 1 - int(rng.integers(0, i % 7)) for i in range(n)]}[kind]
        up, part, depth = np.array(up), np.zeros(n, dtype=int), np.zeros(n, dtype=int)
        for i in range(n):
            part[i], depth[i] = (i, 0) if up[i] < 0 else (part[up[i]], depth[up[i]] + 1)
        values = rng.integers(0, 100, (n, 2))
        total = values.copy()
        for i in range(n - 1, 0, -1):
            if up[i] >= 0:
                total[up[i]] += total[i]
        order = rng.permutation(n)
        place = np.argsort(order)
        moved = np.where(up[order] >= 0, place[up[order]], -1)
        assert (prefix_trie.decompose(part[order], moved, depth[order], values[order]) == total[order]).all(), kind
