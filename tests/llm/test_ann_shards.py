"""Nearest neighbours over several shards and query blocks, and with repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.llm import hnsw


def exact(rows, queries, k):
    """{query: [(id, score)]} by brute force; ids may repeat, with equal or different vectors."""
    out = {}
    for q in queries:
        best = {}
        for i, v in rows:
            if i != q:
                score = max(float(np.dot(v, w)) for j, w in rows if j == q)
                best[i] = max(score, best.get(i, -np.inf))
        out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.mark.parametrize("shard_rows, block_rows", [(4096, 1024), (250, 16)])
def test_several_shards_and_blocks(spark, shard_rows, block_rows):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(1000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    shards = hnsw.index(table.select(F.col("vec_id").alias("rep"), F.col("embedding").alias("vec")), shard_rows)
    assert shards.count() == -(-1000 // shard_rows)
    got = hnsw.nearest(table, table["vec_id"] % 20 == 0, shard_rows=shard_rows, block_rows=block_rows).collect()
    want = exact(rows, range(0, 1000, 20), 20)
    assert {q: sum(r.query_id == q for r in got) for q in want} == dict.fromkeys(want, 20)
    hits = sum(r.vec_id in dict(want[r.query_id]) for r in got)
    assert hits / 1000 >= 0.9
    assert all(r.score == pytest.approx(np.dot(rows[r.query_id][1], rows[r.vec_id][1])) for r in got)


def test_repeated_rows(spark):
    rng = np.random.default_rng(5)
    base = [(i, [float(x) for x in rng.integers(-3, 4, 8)]) for i in range(100)]
    rows = [*base, base[0], base[0], base[0], *base[1:30], (20, base[7][1]), (40, [9.0] * 8), (40, [-9.0] * 8), *[(500 + i, base[3][1]) for i in range(40)]]
    rows = [r for r in rows if any(r[1])]
    table = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "vec_id long, embedding array<double>, rep string, query_id int, score double")
    got = hnsw.nearest(table, table["vec_id"] % 20 == 0).collect()
    want = exact(rows, sorted({i for i, _ in rows if i % 20 == 0}), 20)
    mine = {q: [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in want}
    assert mine == want
