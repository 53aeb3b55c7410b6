"""Approximate nearest neighbours: one navigable small-world graph per shard, results merged.

Distinct vectors are dealt to shards of about ``SHARD_ROWS`` by a hash. A task builds the graph of a
shard and stores it as flat arrays: vectors, and for each level the node numbers and a fixed number
of neighbour slots per node (-1 where empty). A node enters levels by a random draw and links, as in
one-by-one insertion, to nodes inserted before it: the nearest that are not nearer to one another
(so links spread), found exactly, as a shard is small; links are then made mutual and thinned by the
same rule. Inner products become cosines by one further axis that gives all vectors of a shard one
length, so the graph also serves vectors of unequal length.

A block of queries walks a shard's graph together: greedily down the levels, then with a beam on the
lowest. Every shard answers every query block; (shard, block) pairs are the unit of work, of bounded
size however many rows or queries there are. A shard's best are ranked by the exact product in
double precision and merged by query.

Equal vectors are one node, so a vector that many rows hold does not fill the neighbour slots. Only a
class's least ids, one more than asked for, can be among the nearest; they are taken by rank.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part. Vectors meet only others of their length. Null ids take no part. Rows equal in id and
vector are one. An id with several vectors is nearest by the best of them, as a query and as a candidate.
With fewer candidates than asked for, all found are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import saved
from panelworks.llm.vectors import distinct_vectors

SHARD_ROWS = 4096
BLOCK_ROWS = 1024  # queries walked together
LINKS = 16  # links chosen per node and level; twice as many slots on the lowest
CANDIDATES = 64  # nearest earlier nodes a link is chosen from
BEAM = 96
SEED = 11

_INDEX = "shard int, dim int, ids binary, vectors binary, nodes binary, sizes array<int>, neighbours binary"


def _spread(sims: np.ndarray, own: np.ndarray, cand: np.ndarray, keep: int) -> np.ndarray:
    """Per row, up to ``keep`` of its candidates (-1: none), nearest first, each nearer to the row
    than to any chosen before; free slots go to the nearest of the rest."""
    n, m = cand.shape
    valid = cand >= 0
    near = np.where(valid, np.take_along_axis(sims[own], np.maximum(cand, 0), axis=1), -np.inf)
    order = np.argsort(-near, axis=1, kind="stable")
    cand, near = np.take_along_axis(cand, order, axis=1), np.take_along_axis(near, order, axis=1)
    chosen = np.zeros((n, m), dtype=bool)
    closest = np.full((n, m), -np.inf)  # to any chosen so far
    count = np.zeros(n, dtype=int)
    rows = np.arange(n)
    for j in range(m):
        take = np.isfinite(near[:, j]) & (closest[:, j] < near[:, j]) & (count < keep)
        chosen[:, j] = take
        count += take
        if take.any() and j + 1 < m:
            r = rows[take]
            closest[r] = np.maximum(closest[r], sims[np.maximum(cand[r, j], 0)[:, None], np.maximum(cand[r], 0)])
    rank = np.where(chosen, 0, np.where(np.isfinite(near), 1, 2)) * m + np.arange(m)
    best = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    out = np.where(np.isfinite(np.take_along_axis(near, best, axis=1)), np.take_along_axis(cand, best, axis=1), -1)
    return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)


def _level(sims: np.ndarray, nodes: np.ndarray, slots: int) -> np.ndarray:
    """Neighbour slots of the nodes of one level, given in insertion order."""
    n = len(nodes)
    links = np.full((n, LINKS), -1)
    for low in range(0, n, 256):
        own = np.arange(low, min(low + 256, n))
        s = sims[nodes[own]][:, nodes].copy()
        s[np.arange(n)[None, :] >= own[:, None]] = -np.inf  # earlier nodes only
        m = min(CANDIDATES, n)
        cand = np.argpartition(-s, m - 1, axis=1)[:, :m]
        cand = np.where(np.isfinite(np.take_along_axis(s, cand, axis=1)), nodes[cand], -1)
        links[own] = _spread(sims, nodes[own], cand, LINKS)
    place = np.full(len(sims), -1)
    place[nodes] = np.arange(n)
    i, j = np.nonzero(links >= 0)
    a, b = i, place[links[i, j]]
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    src, dst = np.unique(np.stack([src, dst], axis=1), axis=0).T if len(src) else (src, dst)
    near = sims[nodes[src], nodes[dst]] if len(src) else np.zeros(0)
    order = np.lexsort((-near, src))
    src, dst = src[order], dst[order]
    first = np.searchsorted(src, np.arange(n))
    slot = np.arange(len(src)) - first[src]
    wide = max(slots, int(slot.max(initial=0)) + 1)
    cand = np.full((n, wide), -1)
    cand[src, slot] = nodes[dst]
    out = np.full((n, slots), -1)
    for low in range(0, n, 256):
        own = np.arange(low, min(low + 256, n))
        used = max(1, int((cand[own] >= 0).sum(axis=1).max(initial=0)))
        out[own] = _spread(sims, nodes[own], cand[own, :used], slots)
    return out


def build(vectors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Nodes and neighbour slots of each level, lowest first, of the rows of ``vectors``."""
    x = vectors / max(np.abs(vectors).max(initial=0.0), 1e-300)
    square = np.einsum("ij,ij->i", x, x)
    x = np.column_stack([x, np.sqrt(np.maximum(square.max(initial=0.0) - square, 0.0))]).astype(np.float32)
    sims = x @ x.T
    rng = np.random.default_rng([SEED, len(x)])
    order = rng.permutation(len(x))
    height = np.floor(-np.log(1 - rng.random(len(x))) / math.log(LINKS)).astype(int)
    levels, slots = [], []
    for level in range(int(height.max(initial=0)) + 1):
        nodes = order[height[order] >= level]
        levels.append(nodes)
        slots.append(_level(sims, nodes, LINKS * (2 if level == 0 else 1)))
    return levels, slots


def search(vectors: np.ndarray, levels: list[np.ndarray], slots: list[np.ndarray], queries: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
    """Numbers of up to max(k, beam) rows found near each query (-1: none), by inner product."""
    n, q = len(vectors), len(queries)
    x, y = vectors.astype(np.float32), queries.astype(np.float32)
    rows = np.arange(q)
    at = np.full(q, levels[-1][0])
    score = np.einsum("ij,ij->i", x[at], y)
    for nodes, near in zip(levels[:0:-1], slots[:0:-1]):  # greedy walks above the lowest level
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        moving = rows
        while len(moving):
            cand = near[place[at[moving]]]
            s = np.where(cand >= 0, np.einsum("ijk,ik->ij", x[cand], y[moving]), -np.inf)
            best = s.argmax(axis=1)
            top = s[np.arange(len(moving)), best]
            better = top > score[moving]
            moving = moving[better]
            at[moving], score[moving] = cand[better, best[better]], top[better]
    place = np.empty(n, dtype=int)
    place[levels[0]] = np.arange(n)
    near = slots[0][np.argsort(levels[0])] if n else slots[0]  # by row number
    width = max(k, beam)
    found, value = np.full((q, width), -1), np.full((q, width), -np.inf, dtype=np.float32)
    open_ = np.zeros((q, width), dtype=bool)
    seen = np.zeros((q, n), dtype=bool)
    found[:, 0], value[:, 0], open_[:, 0] = at, score, True
    seen[rows, at] = True
    active = rows
    while len(active):
        best = np.where(open_[active], value[active], -np.inf).argmax(axis=1)
        open_[active, best] = False
        cand = near[found[active, best]]
        fresh = (cand >= 0) & ~seen[active[:, None], np.maximum(cand, 0)]
        r, c = np.nonzero(fresh)
        seen[active[r], cand[r, c]] = True
        s = np.where(fresh, np.einsum("ijk,ik->ij", x[cand], y[active]), -np.inf).astype(np.float32)
        all_v = np.concatenate([value[active], s], axis=1)
        top = np.argpartition(-all_v, width - 1, axis=1)[:, :width]
        value[active] = np.take_along_axis(all_v, top, axis=1)
        found[active] = np.take_along_axis(np.concatenate([found[active], np.where(fresh, cand, -1)], axis=1), top, axis=1)
        open_[active] = np.take_along_axis(np.concatenate([open_[active], fresh], axis=1), top, axis=1)
        active = active[open_[active].any(axis=1)]
    return found


def _deal(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def index(classes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard and vector length, the graph in flat arrays; rows (rep, vec) in."""

    def graph(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        vectors = np.array(group["vec"].tolist(), dtype="<f8")
        levels, slots = build(vectors)
        return pd.DataFrame([{
            "shard": group["shard"].iloc[0], "dim": vectors.shape[1], "ids": group["rep"].to_numpy("<i8").tobytes(), "vectors": vectors.tobytes(),
            "nodes": np.concatenate(levels).astype("<i4").tobytes(), "sizes": [len(v) for v in levels],
            "neighbours": np.concatenate([s.ravel() for s in slots]).astype("<i4").tobytes(),
        }])

    shards = max(1, math.ceil(classes.count() / shard_rows))
    dealt = classes.select(_deal(F.col("rep"), shards).alias("shard"), F.size("vec").alias("dim"), "rep", "vec")
    return saved(dealt.groupBy("shard", "dim").applyInPandas(graph, _INDEX))


def _unpack(row: pd.Series) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    ids = np.frombuffer(row["ids"], "<i8")
    vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
    sizes = list(row["sizes"])
    levels = np.split(np.frombuffer(row["nodes"], "<i4").astype(int), np.cumsum(sizes)[:-1])
    wide = [LINKS * (2 if i == 0 else 1) for i in range(len(sizes))]
    flat = np.split(np.frombuffer(row["neighbours"], "<i4").astype(int), np.cumsum([s * w for s, w in zip(sizes, wide)])[:-1])
    return ids, vectors, levels, [f.reshape(-1, w) for f, w in zip(flat, wide)]


def nearest_classes(shards: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rep, score): each shard's ``k`` best for every row (query_id, vec) of queries."""

    def walk(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, vectors, levels, slots = _unpack(left.iloc[0])
            wanted = right["query_id"].to_numpy()
            y = np.array(right["vec"].tolist(), dtype=float)
            found = search(vectors, levels, slots, y, k, beam)
            exact = np.where(found >= 0, np.einsum("ijk,ik->ij", vectors[found], y), -np.inf)
            reps = np.where(found >= 0, ids[found], np.iinfo(np.int64).max)
            best = np.lexsort((reps, -exact), axis=1)[:, :k]
            exact, reps = np.take_along_axis(exact, best, axis=1), np.take_along_axis(reps, best, axis=1)
            r, c = np.nonzero(np.isfinite(exact))
            out.append(pd.DataFrame({"query_id": wanted[r], "rep": reps[r, c], "score": exact[r, c]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    blocks = max(1, math.ceil(queries.count() / block_rows))
    n_shards = (shards.agg(F.max("shard")).first()[0] or 0) + 1
    asked = queries.select(
        "query_id", "vec", F.size("vec").alias("dim"), _deal(F.col("query_id"), blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard")
    )
    held = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["shard", "block", "dim"]
    return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(walk, "query_id long, rep long, score double")


def nearest(
    rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = BEAM, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found to each row where ``queries`` holds,
    among all rows of other ids, by inner product; ties to the smaller id."""
    rows = rows.where(F.col(id_col).isNotNull())
    members, classes = distinct_vectors(rows, id_col, vec_col)
    members = members.distinct()  # repeated rows are one
    asked = members.join(rows.where(queries).select(F.col(id_col).alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = saved(asked.join(classes, "rep").select(F.col("vec_id").alias("query_id"), "vec"))
    # An id's own vectors may come before all others.
    own = asked.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    found = nearest_classes(index(classes, shard_rows), asked, k + own, beam, block_rows)
    found = found.groupBy("query_id", "rep").agg(F.max("score").alias("score"))  # of any of the id's vectors
    order = [F.desc("score"), F.asc("rep")]
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("r") <= k + own).drop("r")
    within = Window.partitionBy("rep").orderBy("vec_id")
    few = members.withColumn("r", F.row_number().over(within)).where(F.col("r") <= k + 1).drop("r")
    ranked = best.join(few, "rep").where("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
