"""Embedding near-duplicates by spherical-cap filters.

A filter is a cap around a direction on the sphere; a vector passes it when its cosine to the
direction reaches a threshold. Directions form a product code: after a random rotation the axes fall
into blocks, each with its own random code words, and a direction joins one word of each block, so
``words ** blocks`` directions are described by few random numbers. A vector is decoded to the list of
all directions it passes from the best score sums of two halves of the blocks: the work follows the
length of the list, not the number of directions.

The threshold is the vector's own: the score of its ``passed_filters``-th best direction. One threshold for
all was measured to leave some vectors without a filter and give others ten thousand, as the code
meets some vectors better than others; near vectors have near scores on every direction, so their
own thresholds agree as well.

Vectors that pass a common filter are joined, thinned by the Hamming distance of sign sketches (far
beyond what linked vectors show), made distinct and verified by the cosine in double precision.
The code grows with the number of vectors, so that a filter is expected to hold about ``OCCUPANCY``
unrelated vectors at any size. Two linked vectors share a falling part of their filters as directions
multiply, so the number of filters per vector grows too (``passed_filters``).

Equal vectors are one class and are never expanded into pairs. Unlike lengths are compared only
within a length. Defined results: rows whose vector is null, empty, zero or holds a null or
non-finite component link with nothing and keep their row; null ids likewise. Ids should be unique;
rows that repeat an id count as further vectors of that id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import saved
from panelworks.llm.components import components
from panelworks.llm.vectors import distinct_vectors, matrix, usable

MIN_COSINE = 0.95
BLOCKS = 4
OCCUPANCY = 2.0
PASSED = 64  # filters of a vector among up to PASSED_AT vectors
PASSED_AT = 20_000
PASSED_GROWTH = 0.2  # measured: see README
SKETCH = 128  # sign bits
SEED = 7
_SCORES = 1 << 22  # score sums of a half held at once


class Code:
    """Random rotation, code words and sign sketch for one dimension; equal in every task."""

    def __init__(self, dim: int, words: int) -> None:
        rng = np.random.default_rng([SEED, dim, words])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.blocks = np.array_split(np.arange(dim), min(BLOCKS, dim))
        self.words = []
        for b in self.blocks:
            w = rng.standard_normal((words, len(b)))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / math.sqrt(len(self.blocks)))
        self.sketch = rng.standard_normal((dim, SKETCH))

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score sums over the code words of the first and of the second half of the blocks."""
        x = unit @ self.rotation
        scores = [x[:, b] @ w.T for b, w in zip(self.blocks, self.words)]
        cut = (len(scores) + 1) // 2
        out = []
        for part in (scores[:cut], scores[cut:]):
            total = np.zeros((len(x), 1))
            for s in part:
                total = (total[:, :, None] + s[:, None, :]).reshape(len(x), -1)
            out.append(total)
        return out[0], out[1]


def decode(unit: np.ndarray, code: Code, passed: int = PASSED) -> np.ndarray:
    """(row, place) -> filter: the ``passed`` directions nearest to each row.

    Pair (i, j) of the sorted halves can be among the best only if at most ``passed`` pairs are at
    least as good, that is (i + 1) * (j + 1) <= passed, so few sums are formed.
    """
    left, right = code.halves(unit)
    width = right.shape[1]
    tops = []
    for half in (left, right):
        k = min(passed, half.shape[1])
        best = np.argpartition(-half, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(half, best, axis=1), axis=1, kind="stable")
        tops.append(np.take_along_axis(best, order, axis=1))
    i, j = np.divmod(np.arange(tops[0].shape[1] * tops[1].shape[1]), tops[1].shape[1])
    few = (i + 1) * (j + 1) <= passed
    a, b = tops[0][:, i[few]], tops[1][:, j[few]]
    sums = np.take_along_axis(left, a, axis=1) + np.take_along_axis(right, b, axis=1)
    k = min(passed, sums.shape[1])
    best = np.argpartition(-sums, k - 1, axis=1)[:, :k]
    return np.take_along_axis(a, best, axis=1) * width + np.take_along_axis(b, best, axis=1)


def passed_filters(n: int) -> int:
    """Filters of each of n vectors, so that linked vectors share one at any size of the code."""
    return math.ceil(PASSED * max(1.0, n / PASSED_AT) ** PASSED_GROWTH)


def code_words(n: int, dim: int) -> int:
    """Words per block, so that n vectors leave about ``OCCUPANCY`` in a filter."""
    return max(2, math.ceil((n * passed_filters(n) / OCCUPANCY) ** (1 / min(BLOCKS, dim))))


def _filters(classes: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """(rep, dim, filter, s0, s1): the filters each distinct vector passes, and its sketch; ``sizes``
    has the code words and the filters of a vector by dimension."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Code] = {}
        for batch in source:
            reps = np.asarray(batch.column(0))
            dims = np.asarray(batch.column(2))
            for dim in np.unique(dims).tolist():
                words, passed = sizes[dim]
                if dim not in codes:
                    codes[dim] = Code(dim, words)
                code = codes[dim]
                at = np.flatnonzero(dims == dim)
                step = max(1, min(256, _SCORES // words ** ((len(code.blocks) + 1) // 2)))
                for low in range(0, len(at), step):
                    part = at[low : low + step]
                    x = matrix(batch.column(1).take(pa.array(part)), dim)
                    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    found = decode(x, code, passed)
                    row, found = np.repeat(np.arange(len(part)), found.shape[1]), found.ravel()
                    sketch = np.packbits(x @ code.sketch > 0, axis=1).view("<i8")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reps[part][row]), pa.array(np.full(len(row), dim, dtype=np.int32)), pa.array(found.astype(np.int64)), pa.array(sketch[row, 0]), pa.array(sketch[row, 1])],
                        names=["rep", "dim", "filter", "s0", "s1"],
                    )

    return classes.select("rep", "vec", F.size("vec").alias("dim")).mapInArrow(batches, "rep long, dim int, filter long, s0 long, s1 long")


def _cosines(pairs: DataFrame) -> DataFrame:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            sizes = np.asarray(batch.column(2).value_lengths())
            out = np.zeros(batch.num_rows)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                x, y = (matrix(batch.column(i).take(pa.array(at)), dim) for i in (2, 3))
                x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
                out[at] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "cosine"])

    return pairs.select("a", "b", "x", "y").mapInArrow(batches, "a long, b long, cosine double")


def linked_classes(classes: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(a, b, cosine) of distinct vectors found at or above ``min_cosine``, a < b."""
    sizes = {r["dim"]: (code_words(r["n"], r["dim"]), passed_filters(r["n"])) for r in classes.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    angle = math.acos(min_cosine) / math.pi
    most = math.ceil(SKETCH * angle + 8 * math.sqrt(SKETCH * angle * (1 - angle)))
    filters = saved(_filters(classes, sizes))
    x, y = filters.alias("x"), filters.alias("y")
    differ = F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))) + F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1")))
    pairs = (
        x.join(y, (F.col("x.filter") == F.col("y.filter")) & (F.col("x.dim") == F.col("y.dim")) & (F.col("x.rep") < F.col("y.rep")))
        .where(differ <= most)
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .distinct()
    )
    vec = classes.select("rep", "vec")
    both = pairs.join(vec.select(F.col("rep").alias("a"), F.col("vec").alias("x")), "a").join(vec.select(F.col("rep").alias("b"), F.col("vec").alias("y")), "b")
    return _cosines(both).where(F.col("cosine") >= min_cosine)


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_cosine: float = MIN_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    members, classes = distinct_vectors(rows.where(F.col(id_col).isNotNull()), id_col, vec_col)
    pairs = saved(linked_classes(classes, min_cosine).select("a", "b"))
    size = classes.select("rep", "n")
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(size.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    linked = size.join(others, "rep", "left").join(components(pairs).withColumnRenamed("node", "rep"), "rep", "left")
    linked = linked.select("rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    known = members.join(linked, "rep").select("vec_id", "n_links", F.col("root").alias("component_id"))
    alone = rows.where(F.col(id_col).isNull() | ~usable(F.col(vec_col).cast("array<double>"))).select(F.col(id_col).alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

