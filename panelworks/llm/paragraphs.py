"""Repeated paragraphs by MinHash banding, exact verification and components.

A paragraph is a line of at least ``MIN_WORDS`` words, or all consecutive shorter lines up to a blank
line or such a long one, so that wrapped text and tables are paragraphs too. Blocks of fewer words in
all are left out (headings, notices and other wording that unrelated documents share by right).
Paragraphs equal in words are one class, whatever their number of copies. Each class gets ``BANDS`` keys of ``ROWS`` MinHash values over its five-word
shingles; at the threshold of 0.8 a pair shares a key with probability 1 - (1 - 0.8^3)^9 = 0.998.

Classes that share a key are verified by the exact Jaccard similarity of their shingle sets. In
place of all pairs of a bucket, each member is first compared with the bucket's earliest and its
least member. Components of the links found then show which buckets are settled: only members of a
bucket that still lie in different components are compared, inside the join, which gives out similar
pairs alone. So a bucket of n near copies of one original costs about 2 n comparisons, and the
components are those of all colliding pairs. A bucket of n paragraphs that are similar to none of
the others, but nearly so, still costs comparisons of all of them.

Removed are all but the first paragraph (by document id, then line) of each component.

Defined results: null and empty texts have no paragraphs. Null ids are ordered last. Repeated rows
are further copies. Whole texts are read at any length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import row_keys, saved
from panelworks.llm.components import components

SHINGLE = 5
SIMILAR = 0.8
MIN_WORDS = 20
BANDS, ROWS = 9, 3
_SEED = 3


@cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(1, 1 << 64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, dtype=np.uint64)


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the five-word shingles (fewer words: of the whole sequence)."""
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(b" ".join(words))], dtype=np.uint64)
    w = [x + b" " for x in words]
    return np.unique(np.array([digest(a + b + c + d + e) for a, b, c, d, e in zip(w, w[1:], w[2:], w[3:], w[4:])], dtype=np.uint64))


def band_keys(hashes: np.ndarray, bands: int = BANDS) -> list[int]:
    """One signed key per band."""
    multiply, add = _permutations(bands * ROWS)
    low = np.full(bands * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        h = hashes[at : at + 2048]
        low = np.minimum(low, (h[:, None] * multiply + add).min(axis=0))
    rows = low.astype("<u8").reshape(bands, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), b) - (1 << 63) for b, r in enumerate(rows)]


def _words(line: bytes) -> list[bytes]:
    return line.lower().split()  # bytes: ASCII letters and ASCII white space


def placed_blocks(lines: list[list[bytes]], min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, int]]:
    """(first line, lines, first word, end word) of each paragraph of a text's lines of words: long lines,
    and consecutive short lines joined. Words are counted over the whole text."""
    start = first = at = joined = 0
    for n, words in enumerate([*lines, []]):
        if 0 < len(words) < min_words:
            if not joined:
                start, first = n, at
            joined += len(words)
        else:
            if joined >= min_words:
                yield start, n - start, first, first + joined
            joined = 0
            if words:
                yield n, 1, at, at + len(words)
        at += len(words)


def blocks(text: bytes, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first line, lines, words) of each paragraph."""
    lines = [_words(s) for s in text.split(b"\n")]
    words = [w for line in lines for w in line]
    for line, count, low, high in placed_blocks(lines, min_words):
        yield line, count, words[low:high]


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, ka, kb, line, lines, class, keys): each paragraph with the keys of its row, its first
    line and number of lines, the digest of its words and its band keys (the band is mixed into the key)."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                row, line, lines, digest, keys = [], [], [], [], []
                for i, text in enumerate(part.column(3)):
                    for first, count, words in blocks((text.as_py() or "").encode("utf-8", "replace"), min_words):
                        row.append(i)
                        line.append(first)
                        lines.append(count)
                        digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
                        keys.append(band_keys(shingles(words)))
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(at) for c in range(3)], pa.array(line, pa.int32()), pa.array(lines, pa.int32()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "ka", "kb", "line", "lines", "class", "keys"],
                )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    ka, kb = row_keys(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), ka.alias("ka"), kb.alias("kb"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, f"doc_id {kind}, ka long, kb long, line int, lines int, class binary, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: Callable[[list[bytes]], np.ndarray] = shingles) -> DataFrame:
    """(cid, hashes): the shingle sets of the classes in ``wanted`` (cid, ka, kb, line, lines), read from
    one copy each."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sets = [shingle(_words(t.as_py().encode("utf-8", "replace"))).view("<i8") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["cid", "hashes"])

    ka, kb = row_keys(F.col(id_col), F.col(text_col))
    rows = wanted.groupBy("ka", "kb").agg(F.collect_list(F.struct("line", "lines", "cid")).alias("at"))  # paragraphs of one text
    texts = docs.select(ka.alias("ka"), kb.alias("kb"), F.col(text_col).alias("text")).join(rows, ["ka", "kb"])
    picked = texts.select(F.split("text", "\n").alias("ls"), F.explode("at").alias("a"))
    lines = picked.select(F.col("a.cid").alias("cid"), F.array_join(F.slice("ls", F.col("a.line") + 1, F.col("a.lines")), "\n").alias("text"))
    return lines.mapInArrow(batches, "cid long, hashes array<long>").dropDuplicates(["cid"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity reaches the threshold."""
    x = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("cid").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(x, "a").join(y, "b").where(_jaccard(F.col("x"), F.col("y"))).select("a", "b")


def _jaccard(x: Column, y: Column) -> Column:
    common = F.size(F.array_intersect(x, y))
    return common >= SIMILAR * (F.size(x) + F.size(y) - common) - 1e-9


def _ordered(rows: DataFrame, hub: str) -> DataFrame:
    """Distinct pairs (a, b), a < b, of each row's class and its hub."""
    return rows.where(F.col("cid") != F.col(hub)).select(F.least("cid", hub).alias("a"), F.greatest("cid", hub).alias("b")).distinct()


def _torn(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, cid, root) of the buckets whose members lie in more than one component."""
    part = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    torn = part.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    return part.join(torn, "key")


def similar_roots(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(cid, root) of the classes (cid, doc, keys) that exact Jaccard similarity links; ``sets_of``
    gives the shingle sets (cid, hashes) of the classes (cid) that share a key with another."""
    members = classes.select("cid", "doc", F.explode("keys").alias("key"))
    ends = F.struct(F.min_by("cid", "doc").alias("early"), F.min("cid").alias("low"), F.max("cid").alias("high"))
    buckets = members.groupBy("key").agg(ends.alias("e")).select("key", "e.*").where("low < high")
    colliding = saved(members.drop("doc").join(buckets, "key"))
    sets = saved(sets_of(colliding.select("cid").distinct()))
    star = colliding.select("cid", F.explode(F.array("early", "low")).alias("hub"))
    links = saved(_similar(_ordered(star, "hub"), sets))
    held = _torn(colliding.select("key", "cid"), components(links)).join(sets, "cid")
    x, y = held.alias("x"), held.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.cid") < F.col("y.cid")) & (F.col("x.root") != F.col("y.root"))
    sizes = (F.size("x.hashes") >= SIMILAR * F.size("y.hashes") - 1e-9) & (F.size("y.hashes") >= SIMILAR * F.size("x.hashes") - 1e-9)
    more = x.join(y, apart & sizes & _jaccard(F.col("x.hashes"), F.col("y.hashes"))).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    return components(links.unionByName(more)).withColumnRenamed("node", "cid")


def repeated_paragraphs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
    found: DataFrame | None = None, shingle: Callable[[list[bytes]], np.ndarray] = shingles,
) -> DataFrame:
    """(doc_id, line, component_id, component_size, removed, n_lines) of every paragraph that has a copy
    or near copy; component_id is "document:line" of the first of the component, line a paragraph's first.
    ``found`` may give ``paragraphs`` as written before, with keys of the sets that ``shingle`` makes."""
    found = saved(paragraphs(docs, id_col, text_col, min_words)) if found is None else found
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line", "ka", "kb", "lines")
    classes = found.groupBy("class").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.first("keys").alias("keys"))
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()))
    first = classes.select("cid", "first.ka", "first.kb", "first.line", "first.lines")
    members = classes.select("cid", F.coalesce("first.doc_id", F.lit(2**63 - 1)).alias("doc"), "keys")
    roots = similar_roots(members, lambda wanted: _sets(docs, wanted.join(first, "cid"), id_col, text_col, shingle))
    grouped = classes.select("class", "cid", "n", F.struct("first.last", "first.doc_id", "first.line").alias("first")).join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    whole = grouped.groupBy("root").agg(F.sum("n").alias("component_size"), F.min("first").alias("head")).where("component_size > 1")
    repeated = grouped.select("class", "root").join(whole, "root").select("class", "component_size", "head")
    out = found.select("doc_id", "line", "lines", "class").join(repeated, "class")
    same = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("line") == F.col("head.line"))
    head = F.concat_ws(":", F.coalesce(F.col("head.doc_id").cast("string"), F.lit("null")), F.col("head.line"))
    return out.select("doc_id", "line", head.alias("component_id"), "component_size", (~same).alias("removed"), F.col("lines").alias("n_lines"))
