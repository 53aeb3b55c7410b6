"""SimHash near-duplicates by pivot distance tables.

A table's pivots are reference fingerprints that differ from a common base in one block of bits
each. The distance of a fingerprint to a pivot less its distance to the base depends on that block
alone, so with one block more than differing bits allowed, two linked fingerprints agree in every
such coordinate of at least one block: coordinates of a block are the join key of its cell. Within a
cell, the distances to further random pivots must differ by at most the allowed bits (the triangle
inequality); a fingerprint with no other in its cell within that maximum coordinate difference is
discarded. Neighbouring coordinates are counted by aggregation, never by listing a cell's pairs.

Survivors are verified exactly: fingerprints differ by at most two bits if and only if some word is
within one bit of both. Each survivor names itself and its 64 one-bit neighbours, and those who name
the same word (at most 65 fingerprints) are linked to the least of them. So a group of n linked
copies costs 65 n rows, not n squared pairs, and no link is lost.

Near copies of a Jaccard similarity lie too far apart for that (at 0.8 about 15 % of all bits differ),
so ``alike`` works on wide fingerprints of shingle sets, each word in ``WIDE_BLOCKS`` blocks with the
pivots above. No number of agreeing blocks is certain at such distances, so cells are the coordinates
of two blocks some places apart, and there are as many tables as find nearly all pairs (``STRIDES``).
Random pivots would discard nothing at such bounds and are not used. Rows of a cell carry the size of
their set and how many of its hashes other sets hold too: no two sets have more in common than the
lesser of those, which discards most pairs exactly where many sets are nearly similar. Pairs of more
than ``WIDE_BITS`` differing bits are discarded as well; the others go to an exact check. A pair of
many common cells is given out by the first of them.

Defined results: null and empty texts have fingerprint zero and link like any other; null ids keep
their row and count only where no id of the component is known. Repeated rows are rows like others.
Whole texts are hashed at any length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import row_keys, saved
from panelworks.llm.components import components

BITS = 64
MAX_BITS = 2  # linked at this many differing bits or fewer
SHINGLE = 3
BLOCKS = 4
CHECK_PIVOTS = 1  # random pivots compared within a cell
SEED = 42
_CHUNK = 1 << 16  # shingles counted at once

WORDS = 8  # of 64 bits in a wide fingerprint
WIDE_BLOCKS = 9  # in a word, of 7 or 8 bits
# Tables pair each block with the ones 1 to STRIDES places on. Sets of Jaccard similarity 0.8 differ in at
# most 0.1515 of all bits, small ones in up to 0.161 and 4 of 5 shingles in 0.1875, hence twice the tables there.
STRIDES, SMALL = 6, 5
WIDE_BITS, HEAD_BITS = 144, 64  # differing at most, of all bits and of the first words
_HEAD = [f"w{i}" for i in range(3)]  # the words that rows of cells carry
_SIZES = ("n", "shared")
SIMILAR = 0.8  # Jaccard similarity of sets that wide fingerprints look for
_WIDE_CHUNK = 4096


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text: a bit is set if it is in over half of the shingle hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: ASCII only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        head = [w + b" " for w in words]
        shingles = [a + b + c for a, b, c in zip(head, head[1:], words[2:])]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(shingles), _CHUNK):
        h = np.array([digest(s, SEED) for s in shingles[at : at + _CHUNK]], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(shingles), bitorder="little")
    return int(bits.view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ka, kb, fp): the id, the row's keys and the fingerprint as a signed long."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            fps = [_signed(fingerprint(t.as_py())) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps, pa.int64())], names=["doc_id", "ka", "kb", "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    ka, kb = row_keys(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), ka.alias("ka"), kb.alias("kb"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, f"doc_id {kind}, ka long, kb long, fp long")


def _pivots(blocks: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """For each block its base and its pivots (the base with one bit of the block turned), and the
    random pivots compared within cells. All are drawn once from a fixed seed."""
    rng = np.random.default_rng(SEED)
    draw = lambda: int(rng.integers(0, 1 << BITS, dtype=np.uint64))
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    tables = []
    for low, high in zip(edges, edges[1:]):
        base = draw()
        tables.append((base, [base ^ (1 << i) for i in range(low, high)]))
    return tables, [draw() for _ in range(CHECK_PIVOTS)]


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot))))


def _coordinates(fp: Column, base: int, pivots: list[int]) -> Column:
    """Distances to a block's pivots less that to the base (one nearer or one farther), as bits."""
    origin = _distance(fp, base)
    key = F.lit(0).cast("long")
    for i, p in enumerate(pivots):
        key = key + F.when(_distance(fp, p) < origin, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return key


def survivors(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """The distinct fingerprints that the pivot tables cannot rule out."""
    tables, checks = _pivots(blocks)
    block_keys = [_coordinates(F.col("fp"), *t) for t in tables]
    # Linked fingerprints differ in at most max_bits blocks: the coordinates of the others agree.
    kept = list(combinations(range(blocks), blocks - max_bits))
    cells = F.array(*[
        F.struct(F.lit(n).alias("t"), *[F.col(f"k{b}").alias(f"c{i}") for i, b in enumerate(c)]) for n, c in enumerate(kept)
    ])
    distances = F.array(*[_distance(F.col("fp"), p).cast("int") for p in checks])
    rows = (
        fps.select("fp", *[k.alias(f"k{b}") for b, k in enumerate(block_keys)], distances.alias("d"))
        .select("fp", F.explode(cells).alias("c"), "d")
        .select("fp", "c.*", *[F.col("d")[i].alias(f"d{i}") for i in range(CHECK_PIVOTS)])
    )
    keys = [c for c in rows.columns if c != "fp"]
    held = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    near = held
    for i in range(CHECK_PIVOTS):  # what a neighbour at these distances can see
        near = near.withColumn(f"d{i}", F.explode(F.sequence(F.col(f"d{i}") - max_bits, F.col(f"d{i}") + max_bits)))
    seen = near.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 1").drop("n")
    return rows.join(seen, keys, "left_semi").select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """(a, b): stars that connect exactly the fingerprints linked within two bits."""
    words = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])
    named = fps.select("fp", F.explode(words).alias("word")).groupBy("word").agg(F.collect_list("fp").alias("fps"))
    named = named.where(F.size("fps") > 1)  # at most 65: the word and its neighbours
    return named.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ka, kb, fp, component_id) per row: component_id is the least id reachable by links."""
    prints = saved(simhash(docs, id_col, text_col))
    fps = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(survivors(fps)))
    grouped = fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = grouped.join(roots, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", "ka", "kb", "fp", "component_id")


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """SimHash of ``WORDS`` signed words of a set of 64-bit shingle hashes, each mixed anew for every word."""
    counts = np.zeros(BITS * WORDS, dtype=np.int64)
    step = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), _WIDE_CHUNK):
        h = hashes[at : at + _WIDE_CHUNK, None] + step
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = (h ^ (h >> np.uint64(31))).astype("<u8")
        counts += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8").tolist()


def _cells(prints: DataFrame, *columns: str) -> DataFrame:
    """(key, *columns, w0, ...): one row for each table, under the key of the cell: the table and the
    coordinates of its two blocks; with the first words of the fingerprint."""
    tables, _ = _pivots(WIDE_BLOCKS)
    blocks = WIDE_BLOCKS * WORDS
    placed = prints.withColumn("c", F.flatten(F.transform("words", lambda w: F.array(*[_coordinates(w, *t) for t in tables]))))
    last = F.when(F.col("n") <= SMALL, 2 * STRIDES * blocks - 1).otherwise(STRIDES * blocks - 1)

    def key(t: Column) -> Column:
        block = t % blocks
        other = (block + F.floor(t / blocks) + 1) % blocks
        return t.cast("long") * (1 << 16) + F.get("c", block) * (1 << 8) + F.get("c", other.cast("int"))

    keys = F.transform(F.sequence(F.lit(0), last), key)
    head = [F.get("words", F.lit(i)).alias(w) for i, w in enumerate(_HEAD)]
    return placed.select(F.explode(keys).alias("key"), *columns, *head).repartition("key")


def _near(other: str) -> Column:
    """Whether the row and the one whose columns begin with ``other`` may be similar: their first words
    differ in few bits, and so many hashes shared with any row at all would do."""
    bits = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(other + w))) for w in _HEAD), F.lit(0))
    common = F.least("shared", other + "shared")
    return (bits <= HEAD_BITS) & (common >= SIMILAR * (F.col("n") + F.col(other + "n") - common) - 1e-9)


def _first(other: str) -> Column:
    """Whether ``key`` is the first of the cells in the first words that the row has in common with the one
    whose columns begin with ``other`` (true of all their cells, where they have none there)."""
    edges = [round(i * BITS / WIDE_BLOCKS) for i in range(WIDE_BLOCKS + 1)]
    equal = F.lit(0).cast("long")  # bits: blocks of equal coordinates
    for i, w in enumerate(_HEAD):
        for j, (low, high) in enumerate(zip(edges, edges[1:])):
            differ = F.col(w).bitwiseXOR(F.col(other + w)).bitwiseAND(F.lit(_signed((1 << high) - (1 << low))))
            equal = equal + F.when(differ == 0, F.lit(1 << (WIDE_BLOCKS * i + j))).otherwise(F.lit(0)).cast("long")

    def is_first(blocks: Column) -> Column:
        table = F.lit(None).cast("long")
        for stride in reversed(range(STRIDES)):
            both = blocks.bitwiseAND(F.shiftright(blocks, stride + 1))
            lowest = F.bit_count(both.bitwiseAND(-both) - 1)
            table = F.when(both != 0, lowest + stride * WIDE_BLOCKS * WORDS).otherwise(table)
        return F.coalesce(table == F.shiftright("key", 16), F.lit(True))

    return F.exists(F.array(equal), is_first)


def _verified(pairs: DataFrame, prints: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The distinct pairs (a, b) within ``WIDE_BITS`` that ``verify`` confirms."""
    x = prints.select(F.col("cid").alias("a"), F.col("words").alias("x"))
    y = prints.select(F.col("cid").alias("b"), F.col("words").alias("y"))
    apart = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, bits: n + bits)
    near = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(x, "a").join(y, "b").where(apart <= WIDE_BITS)
    return saved(verify(saved(near.select("a", "b"))))


def _torn_pairs(part: DataFrame) -> DataFrame:
    """(a, b) of the rows near each other in cells (key, cid, root, n, shared, w0, ...) of several roots,
    most of them once."""
    torn = part.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("top")).where("least < top").select("key", "top")
    x = part.join(torn, "key").where("root < top").select("key", *[F.col(c).alias(f"x{c}") for c in ("cid", "root", *_SIZES, *_HEAD)])
    near = (F.col("xroot") < F.col("root")) & _near("x") & _first("x")
    return x.join(part, "key").where(near).select(F.col("xcid").alias("a"), F.col("cid").alias("b"))


def alike(prints: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(cid, root) of the linked rows of ``prints`` (cid, n, shared, words: the size of a set, how many of
    its hashes are in other sets too, and its wide fingerprint).

    Linked are pairs that share a cell, may be similar by sizes and bits and are returned by ``verify``
    (a, b). Each row is first compared with the least and the greatest of the rows near it that are ends of
    its cells; then only rows of a cell that still lie in different components are. A cell's rows of its
    largest component meet the others alone, so large groups of near copies are never listed by pairs.
    """
    placed = _cells(prints, "cid", *_SIZES)
    whole = F.struct(F.col("shared") / F.col("n"), "cid")
    end = {"low": F.min("cid"), "high": F.max("cid"), "most": F.max_by("cid", whole)}
    of = {"low": lambda c: F.min_by(c, "cid"), "high": lambda c: F.max_by(c, "cid"), "most": lambda c: F.max_by(c, whole)}
    columns = [of[e](c).alias(f"{e}{c}") for e in end for c in (*_SIZES, *_HEAD)]
    ends = placed.groupBy("key").agg(*[column.alias(e) for e, column in end.items()], *columns).where("low < high")
    hub = {e: F.when(_near(e) & (F.col("cid") != F.col(e)), F.col(e)) for e in end}
    best = F.max_by(hub["most"], F.when(hub["most"].isNotNull(), F.struct(F.col("mostshared") / F.col("mostn"), "most")))
    star = placed.join(ends, "key").groupBy("cid").agg(F.min(hub["low"]).alias("low"), F.max(hub["high"]).alias("high"), best.alias("most"))
    star = star.select(F.col("cid").alias("a"), F.explode(F.array("low", "high", "most")).alias("b")).where("b is not null")
    links = _verified(star, prints, verify)

    grouped = prints.join(components(links).withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    sizes = grouped.groupBy("root").agg(F.count("*").alias("size"))
    place = F.floor(F.log2("size")) * (1 << 56) + F.pmod(F.xxhash64("root"), F.lit(1 << 56))  # larger components are higher
    part = _cells(saved(grouped.join(sizes, "root").withColumn("root", place)), "cid", "root", *_SIZES)
    more = _verified(_torn_pairs(part), prints, verify)
    return components(links.unionByName(more)).withColumnRenamed("node", "cid")
