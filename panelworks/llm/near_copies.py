"""Near copies of whole documents: five-word shingles, Jaccard similarity of 0.8 or more, by SimHash.

At a similarity of 0.8 SimHashes of 64 bits differ by about ten bits, and random ones by 32, so that
neither the two bits of ``simhash.near_duplicates`` nor any bound on 64 bits tells such pairs from
others. The shingle sets get fingerprints of 512 bits here; pivot tables give the pairs that may be
near (``simhash.alike``), and each is verified by its exact similarity, as are paragraphs. Tables miss
a pair at the threshold with a probability of 0.000002 (0.000004 for four of five shingles).
Documents equal in words are one class and are never expanded into pairs.

Classes without a near copy are discarded first, by counts alone: of the ``SAMPLE`` least hashes of a
set, at least ``SHARED`` must be among those of other classes (of small sets 0.8 of all hashes). A
near copy would share each of the sample's hashes with a probability of 0.8, and too few of them with
one of 0.00000003. Then whole sets are counted, twice: 0.8 of a set's hashes must be among those of
other classes still left. These counts are exact, and they bound what two sets have in common.

Defined results: null and empty texts are equal to each other; texts of under five words are alike
only if they are equal in words. Repeated rows are further copies. Whole texts are read at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm import simhash
from panelworks.llm.common import row_keys, saved
from panelworks.llm.paragraphs import SIMILAR, _similar, shingles

SAMPLE, SHARED = 32, 12
_SLICE = 64  # documents whose shingles are held at once


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ka, kb, class, n, sample): each row with the digest of its words, the number of its
    shingles and the least of their hashes."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            digest, size, sample = [], [], []
            for text in batch.column(3):
                words = _words(text.as_py())
                hashes = shingles(words)  # ascending
                digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
                size.append(len(hashes))
                sample.append(hashes[:SAMPLE].view("<i8"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(sample, pa.list_(pa.int64()))],
                names=["doc_id", "ka", "kb", "class", "n", "sample"],
            )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    ka, kb = row_keys(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), ka.alias("ka"), kb.alias("kb"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, f"doc_id {kind}, ka long, kb long, class binary, n long, sample array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cid, n, hashes, words): the shingle sets of the classes in ``wanted`` (cid, ka, kb), their sizes and
    fingerprints, read from one copy each."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for low in range(0, batch.num_rows, _SLICE):
                part = batch.slice(low, _SLICE)
                sets = [shingles(_words(t.as_py())) for t in part.column(1)]
                lists = [[s.view("<i8") for s in sets], [simhash.wide_fingerprint(s) for s in sets]]
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in lists]]
                yield pa.RecordBatch.from_arrays(columns, names=["cid", "n", "hashes", "words"])

    ka, kb = row_keys(F.col(id_col), F.col(text_col))
    texts = docs.select(ka.alias("ka"), kb.alias("kb"), F.col(text_col).alias("text")).join(wanted, ["ka", "kb"])
    return texts.select("cid", "text").dropDuplicates(["cid"]).mapInArrow(batches, "cid long, n long, hashes array<long>, words array<long>")


def _shared(sets: DataFrame, hashes: str) -> DataFrame:
    """(cid, n, shared): how many of the distinct ``hashes`` of each row of ``sets`` are in other rows too."""
    held = sets.select("cid", F.explode(hashes).alias("hash")).groupBy("hash").agg(F.count("*").alias("rows"), F.min("cid").alias("cid"))
    own = held.where("rows = 1").groupBy("cid").agg(F.count("*").alias("own"))
    counted = sets.select("cid", "n", F.size(hashes).alias("size")).join(own, "cid", "left")
    return counted.select("cid", "n", (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared"))


def _enough(sets: DataFrame) -> DataFrame:
    """The rows of ``sets`` (n, shared) that share as many of all hashes as a near copy must."""
    return sets.where(F.col("shared") >= SIMILAR * F.col("n") - 1e-9)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ka, kb, root) per row: rows with the same root are linked by near copies."""
    found = saved(_classes(docs, id_col, text_col))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "ka", "kb")
    classes = found.groupBy("class").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("sample").alias("sample"))
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()))
    sampled = _shared(classes, "sample").where(F.col("shared") >= F.least(F.lit(SHARED), F.ceil(SIMILAR * F.col("n") - 1e-9)))
    wanted = classes.select("cid", "first.ka", "first.kb").join(sampled.select("cid"), "cid")
    sets = saved(_sets(docs, wanted, id_col, text_col))
    some = sets.select("cid", "n", "hashes").join(_enough(_shared(sets, "hashes")).select("cid"), "cid")
    counted = _enough(_shared(saved(some), "hashes")).select("cid", "shared")  # counts among those of the first
    prints = saved(sets.select("cid", "n", "words").join(counted, "cid"))

    def verify(pairs: DataFrame) -> DataFrame:
        return _similar(pairs, sets)

    roots = simhash.alike(prints, verify)
    known = classes.select("class", "cid").join(roots, "cid", "left").select("class", F.coalesce("root", "cid").alias("root"))
    return found.select("doc_id", "ka", "kb", "class").join(known, "class").drop("class")
