"""The corpus pipeline: language ID, line dedup, near-copy removal, source mixing, BPE coding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet in the
shared folder and read again as the next stage's documents. All but the last return the columns of
``documents``: ``doc_id, text, lang, source, n_chars``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm import bpe, lang_id, line_dedup, mixing, near_copies
from panelworks.llm.common import row_keys, saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; ``lang`` becomes the language found."""
    return lang_id.keep_identified(docs.select(*COLUMNS))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents of which nothing is left."""
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    kept = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed.cast("long")).select(*COLUMNS)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word Jaccard similarity of 0.8 or more)
    stays: that of the least id (one of its rows, if the id repeats: the one of the least hash; rows
    equal in full count once). Without any known id in a component, the row of the least hash stays."""
    docs = docs.select(*COLUMNS)
    found = near_copies.near_copies(docs)
    chosen = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "ka", "kb")
    keep = saved(found.groupBy("root").agg(F.min(chosen).alias("first")).select("first.ka", "first.kb"))
    ka, kb = row_keys(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumns({"ka": ka, "kb": kb})
    return keyed.join(keep, ["ka", "kb"], "left_semi").dropDuplicates(["ka", "kb"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share asks."""
    return mixing.mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, one row per document of the mix."""
    return bpe.digests(bpe.encode(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_near_copies),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

# Trained language models, XXH64 fingerprints and a token vocabulary are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
