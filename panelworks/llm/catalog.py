"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm import bpe, byte_bpe, cap_filters, hnsw, html_extract, lang_id, paragraphs, passages, prefix_trie, simhash, turn_align
from panelworks.llm.common import saved, table
from panelworks.llm.license_scan import LICENSE_SQL, license_scan
from panelworks.llm.line_dedup import LINE_DEDUP_SQL, line_dedup
from panelworks.llm.mixing import MIX_SQL, mix_plan


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and near-repeated paragraphs by lines, and passages that documents share wherever they stand."""
    docs = table(spark, sf_dir, "documents")
    found = saved(passages.scan(docs))
    blocks = found.where(F.col("class").isNotNull()).drop("t", "h1")
    lines = paragraphs.repeated_paragraphs(docs, found=blocks, shingle=passages.shingles).withColumn("kind", F.lit("paragraph"))
    shared = passages.repeated_passages(docs, found=found.where("h1 is not null").select("t", "h1")).withColumn("kind", F.lit("passage"))
    return lines.unionByName(shared, allowMissingColumns=True)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents")))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_align.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.encode(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_ann": op3_ann,
    "op4_paragraph_dedup": op4_paragraph_dedup,
    "op5_language_id": op5_language_id,
    "op6_bpe": op6_bpe,
    "op7_html_extract": op7_html_extract,
    "op8_license_scan": op8_license_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_turn_repair": op12_turn_repair,
    "op13_byte_bpe": op13_byte_bpe,
}
SQL = {"op8_license_scan": LICENSE_SQL, "op9_line_dedup": LINE_DEDUP_SQL, "op10_mixing": MIX_SQL, "op11_prefix_trie": prefix_trie.TRIE_SQL, "op12_turn_repair": turn_align.TURN_SQL}
