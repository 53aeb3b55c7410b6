"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.session import materialize

# ASCII white space separates words; every other code point belongs to one.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence[Any]]) -> DataFrame:
    """A small constant table built inside the plan (no Python rows are shipped)."""
    items = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*items)))


def row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that name a row by its id and whole text.

    Rows equal in both share the name, so they also share every result.
    """
    return F.xxhash64(doc_id, text), F.xxhash64(text, F.lit("row"), doc_id)


def hash_sample(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows, those of the least row hash (at random, but alike in every run).

    A cut of the hash leaves about twice as many rows before they are ordered, so tasks send the
    driver few rows in all, however many tasks there are.
    """
    hashed = rows.withColumn("__h", F.xxhash64(*rows.columns))
    total = rows.count()
    if total > 2 * limit:
        hashed = hashed.where(F.pmod("__h", F.lit(1 << 30)) < int(2 * limit / total * (1 << 30)) + 1)
    return hashed.orderBy("__h").limit(limit).drop("__h")


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, read back without lineage."""
    return materialize(df)


# DuckDB common table expressions: the CRC-32 steps of all bytes, and the CRC-32 of an ASCII column.
CRC32_STEPS_SQL = """crc_steps AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS steps
  FROM range(256) r(n))"""


def crc32_sql(text: str) -> str:
    """SQL of the CRC-32 of an ASCII expression, where ``crc_steps`` is joined."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, steps[xor(c, b) % 256 + 1])), 4294967295)"
