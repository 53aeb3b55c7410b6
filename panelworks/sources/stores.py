"""Parquet stores for bars and daily series.

Symbols are hashed into a fixed number of bucket folders: one folder per symbol
would leave millions of tiny files. Rows are sorted within a bucket, so a symbol
filter prunes folders first and row groups second.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import in_range
from ..schemas import BARS, SERIES
from ..session import materialize

BUCKETS = 64


def bucket_of(symbol: Column | str, buckets: int = BUCKETS) -> Column:
    """Folder number of a symbol."""
    return F.pmod(F.xxhash64(symbol), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, folders: list[str], buckets: int) -> None:
    # Ranges split a bucket over as many tasks as its rows ask for.
    placed = df.withColumn("bucket", bucket_of("symbol", buckets))
    (
        placed.repartitionByRange(*folders, "symbol", F.year("date"))
        .sortWithinPartitions(*folders, "symbol", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders)
        .parquet(path)
    )


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # nothing written yet


def _stored_buckets(spark: SparkSession, path: str) -> int | None:
    """The number of buckets a store was first written with, kept beside its folders."""
    kept = _stored(spark, f"{path}/_buckets", "buckets INT")
    return kept.first()["buckets"] if kept is not None else None


def _put(df: DataFrame, path: str, schema: str, folders: list[str], keys: list[str], buckets: int) -> None:
    spark = df.sparkSession
    stored = _stored(spark, path, f"{schema}, bucket INT")
    kept = _stored_buckets(spark, path)
    if kept is None:
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/_buckets")
    buckets = kept or buckets
    if stored is not None:
        # Everything stored for a written key is replaced; neighbours sharing its
        # folders are carried over. Folders not touched are not read. The write is
        # staged and replaces folders when all tasks are done, so the neighbours,
        # and rows derived from the store, are read while it runs: rows are written
        # once. Only the keys, a small table, are set down first.
        touched = materialize(df.select(*keys).distinct())
        folder_keys = touched.withColumn("bucket", bucket_of("symbol", buckets)).select(*folders).distinct()
        neighbours = stored.join(folder_keys, folders, "left_semi").join(touched, keys, "left_anti")
        df = neighbours.drop("bucket").unionByName(df)
    _write(df, path, folders, buckets)


def put_bars(bars: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store bars, replacing all stored rows of the symbols given."""
    _put(bars, path, BARS, ["bucket"], ["symbol"], buckets)


def get_bars(
    spark: SparkSession,
    path: str,
    symbols: Iterable[str] | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Stored bars of the symbols (all if None) inside the inclusive date range."""
    stored = spark.read.schema(f"{BARS}, bucket INT").parquet(path)
    return in_range(_only(stored, symbols, path), start, end).drop("bucket")


def put_series(series: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store daily series, replacing all stored rows of the (kind, symbol) pairs given."""
    _put(series, path, SERIES, ["kind", "bucket"], ["kind", "symbol"], buckets)


def get_series(spark: SparkSession, path: str, kind: str, symbols: Iterable[str] | None = None) -> DataFrame:
    """Stored series of one kind."""
    stored = spark.read.schema(f"{SERIES}, bucket INT").parquet(path).filter(F.col("kind") == kind)
    return _only(stored, symbols, path).drop("bucket")


def _only(stored: DataFrame, symbols: Iterable[str] | None, path: str) -> DataFrame:
    if symbols is None:
        return stored
    wanted = [F.lit(s) for s in symbols]
    buckets = _stored_buckets(stored.sparkSession, path)
    if buckets:
        stored = stored.filter(F.col("bucket").isin([bucket_of(s, buckets) for s in wanted]))
    return stored.filter(F.col("symbol").isin(wanted))
