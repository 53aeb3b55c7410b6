"""Mixing sources to target weights.

Sizes are summed per source, targets follow from the summed table alone, and each document is emitted
``floor(rate)`` times plus once more when a hash of its id falls below the fraction. The source table
has one row per source; it is ranked by range partitions, joined to the documents by measured size,
and never leaves the executors: the driver sees one row of sums per reshare round.

Defined results: a null text has size 0; null is a source of its own, ordered last; a source without
words has target 0 and emits nothing; rows with equal ids draw alike; a null id draws like any other.
Other columns pass through; ``copies`` is replaced where it exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import WORD, saved

WEIGHTS = (3, 1, 2)  # by source in code point order, repeating
SHARE = 1.5  # of all sizes
MAX_RATE = 2  # a source's target over its size
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_rates(sizes: DataFrame, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    Targets share ``share`` of all sizes by weight. A source that would pass ``max_rate`` times its
    size stops there and the excess goes to the others by weight, until none is above.
    """
    totals = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    parts = saved(
        totals.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) + F.col("before") - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = saved(
        parts.join(offsets, "part").select("source", "source_size", weight.cast("double").alias("w"), (F.col("source_size") * max_rate).cast("double").alias("cap"))
    )
    row = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    budget, level, rest = share * (row[0] or 0), 0.0, row[1] or 0.0
    full = -1
    while rest:  # each round fills at least one more source, or ends
        n_full, filled, others = _filled(ranked, level if full >= 0 else -1.0)
        if n_full == full or not others:
            break
        full, level = n_full, (budget - filled) / others
    target = F.least(F.col("cap"), F.lit(level) * F.col("w"))
    return ranked.select(
        "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(max_rate)))).otherwise(0.0).alias("rate"),
    )


def _filled(ranked: DataFrame, level: float) -> tuple[int, float, float]:
    """Sources at their cap at this level: their number and caps; weights of the others."""
    full = F.col("cap") <= F.lit(level) * F.col("w")
    row = ranked.agg(
        F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))
    ).first()
    return row[0], row[1], row[2]


def copies(doc_id: Column, rate: Column, seed: str = SEED) -> Column:
    """floor(rate), plus one with probability of the fraction by a hash of the id."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    draw = F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    sizes = saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")))
    rates = source_rates(sizes)
    s, r = sizes.alias("s"), rates.alias("r")
    plan = s.join(r, F.col("s.source").eqNullSafe(F.col("r.source"))).withColumn("copies", copies(F.col("doc_id"), F.col("rate")))
    return plan.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it."""
    rates = source_rates(docs.select(source_col, n_words(F.col(text_col)).alias("size")), source_col)
    rates = rates.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    counted = docs.join(rates, F.col(source_col).eqNullSafe(F.col("__source")))
    copy = F.explode(F.array_repeat(F.lit(1), copies(F.col(id_col), F.col("__rate")).cast("int"))).alias("__copy")
    return counted.select("*", copy).drop("__source", "__rate", "__copy")


MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap FROM s),
o AS (SELECT *, cap / w AS r, coalesce(sum(cap) OVER (ORDER BY cap / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
      sum(w) OVER (ORDER BY cap / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
      {SHARE} * sum(source_size) OVER () AS budget FROM w),
v AS (SELECT coalesce(arg_min((budget - filled) / rest, r) FILTER (WHERE r > (budget - filled) / rest), 0) AS level FROM o),
t AS (SELECT source, source_size, least(cap, level * w) AS target FROM w, v),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target,
      CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, {float(MAX_RATE)}) ELSE 0 END AS rate,
      ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {float(16**13)} AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, target, copies, (copies * size)::BIGINT AS taken FROM n
"""
