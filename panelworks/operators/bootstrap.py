"""Circular block bootstrap.

Block starts come from a hash of (seed, path, block), so any engine and any retry draws the same blocks.
A configuration's returns are packed into one array (bounded by the calendar), and its paths are drawn in
that row: no join, and no row per step. A path's metrics come from the ordered merge of its blocks'
states, which are computed once per start, so a path of n returns costs n / block_len merges; an arbitrary
metric is taken over the path as an array. Paths of a configuration are spread over tasks in groups of
``GROUP``, so a single long series uses the whole cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import PERIODS_PER_YEAR
from . import states

_PAIR = ["panel_id", "config_id"]
METRICS = ("sharpe", "total_return", "sortino", "max_drawdown")
GROUP = 100  # paths of a configuration drawn by one task


def observed_returns(returns: DataFrame) -> DataFrame:
    """Non-NULL returns with a gap-free index ``i`` and their count ``n``."""
    w = Window.partitionBy(*_PAIR)
    return returns.filter(F.col("ret").isNotNull()).select(
        *_PAIR,
        (F.row_number().over(w.orderBy("pos")) - 1).cast("bigint").alias("i"),
        "ret",
        F.count("*").over(w).alias("n"),
    )


def _packed(returns: DataFrame) -> DataFrame:
    """``(panel_id, config_id, rets, n)``: the non-NULL returns of each configuration in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "ret"))), lambda x: x["ret"])
    packed = returns.filter(F.col("ret").isNotNull()).groupBy(*_PAIR).agg(ordered.alias("rets"))
    return packed.withColumn("n", F.size("rets").cast("bigint"))


def _grouped(packed: DataFrame, n_boot: int) -> DataFrame:
    """Each packed row once per group of paths, groups spread over tasks, and then once per path ``b``."""
    firsts = F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(GROUP))
    groups = packed.select("*", F.explode(firsts).alias("low"))
    spread = groups.repartition(4 * packed.sparkSession.sparkContext.defaultParallelism, *_PAIR, "low")
    last = F.least(F.col("low") + (GROUP - 1), F.lit(n_boot - 1))
    return spread.select("*", F.explode(F.sequence("low", last)).alias("b")).drop("low")


def block_start(b: Column, k: Column, n: Column, seed: int = 0) -> Column:
    """Start index of block ``k`` of path ``b``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), b, k)), 1, 8), 16, 10).cast("bigint") % n


def _blocks(block_len: int) -> Column:
    return F.sequence(F.lit(0), F.ceil(F.col("n") / block_len).cast("int") - 1)


def path_arrays(returns: DataFrame, n_boot: int = 1000, block_len: int = 10, seed: int = 0) -> DataFrame:
    """``(panel_id, config_id, b, path)``: resampled paths as arrays, each as long as the series."""
    n = F.col("n")

    def block(k: Column) -> Column:
        size = F.least(F.lit(block_len).cast("bigint"), n - k * block_len)
        start = F.transform(F.array(block_start(F.col("b"), k, n, seed)), lambda s: F.transform(F.sequence(F.lit(0).cast("bigint"), size - 1), lambda o: F.get(F.col("rets"), ((s + o) % n).cast("int"))))
        return F.get(start, F.lit(0))

    drawn = _grouped(_packed(returns), n_boot)
    return drawn.select(*_PAIR, "b", F.flatten(F.transform(_blocks(block_len), block)).alias("path"))


def bootstrap_paths(returns: DataFrame, n_boot: int = 1000, block_len: int = 10, seed: int = 0) -> DataFrame:
    """Resampled paths ``(panel_id, config_id, b, j, ret)``, a row per step."""
    arrays = path_arrays(returns, n_boot, block_len, seed)
    return arrays.select(*_PAIR, "b", F.posexplode("path").alias("j", "ret")).withColumn("j", F.col("j").cast("bigint"))


def path_metric(paths: DataFrame, metric: Column) -> DataFrame:
    """Any aggregate expression over ``ret``, per resampled path."""
    return paths.groupBy(*_PAIR, "b").agg(metric.alias("metric"))


def bootstrap_metrics(
    returns: DataFrame, n_boot: int = 1000, block_len: int = 10, seed: int = 0, periods: int = PERIODS_PER_YEAR
) -> DataFrame:
    """``METRICS`` of every resampled path."""
    n = F.col("n")
    tail = (n - 1) % block_len + 1

    def at_each(size: Column) -> Column:
        """States of the runs of ``size`` returns from each start, past the end as well."""
        run = lambda i: F.transform(F.sequence(F.lit(0).cast("bigint"), size - 1), lambda o: F.get(F.col("rets"), ((i + o) % n).cast("int")))
        return F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: states.of_returns(run(i)))

    whole = F.when(n >= block_len, at_each(F.lit(block_len).cast("bigint")))  # else the last block is the only one
    packed = _packed(returns).withColumns({"whole": whole, "last": at_each(tail)}).drop("rets")
    ends = F.ceil(n / block_len).cast("int") - 1

    # Starts, then states, then the merge: each is an array, so that none is computed again per use.
    starts = F.transform(_blocks(block_len), lambda k: F.struct(k.alias("k"), block_start(F.col("b"), k, n, seed).cast("int").alias("at")))
    drawn = _grouped(packed, n_boot).withColumn("starts", starts)
    parts = F.transform("starts", lambda s: F.when(s["k"] == ends, F.get("last", s["at"])).otherwise(F.get("whole", s["at"])))
    drawn = drawn.select(*_PAIR, "b", states.merged(parts).alias("state"))
    found = states.metrics(F.col("state"), periods)
    return drawn.select(*_PAIR, "b", *[found[m].alias(m) for m in METRICS])


def confidence_interval(samples: DataFrame, metrics: list[str], ci: float = 0.90) -> DataFrame:
    """Exact linear quantile bounds of each metric over the resampled paths."""
    tail = (1.0 - ci) / 2.0
    sides = (("lo", tail), ("hi", 1.0 - tail))
    return samples.groupBy(*_PAIR).agg(
        *[F.percentile(m, F.lit(q)).alias(f"{m}_{side}") for m in metrics for side, q in sides]
    )


def bootstrap_ci(
    returns: DataFrame,
    n_boot: int = 1000,
    block_len: int = 10,
    seed: int = 0,
    ci: float = 0.90,
    metrics: tuple[str, ...] = ("sharpe", "total_return"),
) -> DataFrame:
    """Point estimate and interval of the named ``METRICS``."""
    samples = bootstrap_metrics(returns, n_boot, block_len, seed)
    found = states.metrics(states.of_returns(F.col("rets")))
    point = _packed(returns).select(*_PAIR, *[found[m].alias(m) for m in metrics])
    return point.join(confidence_interval(samples, list(metrics), ci), _PAIR)
