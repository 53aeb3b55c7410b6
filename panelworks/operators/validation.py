"""Out-of-sample evaluation and train-only configuration selection.

Paths are causal, so returns are computed once per configuration and sliced by
window membership.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import FLAT, per_period_sharpe, so_far
from ..functions.normal import phi, phi_inv
from ..session import materialize
from . import states

METRICS = ("total_return", "sharpe", "sortino", "max_drawdown")
_KEYS = ["panel_id", "config_id", "window_id", "role"]


def segments(windows: DataFrame) -> DataFrame:
    """``(panel_id, pos, segment)``: maximal runs of dates that belong to the same windows and roles. Any
    window is a sequence of whole segments."""
    mine = windows.groupBy("panel_id", "pos").agg(F.array_sort(F.collect_set(F.struct("window_id", "role"))).alias("members"))
    w = Window.partitionBy("panel_id").orderBy("pos")
    goes_on = F.col("members").eqNullSafe(F.lag("members").over(w)) & (F.lag("pos").over(w) == F.col("pos") - 1)
    numbered = mine.withColumn("opens", F.coalesce((~goes_on).cast("int"), F.lit(1)))
    return numbered.select("panel_id", "pos", F.sum("opens").over(so_far(w)).alias("segment"))


def window_metrics(returns: DataFrame, windows: DataFrame) -> DataFrame:
    """Metrics per configuration, window and role on an equity path rebuilt inside
    the window. Its drawdown starts at the first equity after a return.

    Returns are reduced once to a state per segment, and a window merges the states of its segments, so
    the work does not grow with the number of windows a date belongs to.
    """
    pieces = materialize(segments(windows))
    rows = returns.filter(F.col("ret").isNotNull()).select("panel_id", "config_id", "pos", "ret")
    inside = rows.join(pieces, ["panel_id", "pos"]).groupBy("panel_id", "config_id", "segment")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "ret"))), lambda x: x["ret"])
    own = inside.agg(ordered.alias("rets")).select("panel_id", "config_id", "segment", states.of_returns(F.col("rets")).alias("state"))
    members = windows.join(pieces, ["panel_id", "pos"]).select("panel_id", "segment", "window_id", "role").distinct()
    gathered = own.join(members, ["panel_id", "segment"]).groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("segment", "state"))).alias("parts"))
    whole = gathered.select(*_KEYS, states.merged(F.transform("parts", lambda x: x["state"])).alias("state"))
    found = states.metrics(F.col("state"))
    return whole.select(*_KEYS, F.col("state.n").cast("bigint").alias("n_days"), *[found[m].alias(m) for m in METRICS])


def evaluate_windows(returns: DataFrame, windows: DataFrame) -> DataFrame:
    """Test metrics per configuration and window; windows without returns stay as zeros."""
    tests = windows.filter("role = 'test'")
    bounds = tests.groupBy("panel_id", "window_id").agg(
        F.min("date").alias("test_start"), F.max("date").alias("test_end")
    )
    configs = returns.select("panel_id", "config_id").distinct()
    scored = window_metrics(returns, tests).drop("role")
    filled = configs.join(bounds, "panel_id").join(scored, ["panel_id", "config_id", "window_id"], "left")
    return filled.select(
        "panel_id",
        "config_id",
        "window_id",
        "test_start",
        "test_end",
        F.coalesce("n_days", F.lit(0).cast("bigint")).alias("n_days"),
        *[F.coalesce(m, F.lit(0.0)).alias(m) for m in METRICS],
    )


def train_scores(returns: DataFrame, windows: DataFrame, metric: str = "sharpe") -> DataFrame:
    """Training metric per configuration and window; no row means no training data,
    which can never win a selection."""
    train = windows.filter("role = 'train'")
    return window_metrics(returns, train).select("panel_id", "config_id", "window_id", F.col(metric).alias("score"))


def select_config(
    returns: DataFrame, windows: DataFrame, config_order: list[str], metric: str = "sharpe", decimals: int | None = 10
) -> DataFrame:
    """Best configuration on each training window with its test metrics.

    Ties go to the first in ``config_order``; windows without training rows are
    skipped. Variants often hold identical books, whose scores then differ only by
    summation order, so scores are compared at ``decimals`` places (None: in full).
    The winner is an aggregate, not a sort.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in config_order]), F.col("config_id"))
    kept = returns.filter(F.col("config_id").isin(config_order))
    score = F.col("score") if decimals is None else F.round("score", decimals)
    best = (
        train_scores(kept, windows, metric)
        .groupBy("panel_id", "window_id")
        .agg(F.max_by("config_id", F.struct(score, -rank)).alias("config_id"))
    )
    return best.join(evaluate_windows(kept, windows), ["panel_id", "window_id", "config_id"]).select(
        "panel_id", "window_id", F.col("config_id").alias("chosen"), "n_days", *METRICS
    )


def oos_aggregate(selection: DataFrame, n_trials: int) -> DataFrame:
    """Mean and median of each test metric over the selected windows."""
    return selection.groupBy("panel_id").agg(
        *[F.avg(m).alias(m) for m in METRICS],
        *[F.median(m).alias(f"{m}_median") for m in METRICS],
        F.lit(n_trials).cast("bigint").alias("n_trials"),
    )


def per_config_oos(evaluated: DataFrame) -> DataFrame:
    """Mean test metrics per configuration."""
    return evaluated.groupBy("panel_id", "config_id").agg(
        F.avg("sharpe").alias("mean_sharpe"),
        F.avg("total_return").alias("mean_total_return"),
        F.avg("max_drawdown").alias("mean_max_drawdown"),
    )


def modal_variant(selection: DataFrame, panels: DataFrame, default: str) -> DataFrame:
    """Most often chosen configuration per panel; ties alphabetical, ``default`` if none."""
    counts = selection.groupBy("panel_id", "chosen").agg(F.count("*").alias("n"))
    first = counts.groupBy("panel_id").agg(F.min_by("chosen", F.struct(-F.col("n"), "chosen")).alias("chosen"))
    return panels.select("panel_id").distinct().join(first, "panel_id", "left").select(
        "panel_id", F.coalesce("chosen", F.lit(default)).alias("selected")
    )


def return_moments(returns: DataFrame) -> DataFrame:
    """Count, per-period Sharpe, population skew and raw kurtosis per configuration."""
    r = F.col("ret")
    return returns.groupBy("panel_id", "config_id").agg(
        F.count(r).alias("n_obs"),
        F.stddev_samp(r).alias("sd"),
        per_period_sharpe(r).alias("sr"),
        F.skewness(r).alias("skew"),
        (F.kurtosis(r) + 3.0).alias("kurt"),
    )


def sr_variance(moments: DataFrame) -> DataFrame:
    """Sample variance of the configurations' Sharpe ratios with a floor of 1e-12."""
    return moments.groupBy("panel_id").agg(
        F.greatest(F.coalesce(F.var_samp("sr"), F.lit(0.0)), F.lit(1e-12)).alias("sr_var"),
        F.count("*").alias("n_trials"),
    )


# Euler-Mascheroni constant to the precision the published statistic uses.
EULER = 0.5772156649


def expected_max_sharpe(n_trials: Column, variance: Column) -> Column:
    """Expected best Sharpe of ``n_trials`` skill-less trials; 0 for a single one."""
    n = n_trials.cast("double")
    quantile = (1.0 - EULER) * phi_inv(1.0 - 1.0 / n) + EULER * phi_inv(1.0 - 1.0 / (n * math.e))
    return F.when(n_trials > 1, F.sqrt(variance) * quantile).otherwise(0.0)


def probabilistic_sharpe(sr: Column, benchmark: Column, n_obs: Column, skew: Column, kurt: Column) -> Column:
    """Probability that the true Sharpe exceeds ``benchmark``; 0 where undefined."""
    spread = 1.0 - skew * sr + (kurt - 1.0) / 4.0 * sr * sr
    usable = (n_obs >= 2) & (spread > 0)
    z = (sr - benchmark) * F.sqrt(F.greatest(n_obs - 1, F.lit(0))) / F.sqrt(F.when(usable, spread))
    return F.coalesce(phi(z), F.lit(0.0))


def deflated_sharpe(returns: DataFrame, trials: list[str]) -> DataFrame:
    """Deflated Sharpe of every trialled configuration against the expected best of
    all of them. Flat or single-observation returns give 0."""
    moments = return_moments(returns.filter(F.col("config_id").isin(trials)))
    joined = moments.join(sr_variance(moments), "panel_id")
    benchmark = joined.withColumn("benchmark", expected_max_sharpe(F.col("n_trials"), F.col("sr_var")))
    psr = probabilistic_sharpe(*[F.col(c) for c in ("sr", "benchmark", "n_obs", "skew", "kurt")])
    return benchmark.withColumn(
        "dsr", F.when((F.col("n_obs") >= 2) & (F.col("sd") >= FLAT), psr).otherwise(0.0)
    ).select("panel_id", "config_id", "n_obs", "n_trials", "sr", "skew", "kurt", "sr_var", "benchmark", "dsr")
