"""Portfolio accounting as set operations.

Weights decided on calendar row ``p`` earn the return from ``p`` to ``p + 1`` and
are charged there, so nothing sees its own day. Turnover compares successive
targets; weights do not drift.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import at_offset, compounded, ratio, sharpe, so_far, sortino, win_rate
from .features import forward_returns

FEE_BPS = 10.0
SLIPPAGE_BPS = 5.0
CAPITAL = 10_000.0


def by_config() -> WindowSpec:
    return Window.partitionBy("panel_id", "config_id").orderBy("pos")


def with_forward_returns(weights: DataFrame, prices: DataFrame) -> DataFrame:
    """Attach the return each weight earns, for weights that do not carry it."""
    earned = forward_returns(prices).select("panel_id", "symbol", "pos", "next_ret")
    return weights.join(earned, ["panel_id", "symbol", "pos"], "left")


def target_changes(weights: DataFrame) -> DataFrame:
    """One row per name and date whose target changed or which earned a return.

    A name absent from the next calendar row exits there, which adds a row.
    """
    w = Window.partitionBy("panel_id", "config_id", "symbol").orderBy("pos")
    seen = weights.withColumns(
        {
            "before": F.coalesce(at_offset("w", w, -1), F.lit(0.0)),
            "stays": F.coalesce(F.lead("pos").over(w) == F.col("pos") + 1, F.lit(False)),
        }
    )
    held = F.struct(
        (F.col("pos") + 1).alias("pos"),
        F.abs(F.col("w") - F.col("before")).alias("change"),
        (F.col("w") * F.coalesce("next_ret", F.lit(0.0))).alias("earned"),
    )
    left = F.struct((F.col("pos") + 2).alias("pos"), F.abs("w").alias("change"), F.lit(0.0).alias("earned"))
    moves = F.when(F.col("stays"), F.array(held)).otherwise(F.array(held, left))
    return seen.select("panel_id", "config_id", "symbol", F.inline(moves))


def daily_turnover(weights: DataFrame) -> DataFrame:
    """Turnover and gross return per configuration and earning date."""
    return target_changes(weights).groupBy("panel_id", "config_id", "pos").agg(
        F.sum("change").alias("turnover"), F.sum("earned").alias("gross")
    )


def spine(cal: DataFrame, config_ids: list[str]) -> DataFrame:
    """Every calendar row of every configuration, cash days included."""
    ids = F.array(*[F.lit(c) for c in config_ids])
    return cal.select("panel_id", "pos", "date", F.explode(ids).alias("config_id"))


def daily_accounting(
    weights: DataFrame,
    days: DataFrame,
    fee_bps: float = FEE_BPS,
    slippage_bps: float = SLIPPAGE_BPS,
    capital: float = CAPITAL,
) -> DataFrame:
    """Turnover, cost, net return, equity and drawdown per configuration and date.

    ``days`` is the spine of (panel, configuration, date) rows. The first row has
    no return. Only calendar-sized groups are windowed.
    """
    rate = (fee_bps + slippage_bps) / 10_000.0
    traded = F.col("pos") > 0
    daily = (
        days.join(daily_turnover(weights), ["panel_id", "config_id", "pos"], "left")
        .withColumns(
            {
                "turnover": F.when(traded, F.coalesce("turnover", F.lit(0.0))),
                "gross": F.when(traded, F.coalesce("gross", F.lit(0.0))),
            }
        )
        .withColumn("cost", F.col("turnover") * rate)
        .withColumn("ret", F.col("gross") - F.col("cost"))
    )
    grown = daily.withColumn(
        "equity", F.lit(capital) * F.product(1.0 + F.coalesce("ret", F.lit(0.0))).over(so_far(by_config()))
    )
    return grown.withColumn("drawdown", ratio("equity", F.max("equity").over(so_far(by_config()))) - 1.0)


def trades(daily: DataFrame) -> DataFrame:
    """Dates on which targets changed."""
    return daily.filter(F.col("turnover") > 0).select("panel_id", "config_id", "date", "turnover", "cost")


def metrics(daily: DataFrame) -> DataFrame:
    """Metric bundle per configuration: one partial aggregation."""
    return daily.groupBy("panel_id", "config_id").agg(
        sharpe("ret").alias("sharpe"),
        sortino("ret").alias("sortino"),
        F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        win_rate("ret").alias("win_rate"),
        F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("turnover"),
        F.coalesce(
            ratio(F.max_by("equity", "pos"), F.min_by("equity", "pos")) - 1.0, F.lit(0.0)
        ).alias("total_return"),
    )


def regime_pnl(daily: DataFrame, path: DataFrame) -> DataFrame:
    """Realised return per regime, labelled on the return date.

    ``path(panel_id, pos, regime)`` is the raw label, not the routed one; dates
    without a label fall under ``unclassified``. Where both carry ``path_id``, each
    row meets the labels of its own path.
    """
    keys = ["panel_id", "pos", *(["path_id"] if "path_id" in daily.columns and "path_id" in path.columns else [])]
    labelled = (
        daily.filter(F.col("ret").isNotNull())
        .join(path.select(*keys, "regime"), keys, "left")
        .withColumn("regime", F.coalesce("regime", F.lit("unclassified")))
    )
    buckets = labelled.groupBy("panel_id", "config_id", "regime").agg(
        F.count("*").alias("days"), compounded("ret").alias("total_return"), F.avg("ret").alias("mean_return")
    )
    whole = F.sum("total_return").over(Window.partitionBy("panel_id", "config_id"))
    return buckets.withColumn("share_of_pnl", F.coalesce(ratio("total_return", whole), F.lit(0.0)))
