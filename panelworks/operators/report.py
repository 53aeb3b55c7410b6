"""Reporting tables shaped for presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio


def equity_table(daily: DataFrame, path: DataFrame, config_ids: list[str], path_ids: list[str] | None = None) -> DataFrame:
    """One row per panel date, one equity column per configuration, with its label: of the only path, or of
    each path named in ``path_ids`` as ``<path_id>_regime``."""
    wide = daily.groupBy("panel_id", "date").pivot("config_id", config_ids).agg(F.first("equity"))
    if path_ids is None:
        return wide.join(path.select("panel_id", "date", "regime"), ["panel_id", "date"], "left")
    labels = path.groupBy("panel_id", "date").pivot("path_id", path_ids).agg(F.first("regime"))
    return wide.join(labels.select("panel_id", "date", *[F.col(p).alias(f"{p}_regime") for p in path_ids]), ["panel_id", "date"], "left")


def rebased(daily: DataFrame) -> DataFrame:
    """Equity as percent gain over the first value of each curve."""
    first = Window.partitionBy("panel_id", "config_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    base = F.first("equity", ignorenulls=True).over(first)
    return daily.select(
        "panel_id", "config_id", "date", ((ratio("equity", base) - 1.0) * 100.0).alias("pct_return")
    )


def cash_share(daily: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Share of steps whose equity did not move."""
    w = Window.partitionBy("panel_id", "config_id").orderBy("date")
    moved = daily.withColumn("step", F.abs(F.col("equity") - F.lag("equity").over(w)))
    return moved.groupBy("panel_id", "config_id").agg(
        F.count_if(F.col("step") < tolerance).alias("flat_days"),
        ratio(F.count_if(F.col("step") < tolerance).cast("double"), (F.count("*") - 1).cast("double")).alias("cash_share"),
    )


def regime_day_share(pnl: DataFrame) -> DataFrame:
    """Days per regime as a share of all attributed days."""
    whole = F.sum("days").over(Window.partitionBy("panel_id", "config_id"))
    return pnl.select("panel_id", "config_id", "regime", "days", (F.col("days") / whole).alias("day_share"))


def drawdown_breaches(oos: DataFrame, market: str = "equal_weight", cap: float = 0.30) -> DataFrame:
    """Each configuration against the drawdown cap and the market configuration."""
    base = oos.filter(F.col("config_id") == market).select(
        "panel_id", F.col("mean_sharpe").alias("base_sharpe"), F.col("mean_max_drawdown").alias("base_drawdown")
    )
    return oos.join(base, "panel_id", "left").select(
        "panel_id",
        "config_id",
        F.abs("mean_max_drawdown").alias("drawdown"),
        (F.abs("mean_max_drawdown") > cap).alias("breaches"),
        ratio("base_drawdown", "mean_max_drawdown").alias("drawdown_ratio"),
        (F.col("mean_sharpe") - F.col("base_sharpe")).alias("sharpe_edge"),
    )
