"""Market features per panel date, all causal.

Per-symbol lags share one (panel, symbol) ordering; the cross-section is then
reduced to one row per (panel, date) by a partial aggregation, and only that
calendar-sized table is windowed by panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import at_offset, carry_forward, ratio, so_far, trailing
from ..schemas import FEATURES
from .panel import by_panel, by_symbol


def trailing_return(prices: DataFrame, lag: int) -> Column:
    """Return over ``lag`` calendar rows; NULL unless both end cells are observed.

    A panel that already carries the column (see :func:`enriched`) is not windowed again.
    """
    if f"trail_{lag}" in prices.columns:
        return F.col(f"trail_{lag}")
    return F.col("close") / at_offset("close", by_symbol(), -lag) - 1.0


def simple_returns(prices: DataFrame) -> DataFrame:
    """One-row returns of an indexed panel."""
    return prices.withColumn("ret", trailing_return(prices, 1))


def forward_returns(prices: DataFrame) -> DataFrame:
    """Return earned from this row to the next calendar row, NULL if unobserved."""
    return prices.withColumn("next_ret", at_offset("close", by_symbol(), 1) / F.col("close") - 1.0)


def _rebased(prices: DataFrame) -> Column:
    if "rebased" in prices.columns:
        return F.col("rebased")
    return F.col("close") / F.first("close").over(so_far(by_symbol()))


def enriched(prices: DataFrame, lags: tuple[int, ...] = (1, 10, 20, 30)) -> DataFrame:
    """Every per-name window in one pass: trailing returns, forward return, rebased price.

    One shuffle by (panel, name) then serves all strategies, features and accounting.
    """
    columns = {f"trail_{k}": trailing_return(prices, k) for k in lags}
    return forward_returns(prices.withColumns({**columns, "rebased": _rebased(prices)}))


def market_daily(prices: DataFrame, breadth_window: int = 20) -> DataFrame:
    """Everything market-wide in one partial aggregation to (panel, date).

    Equal-weight market return, breadth, dispersion, and the equal-weight index:
    each name over its first price, averaged over the names priced that day.
    """
    names = prices.withColumns(
        {"ret": trailing_return(prices, 1), "cum": trailing_return(prices, breadth_window), "base": _rebased(prices)}
    )
    return names.groupBy("panel_id", "pos", "date").agg(
        F.avg("ret").alias("market_return"),
        ratio(F.count_if(F.col("cum") > 0).cast("double"), F.count("cum").cast("double")).alias("breadth"),
        F.stddev_pop("cum").alias("dispersion"),
        F.avg("base").alias("index_value"),
    )


def _full_window(agg: Column, value: str, rows: int) -> Column:
    frame = trailing(by_panel(), rows)
    return F.when(F.count(value).over(frame) == rows, agg.over(frame))


def market_windows(daily: DataFrame, vol_window: int = 20, trend_window: int = 20) -> DataFrame:
    """Rolling volatility and trend strength of the market return.

    Volatility is NULL until its window is full; trend strength is 0 wherever
    the deviation is zero or undefined.
    """
    r = "market_return"
    sd = _full_window(F.stddev_pop(r), r, trend_window)
    mean = _full_window(F.avg(r), r, trend_window)
    return daily.withColumns(
        {
            "realized_vol": _full_window(F.stddev_pop(r), r, vol_window),
            "trend_strength": F.coalesce(F.when(sd > 0, mean / sd), F.lit(0.0)),
        }
    )


def feature_panel(daily: DataFrame, vol_window: int = 20, trend_window: int = 20) -> DataFrame:
    """The four features per date of a market table, carried forward, then zero-filled.

    Warm-up rows stay: trend strength is 0 there, so no row is entirely missing.
    """
    return fill_features(market_windows(daily, vol_window, trend_window), FEATURES).select(
        "panel_id", "pos", "date", *FEATURES
    )


def fill_features(df: DataFrame, cols) -> DataFrame:
    """Carry the last known value forward, then 0."""
    return df.withColumns({c: F.coalesce(carry_forward(c, by_panel()), F.lit(0.0)) for c in cols})


def risk_off(daily: DataFrame, ma_window: int = 50, dd_threshold: float = 0.10) -> DataFrame:
    """Drawdown, moving average and the risk-off flag for every date at once.

    Risk-off means strictly more than ``dd_threshold`` below the running peak, or
    strictly below the mean of the last ``ma_window`` observations once that many
    exist. Dates without an index value do not count as observations.
    """
    seen = daily.select("panel_id", "pos", "date", "index_value").filter(F.col("index_value").isNotNull())
    obs = F.count("index_value").over(so_far(by_panel()))
    ma = F.when(obs >= ma_window, F.avg("index_value").over(trailing(by_panel(), ma_window)))
    return seen.withColumns(
        {
            "drawdown": F.col("index_value") / F.max("index_value").over(so_far(by_panel())) - 1.0,
            "moving_average": ma,
        }
    ).withColumn(
        "risk_off",
        (F.col("drawdown") < -dd_threshold)
        | F.coalesce(F.col("index_value") < F.col("moving_average"), F.lit(False)),
    )
