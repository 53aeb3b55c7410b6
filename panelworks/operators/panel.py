"""Price panels: slicing, calendars, positions and the dense grid.

The working form is sparse: one row per observed (panel, symbol, date). Calendar
positions count panel dates, so "k rows ago" keeps its dense-grid meaning while
work stays proportional to observed cells. A date key bounds every per-symbol
window to the length of a calendar, however skewed the panels are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_panel() -> WindowSpec:
    """Calendar order of each panel."""
    return Window.partitionBy("panel_id").orderBy("pos")


def by_symbol() -> WindowSpec:
    """Calendar order of each name."""
    return Window.partitionBy("panel_id", "symbol").orderBy("pos")


def in_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive date slice; reaches the parquet scan as a pushed filter."""
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    return df


def price_panel(
    bars: DataFrame, symbols: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Closes of the requested symbols inside ``[start, end]``.

    ``symbols(panel_id, symbol, ord)`` lists each panel's universe; ``bars`` may
    carry its own ``panel_id`` or be shared by all panels. Prices must be
    positive; others are treated as missing.
    """
    keys = [c for c in ("panel_id", "symbol") if c in bars.columns]
    return (
        in_range(bars, start, end)
        .filter(F.col("close") > 0)
        .select(*keys, "date", "close")
        .join(symbols.select("panel_id", "symbol", "ord"), keys)
        .select("panel_id", "symbol", "ord", "date", "close")
    )


def missing_symbols(
    bars: DataFrame, symbols: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Requested symbols with no bar at all inside the slice (the fetch worklist)."""
    keys = [c for c in ("panel_id", "symbol") if c in bars.columns]
    present = in_range(bars, start, end).select(*keys).distinct()
    return symbols.join(present, keys, "left_anti")


def calendar(prices: DataFrame) -> DataFrame:
    """Observed dates per panel with position, length and names priced that day."""
    days = prices.groupBy("panel_id", "date").agg(F.count("*").alias("n_names"))
    w = Window.partitionBy("panel_id")
    return days.select(
        "panel_id",
        "date",
        (F.row_number().over(w.orderBy("date")) - 1).alias("pos"),
        F.count("*").over(w).cast("int").alias("n_dates"),
        "n_names",
    )


def indexed(prices: DataFrame, cal: DataFrame | None = None) -> DataFrame:
    """Prices with calendar position, calendar length and cross-section size."""
    return prices.join(calendar(prices) if cal is None else cal, ["panel_id", "date"])


def dense_grid(prices: DataFrame) -> DataFrame:
    """Every (symbol, date) cell of each panel; ``close`` is NULL where absent.

    Names are expanded over their panel's positions by a sequence, so the work
    is spread by name and equals the size of the requested output.
    """
    cal = calendar(prices)
    names = prices.select("panel_id", "symbol", "ord").distinct()
    lengths = cal.groupBy("panel_id").agg(F.max("n_dates").alias("n_dates"))
    cells = names.join(lengths, "panel_id").select(
        "panel_id", "symbol", "ord", F.explode(F.sequence(F.lit(0), F.col("n_dates") - 1)).alias("pos")
    )
    return (
        cells.join(cal.select("panel_id", "pos", "date"), ["panel_id", "pos"])
        .join(prices.drop("ord"), ["panel_id", "symbol", "date"], "left")
        .select("panel_id", "symbol", "ord", "pos", "date", "close")
    )


def panel_guard(prices: DataFrame) -> DataFrame:
    """Shape of each panel and whether it can be evaluated (>= 2 dates, >= 1 symbol)."""
    shape = prices.groupBy("panel_id").agg(
        F.count_distinct("date").alias("n_dates"), F.count_distinct("symbol").alias("n_symbols")
    )
    return shape.withColumn("accepted", (F.col("n_dates") >= 2) & (F.col("n_symbols") >= 1))


def usable(prices: DataFrame) -> DataFrame:
    """Prices of the panels that pass the guard; the rest are listed by it."""
    good = panel_guard(prices).filter("accepted").select("panel_id")
    return prices.join(good, "panel_id", "left_semi")


def coverage(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Per key and column: non-NULL rows, non-zero rows and whether any is non-zero."""
    aggs = []
    for c in cols:
        aggs += [
            F.count(c).alias(f"{c}_rows"),
            F.count_if(F.col(c) != 0).alias(f"{c}_nonzero"),
            F.coalesce(F.max(F.abs(c)) > 0, F.lit(False)).alias(f"{c}_any"),
        ]
    return df.groupBy(*keys).agg(*aggs)
