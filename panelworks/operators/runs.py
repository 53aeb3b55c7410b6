"""Run lengths, debouncing and bands over ordered label sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import so_far


def run_length(df: DataFrame, value: str, by: list[str], order: str = "pos") -> DataFrame:
    """Add ``run``: how many consecutive rows, this one included, share ``value``.

    One ordering serves every step: the row number minus that of the last change.
    """
    w = Window.partitionBy(*by).orderBy(order)
    marked = df.withColumns(
        {"_n": F.row_number().over(w), "_same": F.col(value).eqNullSafe(F.lag(value).over(w))}
    )
    # The first row compares with nothing, so it always opens a run.
    start = F.when((F.col("_n") == 1) | ~F.col("_same"), F.col("_n"))
    return marked.withColumn(
        "run", F.col("_n") - F.last(start, ignorenulls=True).over(so_far(w)) + 1
    ).drop("_n", "_same")


def debounce(
    df: DataFrame,
    value: str,
    confirm: int | Column,
    default: Column,
    by: list[str],
    out: str,
    order: str = "pos",
) -> DataFrame:
    """The last value that held for ``confirm`` consecutive rows, else ``default``.

    With labels this is routing hysteresis; with booleans a confirmed gate.
    ``confirm`` may be a column, so configurations with different settings are
    evaluated together.
    """
    w = Window.partitionBy(*by).orderBy(order)
    settled = F.when(F.col("run") >= confirm, F.col(value))
    return (
        run_length(df, value, by, order)
        .withColumn(out, F.coalesce(F.last(settled, ignorenulls=True).over(so_far(w)), default))
        .drop("run")
    )


def hysteresis(df: DataFrame, by: list[str], h: int | Column = 3, default: Column | None = None) -> DataFrame:
    """Active regime per row of a labelled path; ``ranging`` until one settles."""
    return debounce(df, "regime", h, F.lit("ranging") if default is None else default, by, "active")


def confirmed_gate(df: DataFrame, by: list[str], confirm: int | Column = 1) -> DataFrame:
    """Risk gate that flips only after ``confirm`` equal reads; starts open."""
    return debounce(df, "risk_off", confirm, F.lit(False), by, "gate")


def bands(df: DataFrame, by: list[str], order: str = "date") -> DataFrame:
    """Consecutive equal labels collapsed to (from, to, regime); NULL is ``unclassified``."""
    w = Window.partitionBy(*by).orderBy(order)
    labelled = df.select(*by, order, F.coalesce("regime", F.lit("unclassified")).alias("regime"))
    opened = labelled.withColumn(
        "_open", F.when(F.col("regime") != F.lag("regime").over(w), 1).otherwise(0)
    ).withColumn("_band", F.sum("_open").over(so_far(w)))
    return (
        opened.groupBy(*by, "_band", "regime")
        .agg(F.min(order).alias("from_date"), F.max(order).alias("to_date"), F.count("*").alias("n_days"))
        .drop("_band")
    )
