"""Alignment of slower series to a spine of dates.

Two different rules are kept apart. Exact alignment discards source dates the
spine does not have before carrying forward; as-of alignment takes the most
recent source row at or before each spine date, whether or not that date is on
the spine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import carry_forward, so_far


def align_exact(
    spine: DataFrame, source: DataFrame, cols: list[str], by: list[str], source_by: tuple[str, ...] = ()
) -> DataFrame:
    """Left join on date, carry forward within ``by``, then 0.

    ``source_by`` names the keys the source is kept per; by default one source is
    shared by all spines.
    """
    keys = [*source_by, "date"]
    w = Window.partitionBy(*by).orderBy("date")
    joined = spine.join(source.select(*keys, *cols), keys, "left")
    return joined.withColumns({c: F.coalesce(carry_forward(c, w), F.lit(0.0)) for c in cols})


def asof_rows(
    spine: DataFrame,
    source: DataFrame,
    cols: list[str],
    source_by: tuple[str, ...] = (),
    whole_row: bool = True,
) -> DataFrame:
    """Backward as-of join: each spine row receives the latest source row with
    ``date`` at or before its own, whole (NULL cells stay NULL). With
    ``whole_row=False`` each column takes its own latest non-NULL value, so several
    sources can be stacked and matched in one pass.

    The match depends only on (key, date), so the spine is first reduced to its
    distinct dates per key. Those are interleaved with the source and the last
    source row is carried along: a window group never exceeds the calendars
    involved, even for a key shared by very many panels. The matches are then
    joined back.
    """
    keys = list(source_by)
    dates = spine.select(*keys, "date").distinct().select(*keys, "date", F.lit(1).alias("side"))
    hits = [F.struct(*cols).alias("hit")] if whole_row else list(cols)
    both = dates.unionByName(
        source.select(*keys, "date", F.lit(0).alias("side"), *hits), allowMissingColumns=True
    ).withColumn("_key", F.struct(F.lit(0), *keys))
    frame = so_far(Window.partitionBy("_key").orderBy("date", "side"))
    carried = both.withColumns(
        {c: F.last(c, ignorenulls=True).over(frame) for c in (["hit"] if whole_row else cols)}
    ).filter("side = 1")
    found = [F.col("hit")[c].alias(c) for c in cols] if whole_row else cols
    return spine.join(carried.select(*keys, "date", *found), [*keys, "date"], "left")


def align_asof(
    spine: DataFrame, source: DataFrame, cols: list[str], by: list[str], source_by: tuple[str, ...] = ()
) -> DataFrame:
    """As-of rows, then carry forward over NULL cells, then 0."""
    w = Window.partitionBy(*by).orderBy("date")
    joined = asof_rows(spine, source, cols, source_by)
    return joined.withColumns({c: F.coalesce(carry_forward(c, w), F.lit(0.0)) for c in cols})
