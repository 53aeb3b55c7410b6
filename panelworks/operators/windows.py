"""Evaluation windows.

Membership follows from a row's position and its calendar length alone, so each
calendar row is expanded into the windows it belongs to: no range join and no
shuffle. Leftover head rows that fill no whole window are in no test window.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walk_forward_windows(cal: DataFrame, n_windows: int, embargo: int = 5) -> DataFrame:
    """``(panel_id, window_id, role, pos, date)`` for ``n_windows`` equal test
    windows over the tail; training rows end ``embargo`` rows before each test."""
    if n_windows < 1:
        return cal.limit(0).select("panel_id", F.lit(0).alias("window_id"), F.lit("").alias("role"), "pos", "date")
    size = F.floor(F.col("n_dates") / n_windows).cast("int")
    past_head = F.col("pos") - (F.col("n_dates") - size * n_windows)
    first_train = F.greatest(F.floor((past_head + embargo) / size).cast("int") + 1, F.lit(0))
    test = F.when(
        past_head >= 0, F.array(F.struct(F.floor(past_head / size).cast("int").alias("window_id"), F.lit("test").alias("role")))
    )
    train = F.when(
        first_train < n_windows,
        F.transform(
            F.sequence(first_train, F.lit(n_windows - 1)),
            lambda k: F.struct(k.alias("window_id"), F.lit("train").alias("role")),
        ),
    )
    none = F.array().cast("array<struct<window_id:int,role:string>>")
    member = F.concat(F.coalesce(test, none), F.coalesce(train, none))
    return cal.filter(F.col("n_dates") >= n_windows).select("panel_id", "pos", "date", F.inline(member)).select(
        "panel_id", "window_id", "role", "pos", "date"
    )


def combinatorial_windows(cal: DataFrame, n_groups: int = 6, n_test: int = 2, embargo: int = 5) -> DataFrame:
    """Every choice of ``n_test`` of ``n_groups`` contiguous groups as the test
    union; training is the rest minus ``embargo`` rows on both sides of each group."""
    if not 1 <= n_test <= n_groups:
        return walk_forward_windows(cal, 0)
    size = F.floor(F.col("n_dates") / n_groups).cast("int")
    head = F.col("n_dates") - size * n_groups
    splits = F.array(
        *[
            F.struct(F.lit(i).alias("window_id"), F.array(*[F.lit(g) for g in chosen]).alias("groups"))
            for i, chosen in enumerate(combinations(range(n_groups), n_test))
        ]
    )
    start = lambda g: head + g * size
    inside = F.exists("groups", lambda g: (F.col("pos") >= start(g)) & (F.col("pos") < start(g) + size))
    near = F.exists(
        "groups", lambda g: (F.col("pos") >= start(g) - embargo) & (F.col("pos") < start(g) + size + embargo)
    )
    return (
        cal.filter(F.col("n_dates") >= n_groups)
        .select("panel_id", "pos", "date", "n_dates", F.inline(splits))
        .withColumn("role", F.when(inside, "test").when(~near, "train"))
        .filter(F.col("role").isNotNull())
        .select("panel_id", "window_id", "role", "pos", "date")
    )
