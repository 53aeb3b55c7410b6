"""Small frames for hand-computed cases."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from panelworks.operators import panel

DAY0 = date(2024, 1, 1)


def day(i: int) -> date:
    return DAY0 + timedelta(days=i)


def prices(spark, columns: dict[str, list], panel_id: str = "p"):
    """Sparse price rows from name -> closes; None means no row."""
    rows = [
        (panel_id, name, k, day(i), float(v))
        for k, (name, values) in enumerate(columns.items())
        for i, v in enumerate(values)
        if v is not None
    ]
    return spark.createDataFrame(rows, "panel_id string, symbol string, ord int, date date, close double")


def indexed(spark, columns, panel_id="p"):
    return panel.indexed(prices(spark, columns, panel_id))


def labels(spark, seq, path_id="a"):
    rows = [("p", path_id, i, day(i), r) for i, r in enumerate(seq)]
    return spark.createDataFrame(rows, "panel_id string, path_id string, pos int, date date, regime string")


def returns(spark, configs: dict[str, list]):
    rows = [("p", c, i, day(i), None if v is None else float(v)) for c, values in configs.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "panel_id string, config_id string, pos int, date date, ret double")


def calendar(spark, n: int):
    df = spark.range(n).select(F.lit("p").alias("panel_id"), F.col("id").cast("int").alias("pos"))
    return df.withColumns(
        {"date": F.date_add(F.lit(DAY0), F.col("pos")), "n_dates": F.lit(n), "n_names": F.lit(1)}
    )


def ordered(df, *keys):
    return df.orderBy(*keys).collect()
