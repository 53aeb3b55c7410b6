"""Combined documents: members of every kind, and panels that lack some."""

import json

from helpers import day
from pyspark.sql import functions as F

from panelworks.operators import export


def test_members_nest_and_may_be_absent(spark):
    days = spark.createDataFrame([("p", day(1), 2.0), ("p", day(0), None), ("q", day(0), 1.0)], "panel_id string, date date, v double")
    books = spark.createDataFrame([("p", "b", 1), ("p", "a", 2)], "panel_id string, name string, n int")
    docs = export.combined_documents({
        "curve": export.Part(days, F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), "v"), order=F.col("date")),
        "report.books": export.Part(books, F.struct("n"), name=F.col("name")),
        "report.first": export.Part(books.filter("name = 'a'"), F.col("n")),
    })
    got = {r.panel_id: json.loads(r.document) for r in docs.collect()}
    assert got == {
        "p": {"curve": [{"date": "2024-01-01", "v": None}, {"date": "2024-01-02", "v": 2.0}], "report": {"books": {"a": {"n": 2}, "b": {"n": 1}}, "first": 2}},
        "q": {"curve": [{"date": "2024-01-01", "v": 1.0}], "report": {"books": {}, "first": None}},
    }


def test_one_grouping_gathers_all_members(spark):
    rows = spark.range(10).selectExpr("cast(id % 3 as string) panel_id", "id k")
    parts = {f"m{i}": export.Part(rows, F.col("k"), order=F.col("k")) for i in range(4)}
    plan = export.combined_documents(parts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
