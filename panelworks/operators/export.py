"""JSON documents built by Spark, one per row; write them with ``write.text``.

Daily curves are calendar-bounded and may be gathered into one document. Weights
are not bounded by the calendar and are exported as one line per holding.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regime import stance

VERSION = 1
KEEP_NULLS = {"ignoreNullFields": "false"}


def _day(c: str = "date") -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _curve(value: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(_day().alias("date"), F.col(value).alias("value"))))


def result_documents(daily: DataFrame, metrics: DataFrame, meta: DataFrame) -> DataFrame:
    """Strategy name, metrics, equity, returns and meta per panel and configuration.

    ``meta`` is ``(panel_id, n_assets, fee_bps, slippage_bps)``; NULL values are
    written as null.
    """
    keys = ["panel_id", "config_id"]
    curves = daily.groupBy(*keys).agg(_curve("equity").alias("equity"), _curve("ret").alias("returns"))
    names = [c for c in metrics.columns if c not in keys]
    doc = F.struct(
        F.col("config_id").alias("strategy_name"),
        F.struct(*names).alias("metrics"),
        "equity",
        "returns",
        F.struct(*[c for c in meta.columns if c != "panel_id"]).alias("meta"),
    )
    return curves.join(metrics, keys).join(meta, "panel_id").select(
        *keys, F.to_json(doc, KEEP_NULLS).alias("document")
    )


def weight_lines(weights: DataFrame) -> DataFrame:
    """One JSON line per held name and date."""
    held = weights.filter(F.col("w").isNotNull())
    line = F.to_json(F.struct("panel_id", "config_id", _day().alias("date"), "symbol", F.col("w").alias("weight")))
    return held.select(line.alias("document"))


def table_document(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Rows of a parameter-sized table (windows, configurations) as one array per key."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in (*keys, *order)])))
    return df.groupBy(*keys).agg(F.to_json(F.struct(rows.alias(name)), KEEP_NULLS).alias("document"))


def read_struct() -> Column:
    """Flat read record with fields in alphabetical order."""
    return F.struct(
        "attribution",
        "confidence",
        _day().alias("date"),
        "features",
        "posterior",
        stance(F.col("regime"), F.col("risk_off")).alias("recommended_stance"),
        "regime",
        "risk_off",
    )


def sort_map(c: str) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(c)))


def _sorted_maps(reads: DataFrame) -> DataFrame:
    return reads.withColumns({m: sort_map(m) for m in ("attribution", "features", "posterior")})


def _read_keys(reads: DataFrame) -> list[str]:
    return [c for c in ("panel_id", "path_id", "date") if c in reads.columns]


def flat_reads(reads: DataFrame) -> DataFrame:
    """One JSON record per read without an envelope: sorted keys, compact."""
    return _sorted_maps(reads).select(*_read_keys(reads), F.to_json(read_struct(), KEEP_NULLS).alias("document"))


def read_documents(reads: DataFrame, service: str, job_id: Column | None = None) -> DataFrame:
    """Versioned envelope per read: sorted keys, compact, no job id when NULL."""
    job = F.lit(None).cast("bigint") if job_id is None else job_id
    envelope = F.struct(
        job.alias("job_id"), read_struct().alias("read"), F.lit(service).alias("service"), F.lit(VERSION).alias("version")
    )
    return _sorted_maps(reads).select(*_read_keys(reads), F.to_json(envelope).alias("document"))


@dataclass(frozen=True)
class Part:
    """One member of a combined document: ``item`` of every row. With ``name`` the items are an object by
    that key, with ``order`` a list in that order, with neither the single row's item."""

    rows: DataFrame
    item: Column
    name: Column | None = None
    order: Column | None = None


def combined_documents(parts: dict[str, Part], key: str = "panel_id") -> DataFrame:
    """One nested JSON document per key from several tables.

    The rows of all tables are tagged and stacked, and one grouping by key gathers every member, so no
    table is joined to another. Members are parameter-sized or bounded by the calendar. Dotted names nest;
    members without rows are empty lists or objects, or null.
    """

    def tagged(name: str, part: Part) -> DataFrame:
        place = part.name if part.name is not None else part.order if part.order is not None else F.lit(0)
        return part.rows.select(F.col(key), F.struct(place.alias("at"), part.item.alias("item")).alias(name))

    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [tagged(f"part{i}", p) for i, p in enumerate(parts.values())])
    gathered = stacked.groupBy(key).agg(*[F.collect_list(f"part{i}").alias(f"part{i}") for i in range(len(parts))])
    earlier = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)
    tree: dict = {}
    for i, (name, part) in enumerate(parts.items()):
        rows = F.array_sort(f"part{i}", earlier)
        if part.name is not None:
            member = F.map_from_entries(F.transform(rows, lambda r: F.struct(r["at"], r["item"])))
        elif part.order is not None:
            member = F.transform(rows, lambda r: r["item"])
        else:
            member = F.get(rows, F.lit(0))["item"]
        *above, last = name.split(".")
        reduce(lambda node, step: node.setdefault(step, {}), above, tree)[last] = member

    def nested(node: dict) -> Column:
        return F.struct(*[(nested(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    return gathered.select(key, F.to_json(nested(tree), KEEP_NULLS).alias("document"))


def regime_artifact(path: DataFrame, attribution: DataFrame, metrics: DataFrame, daily: DataFrame) -> DataFrame:
    """Per panel: the labels of one path by date, the return of one configuration per regime, and the
    metrics and equity curve of every configuration.

    ``path(panel_id, date, regime)``, ``attribution`` as ``portfolio.regime_pnl`` gives it for one
    configuration, ``metrics`` and ``daily`` of all.
    """
    keys = ["panel_id", "config_id"]
    names = [c for c in metrics.columns if c not in keys]
    curves = daily.groupBy(*keys).agg(_curve("equity").alias("equity"))
    return combined_documents({
        "regime_path": Part(path, F.struct(_day().alias("date"), "regime"), order=F.col("date")),
        "regime_attribution": Part(attribution, F.struct("days", "total_return", "mean_return", "share_of_pnl"), name=F.col("regime")),
        "strategies": Part(metrics.join(curves, keys), F.struct(F.struct(*names).alias("metrics"), "equity"), name=F.col("config_id")),
    })


def validation_artifact(prices: DataFrame, counts: DataFrame, report: dict[str, DataFrame]) -> DataFrame:
    """Per panel: its days and names, label counts of every path, the selection with its windows, test
    metrics of every configuration, and the deflated Sharpe ratio and intervals of the selected one.

    ``prices(panel_id, symbol, ord, date)``, ``counts`` as ``regime.label_counts`` gives them, ``report``
    as ``workflows.out_of_sample`` does.
    """
    days = prices.groupBy("panel_id").agg(F.count_distinct("date").alias("days"))
    symbols = prices.groupBy("panel_id", "symbol").agg(F.min("ord").alias("ord"))
    by_path = counts.groupBy("panel_id", "path_id").agg(F.map_from_entries(F.collect_list(F.struct("regime", "days"))).alias("counts"))
    oos, ci = report["oos"], report["intervals"]
    metrics = [c for c in oos.columns if c not in ("panel_id", "n_trials")]
    windows = F.struct(*[c for c in report["selection"].columns if c != "panel_id"])
    interval = lambda m: F.struct(F.col(m).alias("point"), F.col(f"{m}_lo").alias("lo"), F.col(f"{m}_hi").alias("hi"))
    means = [c for c in report["per_config"].columns if c not in ("panel_id", "config_id")]
    return combined_documents({
        "panel.days": Part(days, F.col("days")),
        "panel.symbols": Part(symbols, F.col("symbol"), order=F.col("ord")),
        "regime_value_counts": Part(by_path, F.col("counts"), name=F.col("path_id")),
        "selection.per_window": Part(report["selection"], windows, order=F.col("window_id")),
        "selection.oos": Part(oos, F.struct(*metrics)),
        "selection.n_trials": Part(oos, F.col("n_trials")),
        "selection.selected_variant": Part(report["selected"], F.col("selected")),
        "per_config_oos": Part(report["per_config"], F.struct(*means), name=F.col("config_id")),
        "deflated_sharpe": Part(report["deflated_sharpe"], F.struct(F.col("dsr").alias("value"), "n_trials", F.col("sr_var").alias("sr_variance"))),
        "bootstrap": Part(ci, F.struct(interval("sharpe").alias("sharpe"), interval("total_return").alias("total_return"))),
    })
