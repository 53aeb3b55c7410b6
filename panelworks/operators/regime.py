"""Regime scoring against a model table, reads, attribution and stance.

A model is one row; scoring joins it on (panel, refit position) and is plain
column arithmetic on three states, so no row leaves the JVM and no state rows
are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, so_far
from ..schemas import FEATURES, REGIMES
from ..session import materialize
from .hmm import PathSpec, fit_models, latest_jobs, refit_position, training_jobs
from .panel import by_panel

STANCES = {"trending": "momentum", "ranging": "market portfolio", "high_volatility": "defensive"}


def scaler_prefix(
    features: DataFrame, min_train: int = 60, refit_every: int = 5, cols: tuple[str, ...] = FEATURES
) -> DataFrame:
    """Mean and population deviation of each feature over the prefix ending at every
    refit position; a constant feature keeps scale 1."""
    frame = so_far(by_panel())
    stats = {}
    for c in cols:
        sd = F.stddev_pop(c).over(frame)
        stats[f"{c}_center"] = F.avg(c).over(frame)
        stats[f"{c}_scale"] = F.when(sd > 0, sd).otherwise(1.0)
    at_refit = (F.col("pos") >= min_train) & (refit_position(min_train, refit_every) == F.col("pos"))
    return features.withColumns(stats).filter(at_refit).select(
        "panel_id", F.col("pos").alias("refit_pos"), *stats
    )


def refit_schedule(features: DataFrame, min_train: int = 60, refit_every: int = 5) -> DataFrame:
    """Dates that can be labelled with the refit position whose model labels them."""
    return features.filter(F.col("pos") >= min_train).withColumn(
        "refit_pos", refit_position(min_train, refit_every)
    )


def state_order(cols: tuple[str, ...] = FEATURES) -> Column:
    """1-based state indices in regime order: trending, ranging, high volatility.

    The highest mean volatility is high volatility; of the rest the largest mean
    absolute trend is trending. First state wins ties.
    """
    vol, trend = cols.index("realized_vol"), cols.index("trend_strength")
    vols = F.transform("states", lambda s: s["mu"][vol])
    hv = F.array_position(vols, F.array_max(vols)).cast("int")
    trends = F.transform("states", lambda s, i: F.when(i + 1 != hv, F.abs(s["mu"][trend])).otherwise(-1.0))
    tr = F.array_position(trends, F.array_max(trends)).cast("int")
    return F.array(tr, F.lit(6) - hv - tr, hv)


def label_states(models: DataFrame, cols: tuple[str, ...] = FEATURES) -> DataFrame:
    """Replace ``states`` by ``regimes``: the three states in regime order."""
    ordered = F.transform(state_order(cols), lambda i: F.element_at("states", i))
    return models.withColumn("regimes", ordered).drop("states")


def signatures(labelled: DataFrame, cols: tuple[str, ...] = FEATURES) -> DataFrame:
    """Standardised mean of every feature per regime, one row per model and regime."""
    names = F.array(*[F.lit(r) for r in REGIMES])
    return labelled.select(
        "panel_id", "path_id", "refit_pos", F.explode(F.arrays_zip(names.alias("regime"), "regimes")).alias("r")
    ).select(
        "panel_id",
        "path_id",
        "refit_pos",
        F.col("r.regime").alias("regime"),
        *[F.col("r.regimes.mu")[j].alias(c) for j, c in enumerate(cols)],
    )


def posterior(scheduled: DataFrame, labelled: DataFrame, cols: tuple[str, ...] = FEATURES) -> DataFrame:
    """Posterior of each regime for the single current row.

    With one row transitions play no part: start probability times emission,
    normalised in log space. A zero start probability gives posterior 0.
    """
    rows = scheduled.join(labelled.drop("loglik", "trans"), ["panel_id", "refit_pos"])
    rows = rows.withColumns(
        {f"z_{c}": (F.col(c) - F.col("center")[j]) / F.col("scale")[j] for j, c in enumerate(cols)}
    )
    logs = {}
    for k, name in enumerate(REGIMES):
        state = F.col("regimes")[k]
        fit = F.lit(0.0)
        for j, c in enumerate(cols):
            mu, var = state["mu"][j], state["var"][j]
            fit = fit + F.log(2 * math.pi * var) + (F.col(f"z_{c}") - mu) * (F.col(f"z_{c}") - mu) / var
        logs[f"log_{name}"] = F.when(state["start"] > 0, F.log(state["start"]) - 0.5 * fit)
    rows = rows.withColumns(logs)
    peak = F.greatest(*logs)
    mass = {f"p_{r}": F.coalesce(F.exp(F.col(f"log_{r}") - peak), F.lit(0.0)) for r in REGIMES}
    rows = rows.withColumns(mass)
    total = sum((F.col(m) for m in mass), F.lit(0.0))
    return rows.withColumns({m: F.col(m) / total for m in mass}).drop(*logs)


def reads(scored: DataFrame, cols: tuple[str, ...] = FEATURES) -> DataFrame:
    """Label, confidence, posterior, features and attribution per date.

    The first regime in fixed order wins posterior ties.
    """
    p = [F.col(f"p_{r}") for r in REGIMES]
    k = F.when((p[0] >= p[1]) & (p[0] >= p[2]), 0).when(p[1] >= p[2], 1).otherwise(2)
    rows = scored.withColumn("signature", F.get(F.col("regimes"), k)["mu"])
    names = F.array(*[F.lit(r) for r in REGIMES])
    feature_names = F.array(*[F.lit(c) for c in cols])
    parts = [F.col(f"z_{c}") * F.col("signature")[j] for j, c in enumerate(cols)]
    whole = sum((F.abs(part) for part in parts), F.lit(0.0))
    shares = F.array(*[F.coalesce(ratio(part, whole), F.lit(0.0)) for part in parts])
    return rows.select(
        "panel_id",
        "path_id",
        "pos",
        "date",
        F.get(names, k).alias("regime"),
        F.greatest(*p).alias("confidence"),
        F.map_from_arrays(names, F.array(*p)).alias("posterior"),
        F.map_from_arrays(feature_names, F.array(*[F.col(c) for c in cols])).alias("features"),
        F.map_from_arrays(feature_names, shares).alias("attribution"),
    )


def attribution_topk(read: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` largest contributions by absolute value, ranked within each read."""
    entries = F.transform(
        F.map_entries("attribution"), lambda e: F.struct((-F.abs(e["value"])).alias("size"), e["key"], e["value"])
    )
    top = F.slice(F.array_sort(entries), 1, k)
    return read.select("panel_id", "path_id", "date", F.posexplode(top).alias("i", "e")).select(
        "panel_id",
        "path_id",
        "date",
        (F.col("i") + 1).alias("rank"),
        F.col("e.key").alias("feature"),
        F.col("e.value").alias("contribution"),
    )


def attribute(z: Column, signature: Column) -> Column:
    """Signed contribution shares of two maps over the keys present in both."""
    both = F.map_filter(z, lambda k, v: F.map_contains_key(signature, k))
    raw = F.transform_values(both, lambda k, v: v * signature[k])
    whole = F.aggregate(F.map_values(raw), F.lit(0.0), lambda s, v: s + F.abs(v))
    return F.transform_values(raw, lambda k, v: F.coalesce(v / F.nullif(whole, F.lit(0.0)), F.lit(0.0)))


def path_reads(paths: Sequence[PathSpec], min_train: int = 60, refit_every: int = 5, **fit) -> DataFrame:
    """Walk-forward reads of several paths, trained in one table of jobs: every date from ``min_train``
    on, labelled by the path's latest model trained on data up to its refit position."""
    models = materialize(fit_models(training_jobs(paths, min_train, refit_every), **fit))

    def of(path: PathSpec) -> DataFrame:
        labelled = label_states(models.filter(F.col("path_id") == path.path_id), path.cols)
        return reads(posterior(refit_schedule(path.features, min_train, refit_every), labelled, path.cols), path.cols)

    return reduce(DataFrame.unionByName, map(of, paths))


def regime_reads(
    features: DataFrame,
    path_id: str = "baseline",
    min_train: int = 60,
    refit_every: int = 5,
    cols: tuple[str, ...] = FEATURES,
    **fit,
) -> DataFrame:
    """``path_reads`` of a single path."""
    return path_reads([PathSpec(path_id, features, cols)], min_train, refit_every, **fit)


def latest_reads(
    features: DataFrame, path_id: str = "latest", cols: tuple[str, ...] = FEATURES, **fit
) -> DataFrame:
    """Read of each panel's last date by a model trained on its whole history."""
    models = label_states(fit_models(latest_jobs(PathSpec(path_id, features, cols)), **fit), cols)
    return reads(posterior(features.withColumn("refit_pos", F.col("pos")), models, cols), cols)


def label_counts(path: DataFrame) -> DataFrame:
    """Days and share of days per label of every path."""
    counts = path.groupBy("panel_id", "path_id", "regime").agg(F.count("*").alias("days"))
    whole = F.sum("days").over(Window.partitionBy("panel_id", "path_id"))
    return counts.withColumn("share", F.col("days") / whole)


def label_deltas(counts: DataFrame, left: str, right: str) -> DataFrame:
    """Change in days per label from one path to another."""
    days = lambda p: F.coalesce(F.sum(F.when(F.col("path_id") == p, F.col("days"))), F.lit(0))
    return counts.groupBy("panel_id", "regime").agg((days(right) - days(left)).alias("delta_days"))


def stance(regime: Column, risk_off: Column) -> Column:
    """Recommended stance: the risk-off gate overrides, unknown labels are neutral."""
    named = F.create_map(*[F.lit(x) for kv in STANCES.items() for x in kv])
    return F.when(risk_off, "defensive").otherwise(
        F.coalesce(F.try_element_at(named, regime), F.lit("market portfolio"))
    )
