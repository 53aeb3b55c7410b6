"""The three end-to-end analyses, composed from operators.

Each returns named DataFrames; tables that feed several results are written once
to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bootstrap, features, panel, portfolio, regime, validation, weights, windows
from ..operators.align import align_asof
from ..operators.hmm import PathSpec
from ..schemas import FEATURES
from ..session import materialize


def _present(df: DataFrame, column: str, names: set[str]) -> set[str]:
    """Which of the few ``names`` occur in ``column``."""
    found = df.filter(F.col(column).isin(sorted(names))).select(column).distinct()
    return {r[0] for r in found.collect()}


def strategy_comparison(
    prices: DataFrame,
    configs: list[weights.RouterConfig],
    path: DataFrame | None = None,
    stables: tuple[str, ...] = weights.STABLECOINS,
    top_n: int = 3,
    extra_strategies: DataFrame | None = None,
    extra_paths: dict[str, tuple[DataFrame, tuple[str, ...]]] | None = None,
    **accounting: float,
) -> dict[str, DataFrame]:
    """Backtest every configuration on every usable panel.

    Without ``path`` the regime path "baseline" is trained walk-forward on market features, and beside it
    every path of ``extra_paths``, ``{path_id: (series, columns)}``, on market features with the columns of
    ``series(date, columns)`` as of each date: all in one training, so configurations of different paths
    are routed side by side. ``extra_strategies``
    adds weight rows under further strategy names, with or without ``next_ret``.
    Unknown strategy or path names raise ValueError.
    """
    prices = materialize(panel.usable(prices))
    cal = materialize(panel.calendar(prices))
    enriched = materialize(features.enriched(panel.indexed(prices, cal)))
    market = materialize(features.market_daily(enriched))
    if path is None:
        frame = materialize(features.feature_panel(market))
        specs = [PathSpec("baseline", frame)]
        for path_id, (series, cols) in (extra_paths or {}).items():
            specs.append(PathSpec(path_id, materialize(align_asof(frame, series, list(cols), ["panel_id"])), (*FEATURES, *cols)))
        path = materialize(regime.path_reads(specs))
    gates = features.risk_off(market)
    held = (
        weights.equal_weight(enriched)
        .unionByName(weights.momentum(enriched, 30, top_n))
        .unionByName(weights.mean_reversion(enriched))
        .unionByName(weights.defensive(enriched, stables))
    )
    strategies = set(weights.BUILT_IN)
    if extra_strategies is not None:
        if "next_ret" not in extra_strategies.columns:
            extra_strategies = portfolio.with_forward_returns(extra_strategies, enriched)
        held = held.unionByName(extra_strategies.select(*held.columns))
        strategies |= _present(extra_strategies, "strategy", {n for c in configs for n in (c.fixed, *c.slots.values()) if n})
    weights.check_configs(configs, strategies, _present(path, "path_id", {c.path_id for c in configs}))
    routed = weights.route(weights.active_strategies(cal, path, gates, configs), held)
    days = portfolio.spine(cal, [c.config_id for c in configs])
    daily = materialize(portfolio.daily_accounting(routed, days, **accounting))
    return {
        "calendar": cal,
        "path": path,
        "daily": daily,
        "metrics": portfolio.metrics(daily),
        "trades": portfolio.trades(daily),
        "regime_pnl": portfolio.regime_pnl(daily.withColumn("path_id", weights.config_path(configs)), path),
        "label_counts": regime.label_counts(path),
    }


def latest_read(
    prices: DataFrame, extra: DataFrame | None = None, extra_cols: tuple[str, ...] = (), **fit
) -> DataFrame:
    """Regime, stance and explanation of each panel's last date.

    ``extra(date, <extra_cols>)`` is joined as of each date before training.
    """
    indexed = panel.indexed(materialize(prices))
    market = materialize(features.market_daily(indexed))
    frame = features.feature_panel(market)
    cols = (*FEATURES, *extra_cols)
    if extra is not None:
        frame = align_asof(frame, extra, list(extra_cols), ["panel_id"])
    gates = features.risk_off(market).select("panel_id", "pos", "risk_off")
    reads = regime.latest_reads(frame, cols=cols, **fit).join(gates, ["panel_id", "pos"])
    return reads.withColumn("stance", regime.stance(F.col("regime"), F.col("risk_off")))


def out_of_sample(
    daily: DataFrame,
    cal: DataFrame,
    variants: list[str],
    n_windows: int = 6,
    embargo: int = 5,
    metric: str = "sharpe",
    n_boot: int = 1000,
    block_len: int = 10,
) -> dict[str, DataFrame]:
    """Train-only selection, out-of-sample evaluation, deflated Sharpe and intervals.

    The last two concern the variant chosen most often on each panel.
    """
    folds = windows.walk_forward_windows(cal, n_windows, embargo)
    evaluated = validation.evaluate_windows(daily, folds)
    selection = validation.select_config(daily, folds, variants, metric)
    selected = materialize(validation.modal_variant(selection, cal, variants[0]))
    chosen = selected.withColumnRenamed("selected", "config_id")
    returns = daily.join(chosen, ["panel_id", "config_id"], "left_semi")
    return {
        "selection": selection,
        "oos": validation.oos_aggregate(selection, len(variants)),
        "per_config": validation.per_config_oos(evaluated),
        "selected": selected,
        "deflated_sharpe": validation.deflated_sharpe(daily, variants).join(
            chosen, ["panel_id", "config_id"], "left_semi"
        ),
        "intervals": bootstrap.bootstrap_ci(returns, n_boot, block_len),
    }
