"""Cross-sectional strategies: target weights for every decision date at once.

A strategy maps an indexed panel to sparse rows ``(panel_id, strategy, pos, date,
symbol, w[, next_ret])``; an absent row is weight 0, the remainder is cash. Any
function with that shape plugs in.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schemas import REGIMES
from .align import asof_rows
from .features import trailing_return
from .runs import confirmed_gate, hysteresis

BUILT_IN = ("equal_weight", "momentum", "mean_reversion", "defensive")
# The stable names a defensive book may hold.
STABLECOINS = ("USDT", "USDC", "DAI", "TUSD", "FDUSD")


def _day() -> WindowSpec:
    return Window.partitionBy("panel_id", "pos")


def _rows(df: DataFrame, strategy: str, w: Column) -> DataFrame:
    carried = [c for c in ("next_ret",) if c in df.columns]
    return df.select("panel_id", F.lit(strategy).alias("strategy"), "pos", "date", "symbol", w.alias("w"), *carried)


def equal_weight(prices: DataFrame, strategy: str = "equal_weight") -> DataFrame:
    """Every name priced on the decision day. The count comes with the calendar."""
    return _rows(prices, strategy, 1.0 / F.col("n_names"))


def _ranked(prices: DataFrame, lookback: int, n: int, best_first: bool, gate: Column, strategy: str) -> DataFrame:
    scored = prices.withColumn("score", trailing_return(prices, lookback)).filter(F.col("score").isNotNull())
    order = [F.col("score").desc() if best_first else F.col("score").asc(), "ord", "symbol"]
    # The rank filter becomes a per-partition group limit before the shuffle, so
    # a date with very many names sends at most n rows per task.
    top = scored.withColumn("rank", F.row_number().over(_day().orderBy(*order))).filter(F.col("rank") <= n)
    held = top.filter(gate)
    return _rows(held, strategy, 1.0 / F.count("*").over(_day()))


def momentum(prices: DataFrame, lookback: int = 30, top_n: int = 5, strategy: str = "momentum") -> DataFrame:
    """Equal weight over the top ``top_n`` trailing returns, then only positive ones."""
    return _ranked(prices, lookback, top_n, True, F.col("score") > 0, strategy)


def mean_reversion(
    prices: DataFrame, lookback: int = 10, bottom_n: int = 5, strategy: str = "mean_reversion"
) -> DataFrame:
    """Equal weight over the ``bottom_n`` lowest trailing returns, whatever their sign."""
    return _ranked(prices, lookback, bottom_n, False, F.lit(True), strategy)


def defensive(
    prices: DataFrame, stables: tuple[str, ...] = STABLECOINS, strategy: str = "defensive"
) -> DataFrame:
    """Equal weight over the listed stable names priced that day, else cash."""
    held = prices.filter(F.col("symbol").isin(list(stables)))
    return _rows(held, strategy, 1.0 / F.count("*").over(_day()))


def _prior_frames(series: DataFrame, window: int):
    w = Window.partitionBy("symbol").orderBy("date")
    recent = w.rowsBetween(-(window - 1), 0)
    prior = w.rowsBetween(-(2 * window - 1), -window)
    enough = F.count("value").over(w.rowsBetween(Window.unboundedPreceding, 0)) >= 2 * window
    return series.filter(F.col("value").isNotNull()), recent, prior, enough


def volume_signal(volume: DataFrame, window: int = 7, floor: float = 0.5) -> DataFrame:
    """Keep flag per (symbol, date): false only when the mean of the last ``window``
    observations fell below ``floor`` of the ``window`` before them."""
    seen, recent, prior, enough = _prior_frames(volume, window)
    before = F.avg("value").over(prior)
    collapsed = F.when(enough & (before > 0), F.avg("value").over(recent) / before < floor)
    return seen.select("symbol", "date", (~F.coalesce(collapsed, F.lit(False))).alias("keep"))


def inflow_signal(inflow: DataFrame, window: int = 7, threshold: float = 2.0) -> DataFrame:
    """Veto flag per (symbol, date): the latest value scored against the prior
    window, which excludes the recent one. A flat prior vetoes only when positive
    and exceeded by the multiplicative threshold."""
    seen, _, prior, enough = _prior_frames(inflow, window)
    mean, sd = F.avg("value").over(prior), F.stddev_samp("value").over(prior)
    spike = F.when(sd > 0, (F.col("value") - mean) / sd > threshold).when(
        mean > 0, F.col("value") > mean * (1 + threshold)
    )
    return seen.select("symbol", "date", F.coalesce(enough & spike, F.lit(False)).alias("veto"))


def confirmed(
    base: DataFrame,
    volume: DataFrame | None = None,
    inflow: DataFrame | None = None,
    window: int = 7,
    threshold: float = 2.0,
    strategy: str = "momentum_onchain",
) -> DataFrame:
    """Base holdings filtered by volume confirmation and the inflow veto.

    Survivors are re-weighted equally and none left means cash. Symbols or dates
    without side data are kept; with no side data at all the base is unchanged.
    """
    if volume is None and inflow is None:
        return base.withColumn("strategy", F.lit(strategy))
    sides = []
    if volume is not None:
        sides.append(volume_signal(volume, window))
    if inflow is not None:
        sides.append(inflow_signal(inflow, window, threshold))
    signals = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1], allowMissingColumns=True)
    flags = signals.columns[2:]
    held = asof_rows(base.filter(F.col("w") > 0), signals, flags, ("symbol",), whole_row=False)
    if "keep" in flags:
        held = held.filter(F.coalesce("keep", F.lit(True)))
    if "veto" in flags:
        held = held.filter(~F.coalesce("veto", F.lit(False)))
    # Counted by aggregation rather than a window: the base may hold any number of names.
    count = held.groupBy("panel_id", "pos").agg(F.count("*").alias("held"))
    return _rows(held.join(count, ["panel_id", "pos"]), strategy, 1.0 / F.col("held"))


@dataclass(frozen=True)
class RouterConfig:
    """One routed variant, or with ``fixed`` a single strategy held throughout."""

    config_id: str
    path_id: str = "baseline"
    gated: bool = False
    confirm: int = 1
    hysteresis: int = 3
    default: str = "ranging"
    slots: dict[str, str] = field(
        default_factory=lambda: {
            "trending": "momentum",
            "ranging": "equal_weight",
            "high_volatility": "defensive",
        }
    )
    fixed: str | None = None


def check_configs(configs: list[RouterConfig], strategies: set[str], paths: set[str]) -> None:
    """Raise on a strategy, regime slot or path that no input provides: it would route to cash."""
    for c in configs:
        used = {c.fixed} if c.fixed else set(c.slots.values())
        if used - strategies:
            raise ValueError(f"{c.config_id}: unknown strategies {sorted(used - strategies)}")
        if not c.fixed and set(REGIMES) - set(c.slots):
            raise ValueError(f"{c.config_id}: no strategy for {sorted(set(REGIMES) - set(c.slots))}")
        if not c.fixed and c.path_id not in paths:
            raise ValueError(f"{c.config_id}: unknown path {c.path_id}")


def config_path(configs: list[RouterConfig]) -> Column:
    """The regime path of each row's ``config_id``."""
    pairs = [F.lit(x) for c in configs for x in (c.config_id, c.path_id)]
    return F.try_element_at(F.create_map(*pairs), F.col("config_id"))


def config_rows(configs: list[RouterConfig]) -> Column:
    """The configurations as a literal array, ready to explode next to any row."""
    return F.array(
        *[
            F.struct(
                F.lit(c.config_id).alias("config_id"),
                F.lit(i).alias("config_ord"),
                F.lit(c.path_id).alias("path_id"),
                F.lit(c.gated).alias("gated"),
                F.lit(c.confirm).alias("confirm"),
                F.lit(c.hysteresis).alias("hysteresis"),
                F.lit(c.default).alias("default_regime"),
                F.create_map(*[F.lit(x) for kv in c.slots.items() for x in kv]).alias("slots"),
                F.lit(c.fixed).cast("string").alias("fixed"),
            )
            for i, c in enumerate(configs)
        ]
    )


def active_strategies(
    cal: DataFrame, path: DataFrame, gates: DataFrame, configs: list[RouterConfig]
) -> DataFrame:
    """The strategy each configuration holds on each decision date.

    ``path(panel_id, path_id, pos, regime)`` and ``gates(panel_id, pos,
    risk_off)``. The gate is read first and may act where the path has no label;
    otherwise an unlabelled date is cash and a labelled one follows the
    hysteresis-active regime. All inputs are one row per panel date.
    """
    by = ["panel_id", "config_id"]
    rows = config_rows(configs)
    spine = cal.select("panel_id", "pos", "date", F.inline(rows))
    # Each label meets only the configurations routed on its own path.
    own = F.create_map(*[
        x for p in dict.fromkeys(c.path_id for c in configs) for x in (F.lit(p), config_rows([c for c in configs if c.path_id == p]))
    ])
    labelled = path.select("panel_id", "pos", "regime", F.inline(F.try_element_at(own, F.col("path_id"))))
    active = hysteresis(labelled, by, F.col("hysteresis"), F.col("default_regime"))
    gate = confirmed_gate(
        spine.join(gates.select("panel_id", "pos", "risk_off"), ["panel_id", "pos"], "left").withColumn(
            "risk_off", F.coalesce("risk_off", F.lit(False))
        ),
        by,
        F.col("confirm"),
    )
    slot = F.when(F.col("gated") & F.col("gate"), "high_volatility").otherwise(F.col("active"))
    return (
        gate.join(active.select(*by, "pos", "active"), [*by, "pos"], "left")
        .withColumn("slot", slot)
        .withColumn("strategy", F.coalesce("fixed", F.element_at("slots", F.col("slot"))))
        .select("panel_id", "config_id", "pos", "date", "gate", "active", "slot", "strategy")
    )


def route(active: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights of every configuration: its active strategy's rows on each date."""
    chosen = active.filter(F.col("strategy").isNotNull()).select("panel_id", "config_id", "pos", "strategy")
    return chosen.join(weights, ["panel_id", "strategy", "pos"]).drop("strategy")
