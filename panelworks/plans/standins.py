"""Inputs of the registered queries, derived by Spark from the driver's tables.

=============  =================================================================
panels         ``brands``: brands by week; ``nation_k``: brands by month of each
               supplier nation. Close = trailing 8-period price per unit.
side series    weekly per brand: units shipped (``dexvol``), large shipments
               (``whaleflow``), returned minus accepted units (``cexflow``)
TVL pair       daily order value, and the same for urgent orders only
transfers      ``events``: token = type, amount = value, two addresses
bars           lineitem unit prices per brand and day
labels         a rule on features standing in for model labels
=============  =================================================================
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import so_far
from ..operators import features as feat
from ..operators import align, em, flows, panel, portfolio, regime, weights
from ..operators.hmm import PathSpec
from ..operators.panel import by_panel
from ..schemas import FEATURES, REGIMES
from ..session import materialize

STABLES = ("Brand#1", "Brand#2")
PATHS = {"baseline": 1.0, "eager": 0.8}
LABEL_START = 30
STAY, MOVE = 0.9, 0.05  # transitions that the EM step starts from
APART = 0.25  # and how far its means are moved apart
CONFIGS = [
    weights.RouterConfig("gated", gated=True),
    weights.RouterConfig("confirm2", gated=True, confirm=2),
    weights.RouterConfig("confirm3", gated=True, confirm=3),
    weights.RouterConfig("ungated"),
    weights.RouterConfig("gated_eager", path_id="eager", gated=True),
    weights.RouterConfig(
        "gated_confirmed",
        gated=True,
        slots={"trending": "momentum_onchain", "ranging": "equal_weight", "high_volatility": "defensive"},
    ),
    weights.RouterConfig("momentum", fixed="momentum"),
    weights.RouterConfig("mean_reversion", fixed="mean_reversion"),
    weights.RouterConfig("equal_weight", fixed="equal_weight"),
]
TVL = ("tvl_mom20", "tvl_dd", "pancake_share_mom20")
CONFIG_IDS = [c.config_id for c in CONFIGS]
VARIANTS = ["gated", "confirm2", "confirm3", "ungated"]


class Inputs:
    """Lazily built stand-ins over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def shipments(self) -> DataFrame:
        """lineitem with its brand."""
        brand = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
        return self.table("lineitem").join(brand, "l_partkey")

    @staticmethod
    def measures() -> list[Column]:
        """Cents and units are whole numbers: their sums are exact in any order."""
        units = F.col("l_quantity")
        flag = F.when(F.col("l_returnflag") == "R", units).when(F.col("l_returnflag") == "A", -units)
        return [
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
            units.alias("units"),
            F.when(units >= 40, units).alias("large"),
            F.coalesce(flag, F.lit(0.0)).alias("returned"),
        ]

    @cached_property
    def weekly_sales(self) -> DataFrame:
        """Shipments by (brand, week) alone, which need no supplier."""
        week = F.trunc(F.to_date("l_shipdate"), "week").alias("week")
        rows = self.shipments.select("symbol", week, *self.measures())
        return rows.groupBy("symbol", "week").agg(*[F.sum(c).alias(c) for c in ("cents", "units", "large", "returned")])

    @cached_property
    def sales(self) -> DataFrame:
        """Shipments rolled up by (brand, week) and by (brand, nation, month).

        Both groupings come from one scan and are combined map-side, so the raw rows
        are read and shuffled as partial sums once.
        """
        nation = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        rows = self.shipments.join(nation, "l_suppkey").select(
            "symbol",
            F.col("s_nationkey").alias("nation"),
            F.trunc(F.to_date("l_shipdate"), "week").alias("week"),
            F.trunc(F.to_date("l_shipdate"), "month").alias("month"),
            *self.measures(),
        )
        sets = [["symbol", "week"], ["symbol", "nation", "month"]]
        return rows.groupingSets(sets, "symbol", "nation", "week", "month").agg(
            *[F.sum(c).alias(c) for c in ("cents", "units", "large", "returned")]
        )

    @cached_property
    def stored_sales(self) -> DataFrame:
        return materialize(self.sales)

    @staticmethod
    def closes(sales: DataFrame) -> DataFrame:
        """Price per unit over the last eight periods, per panel and brand."""
        weekly = F.col("week").isNotNull()
        week = F.floor(F.date_diff("week", F.lit("1990-01-01").cast("date")) / 7).cast("int")
        month = F.year("month") * 12 + F.month("month")
        w = Window.partitionBy("panel_id", "symbol").orderBy("period").rangeBetween(-7, 0)
        return sales.select(
            F.when(weekly, "brands").otherwise(F.concat(F.lit("nation_"), F.col("nation"))).alias("panel_id"),
            "symbol",
            F.coalesce("week", "month").alias("date"),
            F.when(weekly, week).otherwise(month).alias("period"),
            "cents",
            "units",
        ).select(
            "panel_id",
            "symbol",
            F.substring("symbol", 7, 9).cast("int").alias("ord"),
            "date",
            (F.sum("cents").over(w).cast("double") / 100.0 / F.sum("units").over(w)).alias("close"),
        )

    @cached_property
    def lazy_prices(self) -> DataFrame:
        return self.closes(self.sales)

    @cached_property
    def nation_prices(self) -> DataFrame:
        return self.closes(self.sales.filter(F.col("month").isNotNull()))

    @cached_property
    def prices(self) -> DataFrame:
        """All panels from the stored roll-up, which calendar, windows and side
        series share."""
        return self.closes(self.stored_sales)

    @cached_property
    def part_indexed(self) -> DataFrame:
        """One wide panel with a name per part and a row per week it was shipped."""
        week = F.trunc(F.to_date("l_shipdate"), "week")
        sold = self.table("lineitem").groupBy(F.col("l_partkey").alias("ord"), week.alias("date")).agg(
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
            F.sum("l_quantity").alias("units"),
        )
        prices = materialize(sold.select(
            F.lit("parts").alias("panel_id"),
            F.col("ord").cast("string").alias("symbol"),
            "ord",
            "date",
            (F.col("cents").cast("double") / 100.0 / F.col("units")).alias("close"),
        ))
        return panel.indexed(prices, materialize(panel.calendar(prices)))

    @cached_property
    def symbols(self) -> DataFrame:
        """Requested universe of every nation panel: brands 1 to 30, some never shipped."""
        panels = self.table("supplier").select(
            F.concat(F.lit("nation_"), F.col("s_nationkey")).alias("panel_id")
        )
        return panels.distinct().select("panel_id", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("ord")).select(
            "panel_id", F.concat(F.lit("Brand#"), F.col("ord")).alias("symbol"), "ord"
        )

    @cached_property
    def universe(self) -> DataFrame:
        """The same names for every panel, the weekly one included."""
        brands = self.symbols.select(F.lit("brands").alias("panel_id"), "symbol", "ord").distinct()
        return self.symbols.unionByName(brands)

    @cached_property
    def calendar(self) -> DataFrame:
        """Written, so that its true size decides how it is joined."""
        return materialize(panel.calendar(self.prices))

    @cached_property
    def indexed(self) -> DataFrame:
        return panel.indexed(self.prices, self.calendar)

    @cached_property
    def panel(self) -> DataFrame:
        """Indexed panel with every per-name window, written once for all strategies."""
        return materialize(feat.enriched(self.indexed))

    @cached_property
    def market(self) -> DataFrame:
        return feat.market_daily(self.indexed)

    @cached_property
    def features(self) -> DataFrame:
        return feat.feature_panel(self.market)

    @cached_property
    def gates(self) -> DataFrame:
        return feat.risk_off(self.market)

    def label(self, features: DataFrame) -> DataFrame:
        """Rule-based labels on two paths from row 30 on, using expanding means."""
        frame = so_far(by_panel())
        rv, tr = F.col("realized_vol"), F.abs("trend_strength")
        staged = features.withColumns({"rv_mean": F.avg(rv).over(frame), "tr_mean": F.avg(tr).over(frame)})
        scales = F.create_map(*[F.lit(x) for kv in PATHS.items() for x in kv])
        rule = (
            F.when(rv > F.col("rv_mean") * F.col("scale") * 1.25, "high_volatility")
            .when(tr > F.col("tr_mean") * F.col("scale"), "trending")
            .otherwise("ranging")
        )
        return (
            staged.filter(F.col("pos") >= LABEL_START)
            .select("*", F.explode(scales).alias("path_id", "scale"))
            .select("panel_id", "path_id", "pos", "date", rule.alias("regime"))
        )

    @cached_property
    def path(self) -> DataFrame:
        return self.label(self.features)

    @cached_property
    def side_series(self) -> DataFrame:
        return self.series_of(self.weekly_sales)

    @staticmethod
    def series_of(sales: DataFrame) -> DataFrame:
        weekly = sales.filter(F.col("week").isNotNull()).select(
            "symbol",
            F.col("week").alias("date"),
            F.col("units").alias("dexvol"),
            F.col("large").alias("whaleflow"),
            F.col("returned").alias("cexflow"),
        )
        return weekly.unpivot(
            ["symbol", "date"], ["dexvol", "whaleflow", "cexflow"], "kind", "value"
        ).filter(F.col("value").isNotNull())

    @cached_property
    def tvl(self) -> tuple[DataFrame, DataFrame]:
        orders = self.table("orders").withColumns(
            {"chain_id": F.lit("BSC"), "date": F.to_date("o_orderdate")}
        )
        value = F.sum("o_totalprice").alias("value")
        urgent = orders.filter(F.col("o_orderpriority") == "1-URGENT")
        return (
            orders.groupBy("chain_id", "date").agg(value),
            urgent.groupBy("chain_id", "date").agg(value),
        )

    @cached_property
    def transfers(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_type").alias("token"),
            "ts",
            F.col("user_id").alias("sender"),
            ((F.col("user_id") * 7 + F.col("event_id")) % 150).alias("receiver"),
            F.col("value").alias("amount"),
        )

    @cached_property
    def wallets(self) -> DataFrame:
        """Addresses that ever sent a large transfer, standing in for exchanges."""
        return self.transfers.groupBy(F.col("sender").alias("address")).agg(F.max("amount").alias("top")).filter(
            "top >= 300"
        ).select("address")

    @cached_property
    def bars(self) -> DataFrame:
        ten_digits = F.lit("1" + "0" * 10).cast("decimal(11,0)")  # room for the part key
        ticks = self.shipments.select(
            "symbol",
            F.col("l_shipdate").alias("ts"),
            ((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("decimal(12,0)") * ten_digits + F.col("l_partkey")).alias("seq"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("qty"),
        )
        return flows.bars_from_ticks(ticks)

    def strategies(self) -> dict[str, DataFrame]:
        p = self.panel
        mom = weights.momentum(p, 30, 3)
        side = self.series_of(self.stored_sales)
        return {
            "equal_weight": weights.equal_weight(p),
            "momentum": mom,
            "mean_reversion": weights.mean_reversion(p, 10, 5),
            "defensive": weights.defensive(p, STABLES),
            "momentum_onchain": weights.confirmed(
                mom, flows.select_series(side, "dexvol"), flows.select_series(side, "cexflow")
            ),
        }

    @cached_property
    def all_weights(self) -> DataFrame:
        frames = list(self.strategies().values())
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    @cached_property
    def panel_market(self) -> DataFrame:
        return materialize(feat.market_daily(self.panel))

    @cached_property
    def panel_path(self) -> DataFrame:
        return self.label(feat.feature_panel(self.panel_market))

    @cached_property
    def active(self) -> DataFrame:
        return weights.active_strategies(
            self.calendar, self.panel_path, feat.risk_off(self.panel_market), CONFIGS
        )

    @cached_property
    def routed(self) -> DataFrame:
        return weights.route(self.active, self.all_weights)

    @cached_property
    def daily(self) -> DataFrame:
        """Accounting of every configuration: one row per panel date."""
        return portfolio.daily_accounting(self.routed, portfolio.spine(self.calendar, CONFIG_IDS))

    @cached_property
    def stored_daily(self) -> DataFrame:
        """The same, written once for reports that read it several times."""
        return materialize(self.daily)

    @cached_property
    def models(self) -> DataFrame:
        """Class-conditional Gaussian models of every training prefix.

        States are the rule labels in the order high volatility, ranging, trending;
        moments are those of the standardised prefix. They give scoring an exact
        SQL counterpart.
        """
        frame = so_far(by_panel())
        labels = self.path.filter("path_id = 'baseline'").select("panel_id", "pos", "regime")
        rows = self.features.join(labels, ["panel_id", "pos"], "left")
        cols: dict = {}
        for c in FEATURES:
            sd = F.stddev_pop(c).over(frame)
            cols[f"m_{c}"] = F.avg(c).over(frame)
            cols[f"s_{c}"] = F.when(sd > 0, sd).otherwise(1.0)
        order = ("high_volatility", "ranging", "trending")
        for r in order:
            cols[f"n_{r}"] = F.count_if(F.col("regime") == r).over(frame)
            for c in FEATURES:
                own = F.when(F.col("regime") == r, F.col(c))
                cols[f"m_{r}_{c}"] = F.avg(own).over(frame)
                cols[f"v_{r}_{c}"] = F.var_pop(own).over(frame)
        rows = rows.withColumns(cols)
        at_refit = (F.col("pos") >= 60) & (regime.refit_position(60, 5) == F.col("pos"))
        rows = rows.filter(at_refit)
        state = lambda r: F.struct(
            ((F.col(f"n_{r}") + 1.0) / (F.col("n_high_volatility") + F.col("n_ranging") + F.col("n_trending") + 3.0)).alias("start"),
            F.array(*[F.coalesce((F.col(f"m_{r}_{c}") - F.col(f"m_{c}")) / F.col(f"s_{c}"), F.lit(0.0)) for c in FEATURES]).alias("mu"),
            F.array(*[F.coalesce(F.col(f"v_{r}_{c}") / F.col(f"s_{c}") / F.col(f"s_{c}"), F.lit(1.0)) + 0.01 for c in FEATURES]).alias("var"),
        )
        return rows.select(
            "panel_id",
            F.lit("baseline").alias("path_id"),
            F.col("pos").alias("refit_pos"),
            F.lit(0.0).alias("loglik"),
            F.array(*[F.col(f"m_{c}") for c in FEATURES]).alias("center"),
            F.array(*[F.col(f"s_{c}") for c in FEATURES]).alias("scale"),
            F.array(*[state(r) for r in order]).alias("states"),
        )

    @cached_property
    def em_models(self) -> DataFrame:
        """The models of every prefix after one EM step from sticky transitions and means moved apart, so
        that no two states are alike."""
        shift = lambda s, i: F.struct(s["start"].alias("start"), F.transform(s["mu"], lambda m: m + (i - 1) * APART).alias("mu"), s["var"].alias("var"))
        start = self.models.withColumn("states", F.transform("states", shift))
        trans = F.array(*[F.array(*[F.lit(STAY if i == j else MOVE) for j in range(3)]) for i in range(3)])
        return em.em_step(materialize(self.features), start.withColumn("trans", trans))

    @cached_property
    def onchain_features(self) -> DataFrame:
        """Market features with those of the order value as of each date."""
        return align.align_asof(self.features, flows.tvl_features(*self.tvl), list(TVL), ["panel_id"])

    @cached_property
    def trained_paths(self) -> DataFrame:
        """Reads of two paths, market features alone and with the order value's, trained in one call."""
        market, wide = materialize(self.features), materialize(self.onchain_features)
        return materialize(regime.path_reads([PathSpec("baseline", market), PathSpec("tvl", wide, (*FEATURES, *TVL))]))

    @cached_property
    def reads(self) -> DataFrame:
        scheduled = regime.refit_schedule(self.features)
        return regime.reads(regime.posterior(scheduled, regime.label_states(self.models)))


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: doubles at 6 places, integers as BIGINT.

    Rounding is spelled out because engines disagree on ties.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        if kind == "double":
            c = (F.floor(c * 1e6 + 0.5) / 1e6).alias(f.name)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint").alias(f.name)
        out.append(c)
    return df.select(*out)


__all__ = ["APART", "CONFIGS", "CONFIG_IDS", "Inputs", "MOVE", "PATHS", "REGIMES", "STABLES", "STAY", "TVL", "VARIANTS", "tidy"]
