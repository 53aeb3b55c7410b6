"""Roll-ups of raw transfers and ticks, and the series features built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import carry_forward, ratio, so_far, trailing
from .align import align_exact
from .panel import in_range

DEFAULT_WHALE_AMOUNT = 10000.0


def token_flow(
    transfers: DataFrame,
    start: str | None = None,
    end: str | None = None,
    min_amount: Column | float | None = None,
) -> DataFrame:
    """Daily transferred amount and count per token.

    ``min_amount`` keeps single transfers at or above it and may be a column.
    Map-side partial aggregation means a dominant token costs no skew.
    """
    kept = in_range(transfers.withColumn("date", F.to_date("ts")), start, end)
    if min_amount is not None:
        kept = kept.filter(F.col("amount") >= min_amount)
    return kept.groupBy("token", "date").agg(
        F.sum("amount").alias("volume"), F.count("*").alias("count")
    )


def with_threshold(df: DataFrame, thresholds: DataFrame, default: float = DEFAULT_WHALE_AMOUNT) -> DataFrame:
    """Attach each token's large-transfer threshold, ``default`` where unlisted."""
    return df.join(thresholds.select("token", "min_amount"), "token", "left").withColumn(
        "min_amount", F.coalesce("min_amount", F.lit(default))
    )


def exchange_flow(
    transfers: DataFrame, wallets: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Daily exchange inflow, outflow and net per token.

    A transfer counts as inflow when its receiver is a listed wallet and as
    outflow when its sender is, possibly both. The two legs are summed per
    (token, day, address) before meeting the wallet list, so a wallet behind a
    large share of all transfers reaches the join as one row per token and day.
    """
    legs = in_range(transfers.withColumn("date", F.to_date("ts")), start, end).select(
        "token",
        "date",
        F.explode(
            F.array(
                F.struct(F.col("receiver").alias("address"), F.col("amount").alias("inn"), F.lit(0.0).alias("out")),
                F.struct(F.col("sender").alias("address"), F.lit(0.0).alias("inn"), F.col("amount").alias("out")),
            )
        ).alias("leg"),
    )
    per_address = legs.groupBy("token", "date", "leg.address").agg(
        F.sum("leg.inn").alias("inn"), F.sum("leg.out").alias("out")
    )
    return (
        per_address.join(wallets.select("address").distinct(), "address", "left_semi")
        .groupBy("token", "date")
        .agg(F.sum("inn").alias("inflow"), F.sum("out").alias("outflow"))
        .withColumn("net_inflow", F.col("inflow") - F.col("outflow"))
    )


def bars_from_ticks(ticks: DataFrame) -> DataFrame:
    """Daily open/high/low/close/volume; ``seq`` orders ticks sharing a timestamp.

    The order is packed into one decimal (16 digits of microseconds, 22 of ``seq``):
    a struct cannot live in a hash aggregation buffer and would sort all ticks.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(16,0)")
    shift = F.lit("1" + "0" * 22).cast("decimal(23,0)")
    when = (micros * shift + F.col("seq").cast("decimal(22,0)")).cast("decimal(38,0)")
    placed = ticks.select("symbol", F.to_date("ts").alias("date"), "price", "qty", when.alias("at"))
    return placed.groupBy("symbol", "date").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.sum("qty").alias("volume"),
    )


def select_series(series: DataFrame, kind: str, symbols: DataFrame | None = None) -> DataFrame:
    """One kind's series for the requested symbols; absent ones simply drop out."""
    kept = series.filter((F.col("kind") == kind) & F.col("value").isNotNull())
    return kept if symbols is None else kept.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def series_panel(series: DataFrame, kind: str, symbols: list[str]) -> DataFrame:
    """Presentation form: one column per listed symbol, one row per date."""
    kept = series.filter((F.col("kind") == kind) & F.col("symbol").isin(symbols))
    return kept.groupBy("date").pivot("symbol", symbols).agg(F.first("value"))


def market_aggregate(series: DataFrame) -> DataFrame:
    """Mean over the symbols present, per kind and date."""
    return series.groupBy("kind", "date").agg(F.avg("value").alias("value"))


def trailing_z(df: DataFrame, by: list[str], window: int = 60, min_periods: int = 10) -> DataFrame:
    """Score of each value against its trailing window, itself included.

    NULL until ``min_periods`` values exist or while the deviation is zero.
    """
    frame = trailing(Window.partitionBy(*by).orderBy("date"), window)
    score = ratio(F.col("value") - F.avg("value").over(frame), F.stddev_samp("value").over(frame))
    return df.withColumn(
        "z", F.when(F.col("value").isNotNull() & (F.count("value").over(frame) >= min_periods), score)
    )


def flow_features(
    spine: DataFrame, series: DataFrame, window: int = 60, min_periods: int = 10
) -> DataFrame:
    """Whale and exchange flow scores on the panel calendar.

    ``series`` holds kinds ``whaleflow`` and ``cexflow``; a kind with no data
    yields zeros.
    """
    scored = trailing_z(market_aggregate(series), ["kind"], window, min_periods)
    native = scored.groupBy("date").agg(
        F.max(F.when(F.col("kind") == "whaleflow", F.col("z"))).alias("net_whale_flow_z"),
        F.max(F.when(F.col("kind") == "cexflow", F.col("z"))).alias("net_cex_flow_z"),
    )
    return align_exact(spine, native, ["net_whale_flow_z", "net_cex_flow_z"], ["panel_id"])


TVL_FEATURES = ("tvl_mom20", "tvl_dd", "pancake_share_mom20")


def tvl_features(chain: DataFrame, protocol: DataFrame, lag: int = 20) -> DataFrame:
    """Locked-value momentum, drawdown and protocol-share momentum per source day.

    Each input is ``(chain_id, date, value)``. The protocol is matched to the
    chain's dates exactly and carried forward before the share is formed; missing
    values are carried forward before changes are taken.
    """
    w = Window.partitionBy("chain_id").orderBy("date")
    joined = chain.select("chain_id", "date", F.col("value").alias("tvl")).join(
        protocol.select("chain_id", "date", F.col("value").alias("protocol")), ["chain_id", "date"], "left"
    )
    filled = joined.withColumns(
        {"filled": carry_forward("tvl", w), "share": ratio(carry_forward("protocol", w), "tvl")}
    ).withColumn("share", carry_forward("share", w))
    return filled.select(
        "chain_id",
        "date",
        (ratio("filled", F.lag("filled", lag).over(w)) - 1.0).alias("tvl_mom20"),
        (ratio("tvl", F.max("tvl").over(so_far(w))) - 1.0).alias("tvl_dd"),
        (ratio("share", F.lag("share", lag).over(w)) - 1.0).alias("pancake_share_mom20"),
    )


def tvl_panel(spine: DataFrame, chain: DataFrame, protocol: DataFrame) -> DataFrame:
    """Locked-value features of one chain on every panel calendar."""
    return align_exact(spine, tvl_features(chain, protocol), list(TVL_FEATURES), ["panel_id"])


def backfill_status(
    symbols: DataFrame, addresses: DataFrame, pools: DataFrame, series: DataFrame, kind: str
) -> DataFrame:
    """What a backfill has for each symbol: rows, latest value and status."""
    have = (
        series.filter(F.col("kind") == kind)
        .groupBy("symbol")
        .agg(F.count("value").alias("n_rows"), F.max_by("value", "date").alias("latest"))
    )
    n = F.coalesce("n_rows", F.lit(0))
    return (
        symbols.select("symbol")
        .distinct()
        .join(addresses.select("symbol", "address"), "symbol", "left")
        .join(pools.select("address", "pool_address").distinct(), "address", "left")
        .join(have, "symbol", "left")
        .select(
            "symbol",
            F.when(n > 0, "cached")
            .when(F.col("address").isNull(), "no-address")
            .when(F.col("pool_address").isNull(), "no-pool")
            .otherwise("empty")
            .alias("status"),
            n.alias("n_rows"),
            F.coalesce("latest", F.lit(0.0)).alias("latest"),
        )
    )
