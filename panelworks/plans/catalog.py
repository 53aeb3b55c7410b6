"""Registered queries, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (
    align,
    bootstrap,
    changepoint,
    em,
    export,
    flows,
    hmm,
    panel,
    portfolio,
    rebalance,
    regime,
    report,
    runs,
    validation,
    weights,
    windows,
)
from ..operators import features as feat
from ..schemas import FEATURES, REGIMES
from ..sources import dims, landed, payloads, stores
from ..session import materialize, scratch_path
from . import workflows
from .oracle import pick, sql
from .standins import CONFIG_IDS, CONFIGS, PATHS, STABLES, TVL, VARIANTS, Inputs, tidy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` with its SQL."""

    def add(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(Inputs(spark, sf_dir)))
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


# --- panels and alignment ---------------------------------------------------


@query("price_panel", pick("prices", "panel_id symbol date", "ord", "close",
    where="date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"))
def _(d):
    return panel.price_panel(d.lazy_prices.drop("ord"), d.universe, "1996-01-01", "1998-12-31")


@query("dense_panel", pick("dense", "panel_id symbol date", "ord pos", "close"))
def _(d):
    return panel.dense_grid(d.prices)


@query("calendar", pick("cal", "panel_id date", "pos n_dates n_names"))
def _(d):
    return panel.calendar(d.lazy_prices)


_UNIVERSE = """SELECT panel_id, 'Brand#' || k AS symbol, CAST(k AS BIGINT) AS ord
    FROM (SELECT 'nation_' || s_nationkey AS panel_id FROM supplier UNION SELECT 'brands' FROM supplier), range(1, 31) AS r(k)"""


@query("missing_worklist", sql("""SELECT u.panel_id, u.symbol, u.ord FROM universe u LEFT JOIN
    (SELECT DISTINCT panel_id, symbol FROM prices WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-06-30') p
    ON p.panel_id = u.panel_id AND p.symbol = u.symbol WHERE p.symbol IS NULL""", universe=_UNIVERSE))
def _(d):
    return panel.missing_symbols(d.lazy_prices, d.universe, "1996-01-01", "1996-06-30")


@query("panel_guard", sql("""SELECT panel_id, count(DISTINCT date) AS n_dates, count(DISTINCT symbol) AS n_symbols,
    count(DISTINCT date) >= 2 AND count(DISTINCT symbol) >= 1 AS accepted FROM prices GROUP BY 1"""))
def _(d):
    return panel.panel_guard(d.lazy_prices)


_WHALE_FEATS = """SELECT c.panel_id, c.pos, c.date, coalesce(last_value(z.w IGNORE NULLS) OVER w, 0) AS net_whale_flow_z,
    coalesce(last_value(z.x IGNORE NULLS) OVER w, 0) AS net_cex_flow_z
    FROM cal c LEFT JOIN (SELECT date, max(CASE kind WHEN 'whaleflow' THEN z END) AS w,
        max(CASE kind WHEN 'cexflow' THEN z END) AS x FROM flow_z GROUP BY 1) z ON z.date = c.date
    WINDOW w AS (PARTITION BY c.panel_id ORDER BY c.pos ROWS UNBOUNDED PRECEDING)"""


@query("coverage", sql("""SELECT panel_id,
    count(net_whale_flow_z) AS net_whale_flow_z_rows, count(CASE WHEN net_whale_flow_z <> 0 THEN 1 END) AS net_whale_flow_z_nonzero,
    coalesce(max(abs(net_whale_flow_z)) > 0, false) AS net_whale_flow_z_any,
    count(net_cex_flow_z) AS net_cex_flow_z_rows, count(CASE WHEN net_cex_flow_z <> 0 THEN 1 END) AS net_cex_flow_z_nonzero,
    coalesce(max(abs(net_cex_flow_z)) > 0, false) AS net_cex_flow_z_any
    FROM whale_feats GROUP BY 1""", whale_feats=_WHALE_FEATS))
def _(d):
    return panel.coverage(flows.flow_features(d.calendar, d.side_series), ["panel_id"], ["net_whale_flow_z", "net_cex_flow_z"])


_TVL_COLS = "tvl_mom20 tvl_dd pancake_share_mom20"


@query("align_exact_ffill", sql("""SELECT c.panel_id, c.date,
    floor(1e6 * (coalesce(last_value(s.net IGNORE NULLS) OVER (PARTITION BY c.panel_id ORDER BY c.date ROWS UNBOUNDED PRECEDING), 0)) + 0.5e0) / 1e6 AS net
    FROM cal c LEFT JOIN (SELECT date, sum(value) AS net FROM side WHERE kind = 'cexflow' GROUP BY 1) s ON s.date = c.date"""))
def _(d):
    net = flows.select_series(d.side_series, "cexflow").groupBy("date").agg(F.sum("value").alias("net"))
    return align.align_exact(d.calendar.select("panel_id", "date"), net, ["net"], ["panel_id"])


@query("align_asof", sql(f"""SELECT panel_id, date, {', '.join(
    f"floor(1e6 * (coalesce(last_value({c} IGNORE NULLS) OVER w, 0)) + 0.5e0) / 1e6 AS {c}" for c in _TVL_COLS.split())}
    FROM (SELECT c.panel_id, c.date, t.tvl_mom20, t.tvl_dd, t.pancake_share_mom20
          FROM cal c ASOF LEFT JOIN tvl_native t ON c.date >= t.date)
    WINDOW w AS (PARTITION BY panel_id ORDER BY date ROWS UNBOUNDED PRECEDING)"""))
def _(d):
    native = flows.tvl_features(*d.tvl)
    return align.align_asof(d.calendar.select("panel_id", "date"), native, _TVL_COLS.split(), ["panel_id"])


@query("feature_join", sql(f"""SELECT f.panel_id, f.date, {', '.join(f"floor(1e6 * (f.{c}) + 0.5e0) / 1e6 AS {c}" for c in FEATURES)},
    floor(1e6 * (w.net_whale_flow_z) + 0.5e0) / 1e6 AS net_whale_flow_z FROM feats f LEFT JOIN whale_feats w
    ON w.panel_id = f.panel_id AND w.date = f.date""", whale_feats=_WHALE_FEATS))
def _(d):
    extra = flows.flow_features(d.calendar, d.side_series).select("panel_id", "date", "net_whale_flow_z")
    return d.features.drop("pos").join(extra, ["panel_id", "date"], "left")


# --- roll-ups and dimensions ------------------------------------------------


@query("bars_daily", pick("bars", "symbol date", "", "open high low close volume"))
def _(d):
    return d.bars


@query("token_flow_daily", sql("""SELECT token, date, floor(1e6 * (sum(amount)) + 0.5e0) / 1e6 AS volume, count(*) AS count
    FROM transfers WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' GROUP BY 1, 2"""))
def _(d):
    return flows.token_flow(d.transfers, "2024-01-03", "2024-01-28")


_THRESHOLDS = "SELECT * FROM (VALUES ('click', 50e0), ('purchase', 200e0)) AS t(token, min_amount)"


@query("token_flow_whale", sql("""SELECT x.token, date, floor(1e6 * (sum(amount)) + 0.5e0) / 1e6 AS volume, count(*) AS count
    FROM transfers x LEFT JOIN thresholds t ON t.token = x.token
    WHERE amount >= coalesce(t.min_amount, 1e2) GROUP BY 1, 2""", thresholds=_THRESHOLDS))
def _(d):
    limits = dims.pairs(d.spark, {"click": 50.0, "purchase": 200.0}, "token string, min_amount double")
    return flows.token_flow(flows.with_threshold(d.transfers, limits, 100.0), min_amount=F.col("min_amount"))


@query("threshold_join", sql("""SELECT x.token, count(*) AS n, coalesce(max(t.min_amount), 1e4) AS min_amount
    FROM transfers x LEFT JOIN thresholds t ON t.token = x.token GROUP BY 1""", thresholds=_THRESHOLDS))
def _(d):
    limits = dims.pairs(d.spark, {"click": 50.0, "purchase": 200.0}, "token string, min_amount double")
    tokens = d.transfers.groupBy("token").agg(F.count("*").alias("n"))
    return flows.with_threshold(tokens, limits)


@query("cex_flow_daily", sql("""SELECT coalesce(i.token, o.token) AS token, coalesce(i.date, o.date) AS date,
    floor(1e6 * (coalesce(inflow, 0)) + 0.5e0) / 1e6 AS inflow, floor(1e6 * (coalesce(outflow, 0)) + 0.5e0) / 1e6 AS outflow,
    floor(1e6 * (coalesce(inflow, 0) - coalesce(outflow, 0)) + 0.5e0) / 1e6 AS net_inflow FROM
    (SELECT token, date, sum(amount) AS inflow FROM transfers SEMI JOIN wallets ON receiver = address GROUP BY 1, 2) i
    FULL JOIN (SELECT token, date, sum(amount) AS outflow FROM transfers SEMI JOIN wallets ON sender = address GROUP BY 1, 2) o
    ON i.token = o.token AND i.date = o.date"""))
def _(d):
    return flows.exchange_flow(d.transfers, d.wallets)


@query("wallet_dim", sql("""SELECT sender AS address FROM transfers WHERE amount >= 300
    UNION SELECT receiver FROM transfers WHERE amount >= 300"""))
def _(d):
    listed = d.transfers.filter("amount >= 300").select(F.array("sender", "receiver").alias("addresses"))
    return dims.wallet_addresses(listed)


@query("universe_dim", sql("SELECT p_brand AS symbol, min(p_partkey) AS ord FROM part GROUP BY 1"))
def _(d):
    return dims.universe(d.table("part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("symbol")))


@query("token_resolve", sql("""SELECT sym, chain, CASE WHEN upper(sym) LIKE '0X%' THEN sym
    WHEN chain = 'bsc' AND upper(sym) = 'CLICK' THEN '0xc11c' WHEN upper(sym) = 'VIEW' THEN 'WVIEW' ELSE upper(sym) END AS resolved
    FROM (SELECT DISTINCT event_type AS sym, CASE WHEN user_id % 2 = 0 THEN 'bsc' ELSE 'eth' END AS chain FROM events
          UNION ALL SELECT DISTINCT '0x' || user_id, 'bsc' FROM events)"""))
def _(d):
    ev = d.table("events")
    chain = F.when(F.col("user_id") % 2 == 0, "bsc").otherwise("eth")
    named = ev.select(F.col("event_type").alias("sym"), chain.alias("chain")).distinct()
    raw = ev.select(F.concat(F.lit("0x"), F.col("user_id")).alias("sym"), F.lit("bsc").alias("chain")).distinct()
    return dims.resolve_tokens(
        named.unionByName(raw),
        dims.pairs(d.spark, {"CLICK": "0xc11c"}, "symbol string, address string"),
        dims.pairs(d.spark, {"VIEW": "WVIEW"}, "symbol string, alias string"),
    )


@query("series_select", sql("SELECT symbol, date, floor(1e6 * (value) + 0.5e0) / 1e6 AS value FROM side WHERE kind = 'whaleflow'"))
def _(d):
    return flows.select_series(d.side_series, "whaleflow", d.symbols).drop("kind")


_MAIN = ["Brand#1", "Brand#2", "Brand#3", "Brand#99"]


@query("series_panel", sql(f"""SELECT date, {', '.join(f'''floor(1e6 * (max(CASE WHEN symbol = '{s}' THEN value END)) + 0.5e0) / 1e6 AS "{s}"''' for s in _MAIN)}
    FROM side WHERE kind = 'dexvol' AND symbol IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1"""))
def _(d):
    return flows.series_panel(d.side_series, "dexvol", _MAIN)


@query("backfill_status", sql("""SELECT u.symbol, CASE WHEN coalesce(n, 0) > 0 THEN 'cached' WHEN k > 28 THEN 'no-address'
    WHEN k > 27 THEN 'no-pool' ELSE 'empty' END AS status, coalesce(n, 0) AS n_rows, floor(1e6 * (coalesce(latest, 0)) + 0.5e0) / 1e6 AS latest
    FROM (SELECT 'Brand#' || k AS symbol, k FROM range(1, 31) AS r(k)) u
    LEFT JOIN (SELECT symbol, count(*) AS n, arg_max(value, date) AS latest FROM side WHERE kind = 'dexvol' GROUP BY 1) s
    ON s.symbol = u.symbol"""))
def _(d):
    names = d.symbols.select("symbol", "ord").distinct()
    address = F.concat(F.lit("0x"), F.col("ord"))
    return flows.backfill_status(
        names,
        names.filter("ord <= 28").select("symbol", address.alias("address")),
        names.filter("ord <= 27").select(address.alias("address"), F.lit("pool").alias("pool_address")),
        d.side_series,
        "dexvol",
    )


# --- payloads (built from the bars with to_json, then flattened) ------------


def _bar_json(usd="USD"):
    candle = F.struct("open", "high", "low", "close", "volume")
    stamp = F.date_format("date", "yyyy-MM-dd'T'00:00:00.000'Z'")
    return F.struct(stamp.alias("time_open"), F.create_map(F.lit(usd), candle).alias("quote"))


@query("ohlcv_json_flatten", pick("bars", "symbol date", "", "open high low close volume"))
def _(d):
    quotes = d.bars.groupBy("symbol").agg(F.collect_list(_bar_json()).alias("quotes"))
    k = F.substring("symbol", 7, 9).cast("int") % 3
    keyed = lambda v: F.to_json(F.struct(F.create_map("symbol", v).alias("data")))
    entry = F.struct(F.lit(1).alias("id"), "quotes")
    body = (
        F.when(k == 0, keyed(F.array(entry, F.struct(F.lit(2).alias("id"), F.array_compact(F.slice("quotes", 1, 1)).alias("quotes")))))
        .when(k == 1, keyed(entry))
        .otherwise(F.to_json(F.struct(entry.alias("data"))))
    )
    return payloads.ohlcv_quotes(quotes.select("symbol", body.alias("body")))


@query("quotes_json_flatten", sql("""SELECT symbol, floor(1e6 * (arg_max(close, date)) + 0.5e0) / 1e6 AS price,
    CASE WHEN max(date) < DATE '2001-11-01' THEN NULL ELSE floor(1e6 * (arg_max(volume, date)) + 0.5e0) / 1e6 END AS volume_24h FROM bars GROUP BY 1"""))
def _(d):
    last = d.bars.groupBy("symbol").agg(
        F.max_by("close", "date").alias("price"), F.max_by("volume", "date").alias("vol"), F.max("date").alias("date")
    )
    quote = F.struct("price", F.when(F.col("date") >= "2001-11-01", F.col("vol")).alias("volume_24h"))
    doc = F.struct(F.create_map("symbol", F.struct(F.create_map(F.lit("USD"), quote).alias("quote"))).alias("data"))
    return payloads.latest_quotes(last.select(F.to_json(doc).alias("body")))


def _tvl_body(df, value):
    # Each day twice, the stale copy first; newest day first.
    stamp = F.unix_timestamp(F.col("date").cast("timestamp"))
    rows = df.select("chain_id", "date", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), (F.col("value") * 1.0).alias("v"), stamp.alias("s"))
    point = F.struct((F.col("s") + F.col("k") * 3600).alias("date"), F.when(F.col("k") == 1, F.col("v")).otherwise(-1.0).alias(value))
    ordered = F.collect_list(F.struct(-F.col("s"), F.col("k"), point.alias("p")))
    return rows.groupBy("chain_id").agg(F.array_sort(ordered)["p"].alias("points"))


@query("tvl_json_flatten_dedup", sql("SELECT 'BSC' AS chain_id, date, floor(1e6 * (tvl) + 0.5e0) / 1e6 AS value FROM chain"))
def _(d):
    body = _tvl_body(d.tvl[0], "tvl")
    return payloads.chain_tvl(body.select("chain_id", F.to_json("points").alias("body")))


@query("protocol_tvl_flatten", sql("SELECT 'BSC' AS chain_id, date, floor(1e6 * (protocol) + 0.5e0) / 1e6 AS value FROM proto"))
def _(d):
    body = _tvl_body(d.tvl[1], "totalLiquidityUSD")
    chains = F.create_map(
        F.lit("Ethereum"), F.struct(F.slice("points", 1, 1).alias("tvl")), F.lit("Binance"), F.struct(F.col("points").alias("tvl"))
    )
    return payloads.protocol_tvl(body.select("chain_id", F.to_json(F.struct(chains.alias("chainTvls"))).alias("body")))


@query("candle_array_flatten", sql("""SELECT symbol, date, floor(1e6 * (open) + 0.5e0) / 1e6 AS open, floor(1e6 * (high) + 0.5e0) / 1e6 AS high,
    floor(1e6 * (low) + 0.5e0) / 1e6 AS low, floor(1e6 * (close) + 0.5e0) / 1e6 AS close, floor(1e6 * (volume) + 0.5e0) / 1e6 AS volume FROM bars"""))
def _(d):
    stamp = F.unix_timestamp(F.col("date").cast("timestamp")).cast("double")
    candle = F.array(stamp, *[F.col(c) for c in ("open", "high", "low", "close", "volume")])
    rows = d.bars.groupBy("symbol").agg(F.sort_array(F.collect_list(candle), asc=False).alias("ohlcv_list"))
    doc = F.struct(F.struct(F.struct("ohlcv_list").alias("attributes")).alias("data"))
    return payloads.candles(rows.select("symbol", F.to_json(doc).alias("body")))


@query("top_pool", sql("""SELECT token, pool_address, reserve_usd, volume_24h FROM (
    SELECT token, CAST(h AS VARCHAR) AS pool_address, CASE WHEN h % 10 = 3 THEN 0e0 ELSE s END AS reserve_usd, n AS volume_24h,
           row_number() OVER (PARTITION BY token ORDER BY CASE WHEN h % 10 = 3 THEN 0e0 ELSE s END DESC, h) AS rk
    FROM (SELECT token, hour(ts) AS h, CAST(sum(CAST(round(amount * 100) AS BIGINT)) // 100000 AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n
          FROM transfers GROUP BY 1, 2)) WHERE rk = 1"""))
def _(d):
    # One pool per token and hour of day; some report a reserve that is not a number.
    sums = d.transfers.groupBy("token", F.hour("ts").alias("h")).agg(
        F.floor(F.sum(F.round(F.col("amount") * 100).cast("bigint")) / 100000).alias("s"), F.count("*").alias("n")
    )
    reserve = F.when(F.col("h") % 10 == 3, "n/a").otherwise(F.col("s").cast("string"))
    listed = F.array_sort(F.collect_list(F.struct("h", reserve.alias("reserve"), F.col("n").cast("string").alias("n"))))
    pool = lambda p: F.struct(
        F.concat(F.lit("bsc_"), p["h"]).alias("id"),
        F.struct(p["reserve"].alias("reserve_in_usd"), F.create_map(F.lit("h24"), p["n"]).alias("volume_usd")).alias("attributes"),
    )
    rows = sums.groupBy("token").agg(F.transform(listed, pool).alias("data"))
    return payloads.top_pools(rows.select("token", F.to_json(F.struct("data")).alias("body")))


# --- the same shapes landed in one table: fetches overlap, and the last fetch of each key is broken ----

_OLD, _NEW, _BAD = "2024-01-01", "2024-01-02", "2024-01-03"


def _landed(source, key, fetched, body):
    return F.struct(F.lit(source).alias("source"), key.cast("string").alias("key"), F.lit(fetched).cast("date").alias("fetched_at"), body.alias("body"))


def _raw(df, *responses):
    return df.select(F.inline(F.array(*responses)))


def _broken(body):
    return F.substring(body, 1, 20)


@query("landed_bars", sql("""SELECT symbol, date, floor(1e6 * (CASE WHEN year(date) < 1996 THEN open + 1 ELSE open END) + 0.5e0) / 1e6 AS open,
    floor(1e6 * (high) + 0.5e0) / 1e6 AS high, floor(1e6 * (low) + 0.5e0) / 1e6 AS low, floor(1e6 * (close) + 0.5e0) / 1e6 AS close,
    floor(1e6 * (volume) + 0.5e0) / 1e6 AS volume FROM bars WHERE year(date) < 2000"""))
def _(d):
    # The old fetch ends with 1997 and has other opens; the new one begins with 1996.
    def body(symbol, quotes):
        entry = F.struct(quotes.alias("quotes"))
        k = F.substring(symbol, 7, 9).cast("int") % 3
        keyed = lambda v: F.to_json(F.struct(F.create_map(symbol, v).alias("data")))
        return F.when(k == 0, keyed(F.array(entry))).when(k == 1, keyed(entry)).otherwise(F.to_json(F.struct(entry.alias("data"))))

    stale = d.bars.filter(F.year("date") < 1998).withColumn("open", F.col("open") + 1).groupBy("symbol").agg(F.collect_list(_bar_json()).alias("quotes"))
    fresh = d.bars.filter(F.year("date").between(1996, 1999)).groupBy("symbol").agg(F.collect_list(_bar_json()).alias("quotes"))
    make = lambda df, day: _raw(df, _landed("ohlcv", F.col("symbol"), day, body(F.col("symbol"), F.col("quotes"))))
    bad = _raw(fresh, _landed("ohlcv", F.col("symbol"), _BAD, _broken(body(F.col("symbol"), F.col("quotes")))))
    return landed.bars(landed.parsed(make(stale, _OLD).unionByName(make(fresh, _NEW)).unionByName(bad)))


@query("landed_quotes", sql("""SELECT symbol, floor(1e6 * (arg_max(close, date)) + 0.5e0) / 1e6 AS price,
    CASE WHEN max(date) < DATE '2001-11-01' THEN NULL ELSE floor(1e6 * (arg_max(volume, date)) + 0.5e0) / 1e6 END AS volume_24h FROM bars GROUP BY 1"""))
def _(d):
    last = d.bars.groupBy("symbol").agg(F.max_by("close", "date").alias("price"), F.max_by("volume", "date").alias("vol"), F.max("date").alias("date"))
    quote = lambda add: F.struct((F.col("price") + add).alias("price"), F.when(F.col("date") >= "2001-11-01", F.col("vol")).alias("volume_24h"))
    # Old responses name three symbols each, new ones one.
    entry = lambda add: F.struct(F.struct(quote(add).alias("USD")).alias("quote"))
    many = last.groupBy((F.crc32("symbol") % 7).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("symbol", entry(1)))).alias("data"))
    old = _raw(many, _landed("quotes", F.col("k"), _OLD, F.to_json(F.struct("data"))))
    one = F.to_json(F.struct(F.create_map("symbol", entry(0)).alias("data")))
    new = _raw(last, _landed("quotes", F.col("symbol"), _NEW, one), _landed("quotes", F.col("symbol"), _BAD, _broken(one)))
    return landed.quotes(landed.parsed(old.unionByName(new)))


def _pool_bodies(d):
    """Landed pools of each token: an old fetch with larger reserves, a new one, and a broken one."""
    sums = d.transfers.groupBy("token", F.hour("ts").alias("h")).agg(
        F.floor(F.sum(F.round(F.col("amount") * 100).cast("bigint")) / 100000).alias("s"), F.count("*").alias("n")
    )
    listed = F.array_sort(F.collect_list(F.struct("h", "s", "n")))

    def body(times):
        reserve = lambda p: F.when(p["h"] % 10 == 3, "n/a").otherwise((p["s"] * times).cast("string"))
        pool = lambda p: F.struct(
            F.concat(F.lit("bsc_"), p["h"]).alias("id"),
            F.struct(reserve(p).alias("reserve_in_usd"), F.create_map(F.lit("h24"), p["n"].cast("string")).alias("volume_usd")).alias("attributes"),
        )
        return F.to_json(F.struct(F.transform("pools", pool).alias("data")))

    rows = sums.groupBy("token").agg(listed.alias("pools"))
    return _raw(rows, _landed("pools", F.col("token"), _OLD, body(100)), _landed("pools", F.col("token"), _NEW, body(1)), _landed("pools", F.col("token"), _BAD, _broken(body(1))))


@query("landed_pools", SQL["top_pool"])
def _(d):
    return landed.pools(landed.parsed(_pool_bodies(d)))


@query("landed_tvl", sql("""SELECT 'BSC' AS chain_id, date, floor(1e6 * (CASE WHEN year(date) < 1996 THEN -1 ELSE tvl END) + 0.5e0) / 1e6 AS value FROM chain"""))
def _(d):
    point = F.struct(F.unix_timestamp(F.col("date").cast("timestamp")).alias("date"), F.col("v").alias("tvl"))
    days = d.tvl[0].withColumn("v", F.col("value") * 1.0)
    make = lambda df: F.to_json(F.collect_list(point))
    old = days.withColumn("v", F.lit(-1.0)).groupBy("chain_id").agg(make(days).alias("body"))
    new = days.filter(F.year("date") >= 1996).groupBy("chain_id").agg(make(days).alias("body"))
    at = lambda df, day, b: _raw(df, _landed("tvl", F.col("chain_id"), day, b))
    return landed.tvl(landed.parsed(at(old, _OLD, F.col("body")).unionByName(at(new, _NEW, F.col("body"))).unionByName(at(new, _BAD, _broken(F.col("body"))))))


@query("landed_rejects", sql(f"""SELECT 'pools' AS source, token AS key, DATE '{_BAD}' AS fetched_at, CAST(20 AS BIGINT) AS n_chars FROM transfers GROUP BY token"""))
def _(d):
    return landed.rejects(landed.parsed(_pool_bodies(d))).drop("body")


@query("transfer_rows_flatten", sql("""SELECT token, date, floor(1e6 * (sum(amount)) + 0.5e0) / 1e6 AS volume, count(*) AS count
    FROM transfers GROUP BY 1, 2"""))
def _(d):
    daily = flows.token_flow(d.transfers)
    row = F.struct(
        F.struct(F.date_format("date", "yyyy-MM-dd'T'00:00:00'Z'").alias("Date")).alias("Block"),
        F.col("count").cast("string").alias("count"),
        F.col("volume").cast("decimal(38,18)").cast("string").alias("sum_amount"),
    )
    body = daily.groupBy("token").agg(F.to_json(F.collect_list(row)).alias("body"))
    return payloads.transfer_aggregates(body)


@query("bars_store", sql("""SELECT symbol, date, floor(1e6 * (open) + 0.5e0) / 1e6 AS open, floor(1e6 * (high) + 0.5e0) / 1e6 AS high,
    floor(1e6 * (low) + 0.5e0) / 1e6 AS low, floor(1e6 * (close) + 0.5e0) / 1e6 AS close, floor(1e6 * (CASE WHEN symbol = 'Brand#2' THEN 2 * volume ELSE volume END) + 0.5e0) / 1e6 AS volume FROM bars
    WHERE symbol IN ('Brand#1', 'Brand#2', 'Brand#3') AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"""))
def _(d):
    path = scratch_path(d.spark)
    stores.put_bars(d.bars, path, 8)
    stores.put_bars(d.bars.filter("symbol = 'Brand#2'").withColumn("volume", F.col("volume") * 2), path, 8)
    return stores.get_bars(d.spark, path, ["Brand#1", "Brand#2", "Brand#3"], "1996-01-01", "1997-12-31")


@query("series_store", sql("""SELECT kind, symbol, date, floor(1e6 * (value) + 0.5e0) / 1e6 AS value FROM side WHERE kind = 'cexflow'"""))
def _(d):
    path = scratch_path(d.spark)
    stores.put_series(d.side_series, path, 8)
    return stores.get_series(d.spark, path, "cexflow")


# --- features ---------------------------------------------------------------


@query("simple_returns", pick("rets", "panel_id symbol date", "pos", "ret", where="close IS NOT NULL"))
def _(d):
    return feat.simple_returns(d.indexed).select("panel_id", "symbol", "date", "pos", "ret")


@query("market_return", pick("mkt", "panel_id date", "", "market_return"))
def _(d):
    return d.market.select("panel_id", "date", "market_return")


@query("breadth_dispersion", pick("mkt", "panel_id date", "", "breadth dispersion"))
def _(d):
    return d.market.select("panel_id", "date", "breadth", "dispersion")


@query("realized_vol", pick("feat_raw", "panel_id date", "", "realized_vol"))
def _(d):
    return feat.market_windows(d.market).select("panel_id", "date", "realized_vol")


@query("trend_strength", pick("feat_raw", "panel_id date", "", "trend_strength"))
def _(d):
    return feat.market_windows(d.market).select("panel_id", "date", "trend_strength")


@query("feature_panel", pick("feats", "panel_id date", "pos", " ".join(FEATURES)))
def _(d):
    return d.features


@query("market_index", pick("mkt", "panel_id date", "pos", "index_value"))
def _(d):
    return d.market.select("panel_id", "date", "pos", "index_value")


@query("risk_off_flag", pick("risk", "panel_id date risk_off", "pos", "index_value drawdown moving_average"))
def _(d):
    return d.gates


@query("tvl_features", sql(f"""SELECT 'BSC' AS chain_id, date, {', '.join(f"floor(1e6 * ({c}) + 0.5e0) / 1e6 AS {c}" for c in _TVL_COLS.split())} FROM tvl_native"""))
def _(d):
    return flows.tvl_features(*d.tvl)


@query("tvl_panel", sql(f"""SELECT c.panel_id, c.date, {', '.join(
    f"floor(1e6 * (coalesce(last_value(t.{c} IGNORE NULLS) OVER w, 0)) + 0.5e0) / 1e6 AS {c}" for c in _TVL_COLS.split())}
    FROM cal c LEFT JOIN tvl_native t ON t.date = c.date WINDOW w AS (PARTITION BY c.panel_id ORDER BY c.date ROWS UNBOUNDED PRECEDING)"""))
def _(d):
    return flows.tvl_panel(d.calendar.select("panel_id", "date"), *d.tvl)


@query("flow_market_agg", pick("flow_mean", "kind date", "", "value"))
def _(d):
    return flows.market_aggregate(d.side_series)


@query("flow_z", pick("flow_z", "kind date", "", "value z"))
def _(d):
    return flows.trailing_z(flows.market_aggregate(d.side_series), ["kind"])


@query("flow_features", sql("""SELECT panel_id, date, floor(1e6 * (net_whale_flow_z) + 0.5e0) / 1e6 AS net_whale_flow_z,
    floor(1e6 * (net_cex_flow_z) + 0.5e0) / 1e6 AS net_cex_flow_z FROM whale_feats""", whale_feats=_WHALE_FEATS))
def _(d):
    return flows.flow_features(d.calendar.select("panel_id", "date"), d.side_series)


# --- regimes ----------------------------------------------------------------


@query("scaler_prefix", sql(f"""SELECT panel_id, CAST(refit_pos AS BIGINT) AS refit_pos, {', '.join(
    f"floor(1e6 * (m_{c}) + 0.5e0) / 1e6 AS {c}_center, floor(1e6 * (s_{c}) + 0.5e0) / 1e6 AS {c}_scale" for c in FEATURES)}
    FROM prefix_models WHERE refit_pos >= 60 AND (refit_pos - 60) % 6 = 0"""))
def _(d):
    return regime.scaler_prefix(d.features)


@query("refit_schedule", pick("sched", "panel_id date", "pos refit_pos"))
def _(d):
    return regime.refit_schedule(d.features).select("panel_id", "date", "pos", "refit_pos")


@query("state_labels", sql(f"""SELECT panel_id, 'baseline' AS path_id, CAST(refit_pos AS BIGINT) AS refit_pos, regime, {', '.join(
    f"floor(1e6 * (mu_{c}) + 0.5e0) / 1e6 AS {c}" for c in FEATURES)} FROM ranked_states"""))
def _(d):
    return regime.signatures(regime.label_states(d.models))


@query("posterior_score", sql(f"""SELECT panel_id, date, {', '.join(
    f"floor(1e6 * (max(CASE WHEN regime = '{r}' THEN prob END)) + 0.5e0) / 1e6 AS p_{r}" for r in REGIMES)} FROM post GROUP BY 1, 2"""))
def _(d):
    scored = regime.posterior(regime.refit_schedule(d.features), regime.label_states(d.models))
    return scored.select("panel_id", "date", *[f"p_{r}" for r in REGIMES])


@query("regime_read", sql("""SELECT panel_id, date, CAST(pos AS BIGINT) AS pos, regime, floor(1e6 * (prob) + 0.5e0) / 1e6 AS confidence,
    floor(1e6 * (realized_vol) + 0.5e0) / 1e6 AS realized_vol FROM best"""))
def _(d):
    return d.reads.select("panel_id", "date", "pos", "regime", "confidence", F.col("features")["realized_vol"].alias("realized_vol"))


@query("attribution", sql(f"""SELECT panel_id, date, {', '.join(
    f"floor(1e6 * (coalesce(c_{c} / nullif(whole, 0), 0)) + 0.5e0) / 1e6 AS {c}" for c in FEATURES)} FROM contrib"""))
def _(d):
    return d.reads.select("panel_id", "date", *[F.col("attribution")[c].alias(c) for c in FEATURES])


@query("attribution_topk", sql(f"""SELECT panel_id, 'baseline' AS path_id, date, rank, feature, floor(1e6 * (contribution) + 0.5e0) / 1e6 AS contribution FROM (
    SELECT panel_id, date, feature, contribution, row_number() OVER (PARTITION BY panel_id, date ORDER BY abs(contribution) DESC, feature) AS rank
    FROM ({' UNION ALL '.join(
        f"SELECT panel_id, date, '{c}' AS feature, coalesce(c_{c} / nullif(whole, 0), 0) AS contribution FROM contrib" for c in FEATURES)}))
    WHERE rank <= 3"""))
def _(d):
    return regime.attribution_topk(d.reads)


@query("hysteresis", pick("lab_active", "panel_id config_id date regime active", "pos", where="config_id IN ('ungated', 'gated_eager')"))
def _(d):
    path = d.path.withColumn("config_id", F.when(F.col("path_id") == "baseline", "ungated").otherwise("gated_eager"))
    return runs.hysteresis(path, ["panel_id", "config_id"]).select("panel_id", "config_id", "date", "regime", "active", "pos")


@query("debounce_gate", pick("gate", "panel_id date risk_off gate", "pos confirm", where="config_id IN ('gated', 'confirm2', 'confirm3')"))
def _(d):
    reads = d.gates.select("panel_id", "date", "pos", "risk_off", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("confirm"))
    return runs.confirmed_gate(reads, ["panel_id", "confirm"], F.col("confirm"))


@query("label_counts", sql("""SELECT panel_id, path_id, regime, count(*) AS days,
    floor(1e6 * (count(*) / CAST(sum(count(*)) OVER (PARTITION BY panel_id, path_id) AS DOUBLE)) + 0.5e0) / 1e6 AS share FROM path GROUP BY 1, 2, 3"""))
def _(d):
    return regime.label_counts(d.path)


@query("label_deltas", sql("""SELECT panel_id, regime, CAST(sum(CASE path_id WHEN 'eager' THEN 1 ELSE -1 END) AS BIGINT) AS delta_days
    FROM path GROUP BY 1, 2"""))
def _(d):
    return regime.label_deltas(regime.label_counts(d.path), "baseline", "eager")


@query("regime_bands", sql("""SELECT panel_id, path_id, regime, min(date) AS from_date, max(date) AS to_date, count(*) AS n_days FROM (
    SELECT *, row_number() OVER (PARTITION BY panel_id, path_id ORDER BY date) - row_number() OVER (PARTITION BY panel_id, path_id, regime ORDER BY date) AS g
    FROM (SELECT c.panel_id, v.path_id, c.date, coalesce(p.regime, 'unclassified') AS regime FROM cal c CROSS JOIN (VALUES ('baseline'), ('eager')) AS v(path_id)
          LEFT JOIN path p ON p.panel_id = c.panel_id AND p.date = c.date AND p.path_id = v.path_id))
    GROUP BY panel_id, path_id, regime, g"""))
def _(d):
    days = d.calendar.select("panel_id", "date", F.explode(F.array(*map(F.lit, PATHS))).alias("path_id"))
    path = d.path.select("panel_id", "path_id", "date", "regime")
    return runs.bands(days.join(path, ["panel_id", "path_id", "date"], "left"), ["panel_id", "path_id"])


@query("stance", sql("""SELECT p.panel_id, p.path_id, p.date, p.regime, r.risk_off, CASE WHEN r.risk_off THEN 'defensive' ELSE
    CASE p.regime WHEN 'trending' THEN 'momentum' WHEN 'high_volatility' THEN 'defensive' ELSE 'market portfolio' END END AS stance
    FROM path p JOIN risk r ON r.panel_id = p.panel_id AND r.pos = p.pos"""))
def _(d):
    rows = d.path.join(d.gates.select("panel_id", "pos", "risk_off"), ["panel_id", "pos"])
    return rows.select("panel_id", "path_id", "date", "regime", "risk_off", regime.stance(F.col("regime"), F.col("risk_off")).alias("stance"))


_MOMENTS = [f"{m}_{c}" for c in FEATURES for m in ("mu", "var")]


@query("em_step", pick("em_states", "panel_id", "refit_pos state", " ".join(["loglik", "start", *_MOMENTS, "t0", "t1", "t2"])))
def _(d):
    states = d.em_models.select("panel_id", "refit_pos", "loglik", "trans", F.posexplode("states").alias("state", "s"))
    moments = [F.col(f"s.{m}")[i].alias(f"{m}_{c}") for i, c in enumerate(FEATURES) for m in ("mu", "var")]
    moves = [F.get(F.get("trans", F.col("state")), F.lit(j)).alias(f"t{j}") for j in range(3)]
    return states.select("panel_id", "refit_pos", "state", "loglik", "s.start", *moments, *moves)


@query("regime_path_em", sql("""SELECT panel_id, date, regime, CAST(pos AS BIGINT) AS pos, CAST(refit_pos AS BIGINT) AS refit_pos,
    floor(1e6 * (prob) + 0.5e0) / 1e6 AS confidence FROM em_best"""))
def _(d):
    labelled = regime.label_states(materialize(d.em_models))
    scored = regime.posterior(regime.refit_schedule(d.features), labelled)
    refits = regime.refit_schedule(d.features).select("panel_id", "pos", "refit_pos")
    return regime.reads(scored).join(refits, ["panel_id", "pos"]).select("panel_id", "date", "regime", "pos", "refit_pos", "confidence")


# Trained models depend on random draws, which other engines do not repeat: no SQL.
@query("hmm_fit")
def _(d):
    models = hmm.fit_models(hmm.training_jobs([hmm.PathSpec("baseline", d.features)]))
    moments = [F.get(k, F.lit(i)).alias(f"{c}_{k}") for i, c in enumerate(FEATURES) for k in ("center", "scale")]
    start = [F.col("states")[k]["start"].alias(f"start_{k}") for k in range(3)]
    mu = [F.col("states")[k]["mu"][i].alias(f"mu_{k}_{c}") for k in range(3) for i, c in enumerate(FEATURES)]
    return models.select("panel_id", "path_id", "refit_pos", "loglik", *moments, *start, *mu)


@query("hmm_likelihood")
def _(d):
    """Log-likelihoods that the training reports, and those that the plan's forward pass finds."""
    features = materialize(d.features)
    models = materialize(hmm.fit_models(hmm.training_jobs([hmm.PathSpec("baseline", features)])))
    scanned = em.em_step(features, models).select("panel_id", "refit_pos", F.col("loglik").alias("scanned"))
    return models.select("panel_id", "refit_pos", "loglik").join(scanned, ["panel_id", "refit_pos"])


@query("regime_path")
def _(d):
    return regime.regime_reads(d.features).select("panel_id", "path_id", "date", "pos", hmm.refit_position(60, 5).alias("refit_pos"), "regime", "confidence")


@query("regime_path_extra")
def _(d):
    reads = regime.regime_reads(d.onchain_features, "tvl", cols=(*FEATURES, *TVL))
    return reads.select("panel_id", "path_id", "date", "pos", hmm.refit_position(60, 5).alias("refit_pos"), "regime", "confidence")


@query("regime_paths")
def _(d):
    return d.trained_paths.select("panel_id", "path_id", "date", "pos", "regime", "confidence")


@query("trained_backtest")
def _(d):
    """The gated router on both trained paths beside the market, and how the labels differ."""
    configs = [weights.RouterConfig("gated", gated=True), weights.RouterConfig("gated_tvl", path_id="tvl", gated=True), weights.RouterConfig("market", fixed="equal_weight")]
    extra = flows.tvl_features(*d.tvl)
    out = workflows.strategy_comparison(d.prices, configs, extra_paths={"tvl": (extra, TVL)}, stables=STABLES)
    return out["metrics"]


@query("latest_read")
def _(d):
    reads = regime.latest_reads(d.features).join(d.gates.select("panel_id", "pos", "risk_off"), ["panel_id", "pos"])
    return reads.select("panel_id", "path_id", "date", "regime", "confidence", "risk_off", regime.stance(F.col("regime"), F.col("risk_off")).alias("stance"))


# --- strategies -------------------------------------------------------------


def _w(source):
    return pick(source, "panel_id date symbol", "", "w")


def _weights(df):
    return df.select("panel_id", "date", "symbol", "w")


@query("w_equal", _w("w_equal"))
def _(d):
    return _weights(weights.equal_weight(d.indexed))


@query("w_momentum", _w("w_mom"))
def _(d):
    return _weights(weights.momentum(d.indexed, 30, 3))


@query("w_mean_reversion", _w("w_rev"))
def _(d):
    return _weights(weights.mean_reversion(d.indexed))


@query("w_defensive", _w("w_def"))
def _(d):
    return _weights(weights.defensive(d.indexed, STABLES))


@query("w_volume_confirm", pick("vol_sig", "symbol date keep"))
def _(d):
    return weights.volume_signal(flows.select_series(d.side_series, "dexvol"))


@query("w_inflow_veto", pick("veto_sig", "symbol date veto"))
def _(d):
    return weights.inflow_signal(flows.select_series(d.side_series, "cexflow"))


@query("w_confirmed_momentum", _w("w_conf"))
def _(d):
    side = d.side_series
    base = materialize(weights.momentum(d.indexed, 30, 3))
    return _weights(weights.confirmed(base, flows.select_series(side, "dexvol"), flows.select_series(side, "cexflow")))


@query("active_strategies", pick("active", "panel_id config_id date gate active slot strategy", "pos"))
def _(d):
    return weights.active_strategies(d.calendar, d.path, d.gates, CONFIGS)


@query("w_router", pick("routed", "panel_id config_id symbol", "pos", "w"))
def _(d):
    return d.routed.select("panel_id", "config_id", "symbol", "pos", "w")


# --- portfolio --------------------------------------------------------------


@query("turnover_cost", sql("""SELECT panel_id, config_id, date, floor(1e6 * (turnover) + 0.5e0) / 1e6 AS turnover,
    floor(1e6 * (cost * 1e4) + 0.5e0) / 1e6 AS cost_bps FROM daily"""))
def _(d):
    return d.daily.select("panel_id", "config_id", "date", "turnover", (F.col("cost") * 1e4).alias("cost_bps"))


_RET = """SELECT panel_id, config_id, date, CAST(pos AS BIGINT) AS pos, floor(1e6 * (ret * 1e4) + 0.5e0) / 1e6 AS ret_bps FROM daily"""


def _returns(daily):
    return daily.select("panel_id", "config_id", "date", "pos", (F.col("ret") * 1e4).alias("ret_bps"))


@query("net_returns", sql(_RET))
def _(d):
    return _returns(d.daily)


@query("net_returns_joined", sql(f"{_RET} WHERE config_id = 'momentum'"))
def _(d):
    # The path for user-supplied weights that carry no forward return.
    prices = d.indexed
    own = weights.momentum(prices, 30, 3).withColumn("config_id", F.lit("momentum")).drop("strategy")
    days = portfolio.spine(d.calendar, ["momentum"])
    return _returns(portfolio.daily_accounting(portfolio.with_forward_returns(own, prices), days))


@query("equity_curve", sql("""SELECT panel_id, config_id, date, floor(1e6 * (ln(equity / 1e4)) + 0.5e0) / 1e6 AS log_equity,
    floor(1e6 * (drawdown) + 0.5e0) / 1e6 AS drawdown FROM daily"""))
def _(d):
    return d.daily.select("panel_id", "config_id", "date", F.log(F.col("equity") / 1e4).alias("log_equity"), "drawdown")


@query("trades", sql("""SELECT panel_id, config_id, date, floor(1e6 * (turnover) + 0.5e0) / 1e6 AS turnover,
    floor(1e6 * (cost * 1e4) + 0.5e0) / 1e6 AS cost_bps FROM daily WHERE turnover > 0"""))
def _(d):
    return portfolio.trades(d.daily).withColumn("cost_bps", F.col("cost") * 1e4).drop("cost")


_METRICS_SQL = """SELECT panel_id, config_id,
    floor(1e6 * (CASE WHEN stddev_samp(ret) >= 1e-12 THEN sqrt(365e0) * avg(ret) / stddev_samp(ret) ELSE 0e0 END) + 0.5e0) / 1e6 AS sharpe,
    floor(1e6 * (CASE WHEN stddev_samp(CASE WHEN ret < 0 THEN ret END) >= 1e-12 THEN sqrt(365e0) * avg(ret) / stddev_samp(CASE WHEN ret < 0 THEN ret END) ELSE 0e0 END) + 0.5e0) / 1e6 AS sortino,
    floor(1e6 * (min(drawdown)) + 0.5e0) / 1e6 AS max_drawdown, floor(1e6 * (count(CASE WHEN ret > 0 THEN 1 END) / CAST(count(ret) AS DOUBLE)) + 0.5e0) / 1e6 AS win_rate,
    floor(1e6 * (avg(turnover)) + 0.5e0) / 1e6 AS turnover, floor(1e6 * (arg_max(equity, pos) / arg_min(equity, pos) - 1) + 0.5e0) / 1e6 AS total_return
    FROM daily GROUP BY 1, 2"""


@query("metrics_bundle", sql(_METRICS_SQL))
def _(d):
    return portfolio.metrics(d.daily)


_PNL = """SELECT d.panel_id, d.config_id, coalesce(p.regime, 'unclassified') AS regime, count(*) AS days,
    product(1 + ret) - 1 AS total_return, avg(ret) AS mean_return
    FROM daily d LEFT JOIN path p ON p.panel_id = d.panel_id AND p.pos = d.pos
    AND p.path_id = CASE d.config_id WHEN 'gated_eager' THEN 'eager' ELSE 'baseline' END
    WHERE ret IS NOT NULL GROUP BY ALL"""


def _regime_pnl(d):
    return portfolio.regime_pnl(d.daily.withColumn("path_id", weights.config_path(CONFIGS)), d.panel_path)


@query("regime_pnl", sql("""SELECT panel_id, config_id, regime, days, floor(1e6 * (total_return) + 0.5e0) / 1e6 AS total_return,
    floor(1e6 * (mean_return) + 0.5e0) / 1e6 AS mean_return,
    floor(1e6 * (coalesce(total_return / nullif(sum(total_return) OVER (PARTITION BY panel_id, config_id), 0), 0)) + 0.5e0) / 1e6 AS share_of_pnl
    FROM pnl""", pnl=_PNL))
def _(d):
    return _regime_pnl(d)


# --- validation -------------------------------------------------------------


@query("windows_walk_forward", pick("wf", "panel_id role date", "window_id pos"))
def _(d):
    return windows.walk_forward_windows(d.calendar, 6, 5)


@query("windows_combinatorial", pick("cpcv", "panel_id role date", "window_id pos"))
def _(d):
    return windows.combinatorial_windows(d.calendar, 6, 2, 5)


_M = "total_return sharpe sortino max_drawdown"


def _wf(d):
    return windows.walk_forward_windows(d.calendar, 6, 5)


@query("window_metrics", pick("tests", "panel_id config_id test_start test_end", "window_id n_days", _M))
def _(d):
    return validation.evaluate_windows(d.stored_daily, _wf(d))


@query("train_scores", sql("""SELECT panel_id, config_id, CAST(window_id AS BIGINT) AS window_id, floor(1e6 * (sharpe) + 0.5e0) / 1e6 AS score
    FROM win_metrics WHERE role = 'train'"""))
def _(d):
    return validation.train_scores(d.daily, _wf(d))


@query("select_config", pick("selection", "panel_id chosen", "window_id n_days", _M))
def _(d):
    return validation.select_config(d.stored_daily, _wf(d), VARIANTS)


@query("oos_aggregate", sql(f"""SELECT panel_id, {', '.join(
    f"floor(1e6 * (avg({m})) + 0.5e0) / 1e6 AS {m}, floor(1e6 * (median({m})) + 0.5e0) / 1e6 AS {m}_median" for m in _M.split())},
    CAST(4 AS BIGINT) AS n_trials FROM selection GROUP BY 1"""))
def _(d):
    return validation.oos_aggregate(validation.select_config(d.stored_daily, _wf(d), VARIANTS), len(VARIANTS))


@query("per_config_oos", pick("oos", "panel_id config_id", "", "mean_sharpe mean_total_return mean_max_drawdown"))
def _(d):
    return validation.per_config_oos(validation.evaluate_windows(d.stored_daily, _wf(d)))


@query("modal_variant", sql("""SELECT panel_id, coalesce(chosen, 'gated') AS selected FROM
    (SELECT DISTINCT panel_id FROM cal) LEFT JOIN (
      SELECT * FROM (SELECT panel_id, chosen, row_number() OVER (PARTITION BY panel_id ORDER BY count(*) DESC, chosen) AS rk
      FROM selection GROUP BY 1, 2) WHERE rk = 1) USING (panel_id)"""))
def _(d):
    return validation.modal_variant(validation.select_config(d.stored_daily, _wf(d), VARIANTS), d.stored_daily, VARIANTS[0])


@query("return_moments", pick("moments", "panel_id config_id", "n_obs", "sr skew kurt"))
def _(d):
    return validation.return_moments(d.daily).drop("sd")


@query("sr_variance", pick("srvar", "panel_id", "n_trials", "sr_var"))
def _(d):
    return validation.sr_variance(validation.return_moments(d.daily.filter(F.col("config_id").isin(VARIANTS))))


# Quantiles of the unit normal at 1 - 1/4 and 1 - 1/(4e), for four trials.
_Q1, _Q2 = 0.6744897501960817, 1.3287219496247633


_DSR = f"""SELECT panel_id, config_id, n_obs, n_trials, sr_var, benchmark,
    CASE WHEN n_obs >= 2 AND sd >= 1e-12 AND spread > 0 THEN greatest(0e0, least(1e0, 0.5e0 + exp(-z * z / 2) / sqrt(2 * pi()) * series)) ELSE 0e0 END AS dsr
    FROM (SELECT *, (SELECT sum(sign(z) * exp((2 * k + 1) * ln(abs(z)) - (k + 1) * ln(2e0) - lgamma(k + 1.5e0) + 0.5e0 * ln(pi()))) FROM range(0, 400) AS r(k)) AS series
      FROM (SELECT *, (sr - benchmark) * sqrt(n_obs - 1) / sqrt(CASE WHEN spread > 0 THEN spread END) AS z
        FROM (SELECT m.*, v.n_trials, v.sr_var, 1 - m.skew * m.sr + (m.kurt - 1) / 4 * m.sr * m.sr AS spread,
              sqrt(v.sr_var) * ((1 - 0.5772156649e0) * {_Q1}e0 + 0.5772156649e0 * {_Q2}e0) AS benchmark
              FROM moments m JOIN srvar v ON v.panel_id = m.panel_id
              WHERE m.config_id IN ('gated', 'confirm2', 'confirm3', 'ungated'))))"""


@query("deflated_sharpe", sql("""SELECT panel_id, config_id, n_obs, n_trials, floor(1e6 * (benchmark) + 0.5e0) / 1e6 AS benchmark,
    floor(1e6 * (dsr) + 0.5e0) / 1e6 AS dsr FROM deflated""", deflated=_DSR))
def _(d):
    return validation.deflated_sharpe(d.stored_daily, VARIANTS).select("panel_id", "config_id", "n_obs", "n_trials", "benchmark", "dsr")


_BOOT = 1000
_STEPS = f"""SELECT panel_id, config_id, b, j, n,
    (CAST('0x' || substr(md5('0|' || b || '|' || (j // 10)), 1, 8) AS BIGINT) % n + j % 10) % n AS i
    FROM (SELECT *, unnest(range(n)) AS j FROM (SELECT panel_id, config_id, max(n) AS n FROM obs GROUP BY 1, 2)),
    range({_BOOT}) AS rb(b)"""
_PATHS_SQL = """SELECT s.panel_id, s.config_id, s.b, s.j, s.n, o.ret FROM steps s
    JOIN obs o ON o.panel_id = s.panel_id AND o.config_id = s.config_id AND o.i = s.i"""
_BOOT_SQL = """SELECT panel_id, config_id, b,
    CASE WHEN stddev_samp(ret) > 1e-12 THEN sqrt(365e0) * avg(ret) / stddev_samp(ret) ELSE 0e0 END AS sharpe,
    product(1 + ret) - 1 AS total_return FROM boot_paths GROUP BY 1, 2, 3"""


# Every path of every configuration; a path's returns and their order show in two means.
@query("bootstrap_paths", sql("""SELECT panel_id, config_id, b, count(*) AS n, floor(1e6 * (avg(ret)) + 0.5e0) / 1e6 AS mean,
    floor(1e6 * (avg(ret * (j + 1) / n)) + 0.5e0) / 1e6 AS ordered_mean FROM boot_paths GROUP BY 1, 2, 3""", steps=_STEPS, boot_paths=_PATHS_SQL))
def _(d):
    paths = bootstrap.bootstrap_paths(d.stored_daily, _BOOT)
    length = paths.groupBy("panel_id", "config_id", "b")
    step = F.sum(F.col("ret") * (F.col("j") + 1)) / F.count("*") / F.count("*")
    return length.agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), step.alias("ordered_mean"))


@query("bootstrap_metrics", sql("""SELECT panel_id, config_id, b, floor(1e6 * (sharpe) + 0.5e0) / 1e6 AS sharpe,
    floor(1e6 * (total_return) + 0.5e0) / 1e6 AS total_return FROM boot""", steps=_STEPS, boot_paths=_PATHS_SQL, boot=_BOOT_SQL))
def _(d):
    return bootstrap.bootstrap_metrics(d.stored_daily, _BOOT).select("panel_id", "config_id", "b", "sharpe", "total_return")


@query("bootstrap_custom_metric", sql("""SELECT panel_id, config_id, b, floor(1e6 * (sum(abs(ret))) + 0.5e0) / 1e6 AS metric FROM boot_paths
    GROUP BY 1, 2, 3""", steps=_STEPS, boot_paths=_PATHS_SQL))
def _(d):
    return bootstrap.path_metric(bootstrap.bootstrap_paths(d.stored_daily, _BOOT), F.sum(F.abs("ret")))


@query("bootstrap_ci", sql("""SELECT panel_id, config_id, p.sharpe, p.total_return, floor(1e6 * (quantile_cont(b.sharpe, 0.05)) + 0.5e0) / 1e6 AS sharpe_lo,
    floor(1e6 * (quantile_cont(b.sharpe, 0.95)) + 0.5e0) / 1e6 AS sharpe_hi, floor(1e6 * (quantile_cont(b.total_return, 0.05)) + 0.5e0) / 1e6 AS total_return_lo,
    floor(1e6 * (quantile_cont(b.total_return, 0.95)) + 0.5e0) / 1e6 AS total_return_hi
    FROM boot b JOIN (SELECT panel_id, config_id,
      floor(1e6 * (CASE WHEN stddev_samp(ret) > 1e-12 THEN sqrt(365e0) * avg(ret) / stddev_samp(ret) ELSE 0e0 END) + 0.5e0) / 1e6 AS sharpe,
      floor(1e6 * (product(1 + ret) - 1) + 0.5e0) / 1e6 AS total_return FROM obs GROUP BY 1, 2) p USING (panel_id, config_id)
    GROUP BY 1, 2, 3, 4""", steps=_STEPS, boot_paths=_PATHS_SQL, boot=_BOOT_SQL))
def _(d):
    return bootstrap.bootstrap_ci(d.stored_daily, _BOOT)


_BOOT_DD = """SELECT panel_id, config_id, b, min(dd) AS max_drawdown,
    coalesce(CASE WHEN stddev_samp(CASE WHEN ret < 0 THEN ret END) >= 1e-12 THEN sqrt(365e0) * avg(ret) / stddev_samp(CASE WHEN ret < 0 THEN ret END) END, 0e0) AS sortino
    FROM (SELECT *, eq / max(eq) OVER w - 1 AS dd FROM (SELECT *, product(1 + ret) OVER w AS eq FROM boot_paths
        WINDOW w AS (PARTITION BY panel_id, config_id, b ORDER BY j)) WINDOW w AS (PARTITION BY panel_id, config_id, b ORDER BY j)) GROUP BY 1, 2, 3"""


# Metrics that depend on the order of a path: its blocks' states are merged in order.
@query("bootstrap_drawdown_ci", sql("SELECT panel_id, config_id, " + ", ".join(
    f"floor(1e6 * (quantile_cont({m}, {q})) + 0.5e0) / 1e6 AS {m}_{side}" for m in ("max_drawdown", "sortino") for side, q in (("lo", 0.05), ("hi", 0.95)))
    + " FROM boot_dd GROUP BY 1, 2", steps=_STEPS, boot_paths=_PATHS_SQL, boot_dd=_BOOT_DD))
def _(d):
    out = bootstrap.bootstrap_ci(d.stored_daily, _BOOT, metrics=("max_drawdown", "sortino"))
    return out.select("panel_id", "config_id", "max_drawdown_lo", "max_drawdown_hi", "sortino_lo", "sortino_hi")


@query("oos_selected", sql("""SELECT s.panel_id, s.selected, o.n_obs, floor(1e6 * (o.sr) + 0.5e0) / 1e6 AS sr,
    floor(1e6 * (b.lo) + 0.5e0) / 1e6 AS sharpe_lo, floor(1e6 * (b.hi) + 0.5e0) / 1e6 AS sharpe_hi
    FROM (SELECT panel_id, chosen AS selected FROM (SELECT panel_id, chosen,
            row_number() OVER (PARTITION BY panel_id ORDER BY count(*) DESC, chosen) AS rk FROM selection GROUP BY 1, 2) WHERE rk = 1) s
    JOIN moments o ON o.panel_id = s.panel_id AND o.config_id = s.selected
    JOIN (SELECT panel_id, config_id, quantile_cont(sharpe, 0.05) AS lo, quantile_cont(sharpe, 0.95) AS hi FROM boot GROUP BY 1, 2) b
    ON b.panel_id = s.panel_id AND b.config_id = s.selected""", steps=_STEPS, boot_paths=_PATHS_SQL, boot=_BOOT_SQL))
def _(d):
    report = workflows.out_of_sample(d.stored_daily, d.calendar, VARIANTS, n_boot=_BOOT)
    dsr = report["deflated_sharpe"].withColumnRenamed("config_id", "selected")
    ci = report["intervals"].withColumnRenamed("config_id", "selected")
    joined = dsr.join(ci, ["panel_id", "selected"])
    return joined.select("panel_id", "selected", "n_obs", "sr", "sharpe_lo", "sharpe_hi")


# --- one wide panel: a name per part ----------------------------------------


@query("scale_market", sql("""SELECT date, floor(1e6 * (avg(ret)) + 0.5e0) / 1e6 AS market_return,
    floor(1e6 * (count(CASE WHEN cum > 0 THEN 1 END) / nullif(CAST(count(cum) AS DOUBLE), 0)) + 0.5e0) / 1e6 AS breadth,
    floor(1e6 * (stddev_pop(cum)) + 0.5e0) / 1e6 AS dispersion FROM part_rets GROUP BY date"""))
def _(d):
    return feat.market_daily(d.part_indexed).drop("panel_id", "pos", "index_value")


@query("scale_backtest", sql("""SELECT config_id, date, CASE WHEN pos > 0 THEN floor(1e6 * (turnover) + 0.5e0) / 1e6 END AS turnover,
    CASE WHEN pos > 0 THEN floor(1e6 * ((gross - turnover * 15e0 / 1e4) * 1e4) + 0.5e0) / 1e6 END AS ret_bps FROM part_acct"""))
def _(d):
    p = materialize(feat.enriched(d.part_indexed, (30,)))
    held = weights.momentum(p).unionByName(weights.equal_weight(p)).withColumnRenamed("strategy", "config_id")
    days = p.groupBy("panel_id", "pos", "date").agg(F.count("*").alias("n"))
    daily = portfolio.daily_accounting(held, portfolio.spine(days, ["momentum", "equal_weight"]))
    return daily.select("config_id", "date", "turnover", (F.col("ret") * 1e4).alias("ret_bps"))


# --- change points ----------------------------------------------------------


_RUNS = """SELECT panel_id || '/' || symbol AS series_id, pos, ret AS x,
    row_number() OVER (PARTITION BY panel_id, symbol ORDER BY pos) AS t FROM rets WHERE ret IS NOT NULL"""
# One row per series, step and run length; the prior row restarts at every step.
_BOCPD = """WITH RECURSIVE runs(series_id, t, run, mass, mu, beta) AS (
    SELECT DISTINCT series_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 1e0, 0e0, 1e0 FROM obs_x
    UNION ALL
    SELECT series_id, t + 1, CASE k WHEN 0 THEN 0 ELSE run + 1 END,
        CASE WHEN total > 0 THEN CASE k WHEN 0 THEN 0.01e0 ELSE 0.99e0 * weighted / total END ELSE CASE k WHEN 0 THEN 1e0 ELSE 0e0 END END,
        CASE k WHEN 0 THEN 0e0 ELSE ((1 + run) * mu + x) / (2 + run) END,
        CASE k WHEN 0 THEN 1e0 ELSE beta + (1 + run) * (x - mu) * (x - mu) / (2 * (2 + run)) END
    FROM (SELECT *, sum(weighted) OVER (PARTITION BY series_id) AS total FROM (
        SELECT *, mass * exp(lgamma(a + 0.5e0) - lgamma(a) - 0.5e0 * ln(2 * pi() * a * s2)
            - (a + 0.5e0) * ln(1 + (x - mu) * (x - mu) / (2 * a * s2))) AS weighted FROM (
        SELECT r.*, o.x, 1 + run / 2e0 AS a, beta * (run + 2) / ((1 + run / 2e0) * (run + 1)) AS s2
        FROM runs r JOIN obs_x o ON o.series_id = r.series_id AND o.t = r.t + 1))), (VALUES (0), (1)) AS v(k)
    WHERE k = 1 OR run = 0)
    SELECT r.series_id, CAST(o.pos AS BIGINT) AS pos, floor(1e6 * (sum(r.mass)) + 0.5e0) / 1e6 AS cp_prob
    FROM runs r JOIN obs_x o ON o.series_id = r.series_id AND o.t = r.t WHERE r.run <= 1 GROUP BY 1, 2"""


_BOCPD_SQL = sql("SELECT * FROM obs_x", obs_x=_RUNS).replace("WITH ", "WITH RECURSIVE ", 1).replace(
    " SELECT * FROM obs_x", _BOCPD.replace("WITH RECURSIVE", ",", 1))


def _return_series(d):
    returns = feat.simple_returns(d.indexed).filter(F.col("ret").isNotNull())
    return returns.select(F.concat_ws("/", "panel_id", "symbol").alias("series_id"), "pos", F.col("ret").alias("x"))


@query("bocpd", _BOCPD_SQL)
def _(d):
    return changepoint.change_points(_return_series(d))


# The same series, carried over stretches of 128 dates through the state table.
@query("bocpd_chunked", _BOCPD_SQL)
def _(d):
    return changepoint.change_points_chunked(materialize(_return_series(d)), 128)


# --- rebalancing and reports ------------------------------------------------


def _books(d):
    """Per panel: momentum book into the equal-weight book on the last decision date."""
    p = d.indexed
    last = F.col("pos") == F.col("n_dates") - 1
    now = weights.mean_reversion(p).join(p.select("panel_id", "n_dates").distinct(), "panel_id").filter(last)
    return now, weights.equal_weight(p.filter(last))


_DIFF = """SELECT panel_id, symbol, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS action,
    round(abs(delta) * 10000, 2) AS usd_amount, round(delta, 6) AS fraction
    FROM (SELECT coalesce(c.panel_id, t.panel_id) AS panel_id, coalesce(c.symbol, t.symbol) AS symbol,
          coalesce(t.w, 0) - coalesce(c.w, 0) AS delta
          FROM (SELECT w_rev.* FROM w_rev JOIN last_day USING (panel_id, pos)) c
          FULL JOIN (SELECT w_equal.* FROM w_equal JOIN last_day USING (panel_id, pos)) t
          ON c.panel_id = t.panel_id AND c.symbol = t.symbol)
    WHERE abs(delta) * 10000 >= 10"""
_LAST = "SELECT panel_id, max(pos) AS pos FROM cal GROUP BY 1"


@query("intents", sql("""SELECT panel_id, row_number() OVER (PARTITION BY panel_id ORDER BY CASE action WHEN 'sell' THEN 0 ELSE 1 END, usd_amount DESC, symbol) AS seq,
    symbol, action, floor(1e6 * (usd_amount) + 0.5e0) / 1e6 AS usd_amount, floor(1e6 * (fraction) + 0.5e0) / 1e6 AS fraction FROM diff""", diff=_DIFF, last_day=_LAST))
def _(d):
    now, target = _books(d)
    return rebalance.weights_to_intents(now, target, ["panel_id"], 10_000.0)


def _last_reads(d):
    reads = d.path.filter("path_id = 'baseline'").join(d.gates.select("panel_id", "pos", "risk_off"), ["panel_id", "pos"])
    last = d.calendar.filter("pos = n_dates - 1").select("panel_id", "pos")
    return reads.join(last, ["panel_id", "pos"]).select("panel_id", "date", "regime", F.lit(0.5).alias("confidence"), "risk_off")


@query("execution_plan", sql("""SELECT r.panel_id, r.date, r.regime, 0.5e0 AS confidence, r.risk_off, r.stance, r.hold,
    CASE WHEN r.risk_off THEN 'no trades: the risk-off gate is on'
         WHEN r.hold THEN 'no trades: volatility is high'
         WHEN coalesce(s, 0) + coalesce(b, 0) = 0 THEN r.stance || ': on target, no trade reaches 10'
         ELSE r.stance || ': sells ' || coalesce(s, 0) || ', buys ' || coalesce(b, 0) END AS note,
    CASE WHEN r.hold THEN 0 ELSE coalesce(s, 0) END AS n_sell, CASE WHEN r.hold THEN 0 ELSE coalesce(b, 0) END AS n_buy
    FROM (SELECT p.panel_id, p.date, p.regime, k.risk_off, k.risk_off OR p.regime = 'high_volatility' AS hold,
            CASE WHEN k.risk_off OR p.regime = 'high_volatility' THEN 'defensive' WHEN p.regime = 'trending' THEN 'momentum' ELSE 'market portfolio' END AS stance
          FROM path p JOIN risk k ON k.panel_id = p.panel_id AND k.pos = p.pos
          JOIN last_day z ON z.panel_id = p.panel_id AND z.pos = p.pos WHERE p.path_id = 'baseline') r
    LEFT JOIN (SELECT panel_id, count(CASE action WHEN 'sell' THEN 1 END) AS s, count(CASE action WHEN 'buy' THEN 1 END) AS b FROM diff GROUP BY 1) x
    ON x.panel_id = r.panel_id""", diff=_DIFF, last_day=_LAST))
def _(d):
    now, target = _books(d)
    return rebalance.execution_plan(_last_reads(d), now, target, ["panel_id"], 10_000.0)


@query("plan_intents", sql("""SELECT panel_id, row_number() OVER (PARTITION BY panel_id ORDER BY CASE action WHEN 'sell' THEN 0 ELSE 1 END, usd_amount DESC, symbol) AS seq,
    symbol, action, floor(1e6 * (usd_amount) + 0.5e0) / 1e6 AS usd_amount, floor(1e6 * (fraction) + 0.5e0) / 1e6 AS fraction FROM diff
    WHERE panel_id IN (SELECT p.panel_id FROM path p JOIN risk k ON k.panel_id = p.panel_id AND k.pos = p.pos
      JOIN last_day z ON z.panel_id = p.panel_id AND z.pos = p.pos
      WHERE p.path_id = 'baseline' AND NOT k.risk_off AND p.regime <> 'high_volatility')""", diff=_DIFF, last_day=_LAST))
def _(d):
    now, target = _books(d)
    plan = rebalance.execution_plan(_last_reads(d), now, target, ["panel_id"], 10_000.0)
    return rebalance.plan_intents(plan, rebalance.weights_to_intents(now, target, ["panel_id"], 10_000.0), ["panel_id"])


@query("equity_pivot", sql(f"""SELECT d.panel_id, d.date, b.regime AS baseline_regime, e.regime AS eager_regime, {', '.join(
    f"floor(1e6 * (ln(max(CASE WHEN config_id = '{c}' THEN equity END) / 1e4)) + 0.5e0) / 1e6 AS {c}" for c in CONFIG_IDS)}
    FROM daily d LEFT JOIN path b ON b.panel_id = d.panel_id AND b.date = d.date AND b.path_id = 'baseline'
    LEFT JOIN path e ON e.panel_id = d.panel_id AND e.date = d.date AND e.path_id = 'eager' GROUP BY 1, 2, 3, 4"""))
def _(d):
    table = report.equity_table(d.daily, d.panel_path, CONFIG_IDS, list(PATHS))
    return table.select("panel_id", "date", "baseline_regime", "eager_regime", *[F.log(F.col(c) / 1e4).alias(c) for c in CONFIG_IDS])


@query("rebased_returns", sql("""SELECT panel_id, config_id, date, floor(1e6 * ((equity / 1e4 - 1) * 100) + 0.5e0) / 1e6 AS pct_return FROM daily"""))
def _(d):
    return report.rebased(d.daily)


@query("cash_share", sql("""SELECT panel_id, config_id, count(CASE WHEN step < 1e-6 THEN 1 END) AS flat_days,
    floor(1e6 * (count(CASE WHEN step < 1e-6 THEN 1 END) / nullif(count(*) - 1e0, 0)) + 0.5e0) / 1e6 AS cash_share
    FROM (SELECT *, abs(equity - lag(equity) OVER (PARTITION BY panel_id, config_id ORDER BY date)) AS step FROM daily) GROUP BY 1, 2"""))
def _(d):
    return report.cash_share(d.daily)


@query("regime_day_share", sql("""SELECT panel_id, config_id, regime, days,
    floor(1e6 * (days / CAST(sum(days) OVER (PARTITION BY panel_id, config_id) AS DOUBLE)) + 0.5e0) / 1e6 AS day_share FROM pnl""", pnl=_PNL))
def _(d):
    return report.regime_day_share(_regime_pnl(d))


@query("dd_breach", sql("""SELECT o.panel_id, o.config_id, floor(1e6 * (abs(o.mean_max_drawdown)) + 0.5e0) / 1e6 AS drawdown,
    abs(o.mean_max_drawdown) > 0.3e0 AS breaches, floor(1e6 * (m.mean_max_drawdown / nullif(o.mean_max_drawdown, 0)) + 0.5e0) / 1e6 AS drawdown_ratio,
    floor(1e6 * (o.mean_sharpe - m.mean_sharpe) + 0.5e0) / 1e6 AS sharpe_edge
    FROM oos o LEFT JOIN oos m ON m.panel_id = o.panel_id AND m.config_id = 'equal_weight'"""))
def _(d):
    return report.drawdown_breaches(validation.per_config_oos(validation.evaluate_windows(d.stored_daily, _wf(d))))


@query("read_json_export", sql(f"""SELECT b.panel_id, b.date, b.regime, floor(1e6 * (b.prob) + 0.5e0) / 1e6 AS confidence, r.risk_off,
    CASE WHEN r.risk_off OR b.regime = 'high_volatility' THEN 'defensive' WHEN b.regime = 'trending' THEN 'momentum' ELSE 'market portfolio' END AS stance,
    {', '.join(f"floor(1e6 * (b.{c}) + 0.5e0) / 1e6 AS {c}" for c in FEATURES)}, 'read,service,version' AS top_keys,
    'attribution,confidence,date,features,posterior,recommended_stance,regime,risk_off' AS read_keys
    FROM best b JOIN risk r ON r.panel_id = b.panel_id AND r.pos = b.pos"""))
def _(d):
    reads = d.reads.join(d.gates.select("panel_id", "pos", "risk_off"), ["panel_id", "pos"])
    docs = export.read_documents(reads, "regime-reader")
    schema = ("STRUCT<read: STRUCT<confidence: DOUBLE, date: DATE, features: MAP<STRING, DOUBLE>, "
              "recommended_stance: STRING, regime: STRING, risk_off: BOOLEAN>>")
    parsed = docs.withColumn("r", F.from_json("document", schema)["read"])
    return parsed.select(
        "panel_id", "r.date", "r.regime", "r.confidence", "r.risk_off", F.col("r.recommended_stance").alias("stance"),
        *[F.col("r.features")[c].alias(c) for c in FEATURES],
        F.array_join(F.json_object_keys("document"), ",").alias("top_keys"),
        F.array_join(F.json_object_keys(F.get_json_object("document", "$.read")), ",").alias("read_keys"),
    )


@query("read_flat_export", sql("""SELECT b.panel_id, b.date, b.regime, floor(1e6 * (b.prob) + 0.5e0) / 1e6 AS confidence, r.risk_off,
    floor(1e6 * (b.realized_vol) + 0.5e0) / 1e6 AS realized_vol,
    'attribution,confidence,date,features,posterior,recommended_stance,regime,risk_off' AS keys
    FROM best b JOIN risk r ON r.panel_id = b.panel_id AND r.pos = b.pos"""))
def _(d):
    reads = d.reads.join(d.gates.select("panel_id", "pos", "risk_off"), ["panel_id", "pos"])
    docs = export.flat_reads(reads)
    schema = "STRUCT<confidence: DOUBLE, date: DATE, features: MAP<STRING, DOUBLE>, regime: STRING, risk_off: BOOLEAN>"
    parsed = docs.withColumn("r", F.from_json("document", schema))
    return parsed.select(
        "panel_id", "r.date", "r.regime", "r.confidence", "r.risk_off", F.col("r.features")["realized_vol"].alias("realized_vol"),
        F.array_join(F.json_object_keys("document"), ",").alias("keys"),
    )


@query("result_json_export", sql("""SELECT panel_id, config_id, count(*) AS n_days, count(ret) AS n_returns,
    min(date) AS first_date, floor(1e6 * (ln(arg_max(equity, pos) / 1e4)) + 0.5e0) / 1e6 AS last_log_equity,
    floor(1e6 * (avg(turnover)) + 0.5e0) / 1e6 AS turnover FROM daily GROUP BY 1, 2"""))
def _(d):
    meta = d.panel.groupBy("panel_id").agg(
        F.count_distinct("symbol").alias("n_assets"), F.lit(10.0).alias("fee_bps"), F.lit(5.0).alias("slippage_bps")
    )
    docs = export.result_documents(d.stored_daily, portfolio.metrics(d.stored_daily), meta)
    curve = "ARRAY<STRUCT<date: DATE, value: DOUBLE>>"
    doc = F.from_json("document", f"STRUCT<metrics: MAP<STRING, DOUBLE>, equity: {curve}, returns: {curve}>")
    parsed = docs.withColumn("x", doc)
    return parsed.select(
        "panel_id", "config_id", F.size("x.equity").alias("n_days"),
        F.size(F.filter("x.returns", lambda r: r["value"].isNotNull())).alias("n_returns"),
        F.get("x.equity", F.lit(0))["date"].alias("first_date"),
        F.log(F.element_at("x.equity", -1)["value"] / 1e4).alias("last_log_equity"),
        F.col("x.metrics")["turnover"].alias("turnover"),
    )


@query("selection_json_export", pick("selection", "panel_id chosen", "window_id n_days", _M))
def _(d):
    chosen = validation.select_config(d.stored_daily, _wf(d), VARIANTS)
    docs = export.table_document(chosen, ["panel_id"], ["window_id"], "per_window")
    row = f"STRUCT<window_id: INT, chosen: STRING, n_days: BIGINT, {', '.join(f'{m}: DOUBLE' for m in _M.split())}>"
    parsed = F.from_json("document", f"STRUCT<per_window: ARRAY<{row}>>")["per_window"]
    return docs.select("panel_id", F.inline(parsed))


@query("weight_lines_export", pick("routed", "panel_id config_id symbol", "", "w"))
def _(d):
    cal = d.calendar.select("panel_id", "pos", "date")
    lines = export.weight_lines(d.routed.drop("date").join(cal, ["panel_id", "pos"]))
    doc = F.from_json("document", "STRUCT<panel_id: STRING, config_id: STRING, symbol: STRING, weight: DOUBLE>")
    return lines.select(doc.alias("x")).select("x.panel_id", "x.config_id", "x.symbol", F.col("x.weight").alias("w"))


# --- combined documents, parsed back into rows (section, name, label, n, value) ------------------

_ROUND = "floor(1e6 * ({0}) + 0.5e0) / 1e6"


def _section(section, name, source, label="CAST(NULL AS VARCHAR)", n="CAST(NULL AS BIGINT)", value=None):
    value = _ROUND.format(value) if value else "CAST(NULL AS DOUBLE)"
    return f"SELECT panel_id, '{section}' AS section, {name} AS name, {label} AS label, CAST({n} AS BIGINT) AS n, {value} AS value FROM {source}"


def _rows(parsed, *sections):
    """Long rows of a parsed document; a section is (name, array of (name, label, n, value))."""

    def tagged(section, items):
        return F.transform(items, lambda x: F.struct(F.lit(section).alias("section"), x["name"].alias("name"), x["label"].alias("label"), x["n"].alias("n"), x["value"].alias("value")))

    return parsed.select("panel_id", F.inline(F.concat(*[tagged(*s) for s in sections])))


def _item(name, label=None, n=None, value=None):
    empty = F.lit(None)
    return F.struct(
        name.cast("string").alias("name"), (empty if label is None else label).cast("string").alias("label"),
        (empty if n is None else n).cast("bigint").alias("n"), (empty if value is None else value).cast("double").alias("value"),
    )


def _each(section, items, names, make):
    """A section per name: ``make(item, name)`` of all items."""

    def of(name):
        return F.transform(items, lambda item: make(item, name))

    return [(section, of(name)) for name in names]


def _dotted(entry, field):
    return F.concat(entry["key"], F.lit(f".{field}"))


_BUNDLE = "sharpe sortino max_drawdown win_rate turnover total_return".split()
_ARTIFACT_SQL = [
    _section("path", "strftime(date, '%Y-%m-%d')", "path WHERE path_id = 'baseline'", label="regime"),
    *[_section("attribution", f"regime || '.{c}'", "shares WHERE config_id = 'gated'", n="days", value=c) for c in ("total_return", "mean_return", "share_of_pnl")],
    *[_section("metrics", f"config_id || '.{c}'", "bundle", value=c) for c in _BUNDLE],
    _section("equity", "config_id || '.' || strftime(date, '%Y-%m-%d')", "daily", value="ln(equity / 1e4)"),
]


@query("regime_artifact_export", sql(" UNION ALL ".join(_ARTIFACT_SQL), pnl=_PNL, bundle=_METRICS_SQL,
    shares="SELECT *, coalesce(total_return / nullif(sum(total_return) OVER (PARTITION BY panel_id, config_id), 0), 0) AS share_of_pnl FROM pnl"))
def _(d):
    pnl = portfolio.regime_pnl(d.stored_daily.filter("config_id = 'gated'"), d.panel_path.filter("path_id = 'baseline'"))
    path = d.panel_path.filter("path_id = 'baseline'")
    docs = export.regime_artifact(path, pnl, portfolio.metrics(d.stored_daily), d.stored_daily)
    schema = ("STRUCT<regime_path: ARRAY<STRUCT<date: STRING, regime: STRING>>, "
              "regime_attribution: MAP<STRING, STRUCT<days: BIGINT, total_return: DOUBLE, mean_return: DOUBLE, share_of_pnl: DOUBLE>>, "
              f"strategies: MAP<STRING, STRUCT<metrics: STRUCT<{', '.join(f'{m}: DOUBLE' for m in _BUNDLE)}>, equity: ARRAY<STRUCT<date: STRING, value: DOUBLE>>>>>")
    x = F.from_json("document", schema)
    parsed = docs.select("panel_id", x.alias("x"))
    shares, books = F.map_entries("x.regime_attribution"), F.map_entries("x.strategies")
    equity = F.flatten(F.transform(books, lambda b: F.transform(b["value"]["equity"], lambda e: _item(F.concat(b["key"], F.lit("."), e["date"]), value=F.log(e["value"] / 1e4)))))
    return _rows(
        parsed,
        ("path", F.transform("x.regime_path", lambda r: _item(r["date"], r["regime"]))),
        *_each("attribution", shares, ("total_return", "mean_return", "share_of_pnl"), lambda e, c: _item(_dotted(e, c), n=e["value"]["days"], value=e["value"][c])),
        *_each("metrics", books, _BUNDLE, lambda b, c: _item(_dotted(b, c), value=b["value"]["metrics"][c])),
        ("equity", equity),
    )


_OOS = [m + s for m in _M.split() for s in ("", "_median")]
_MEANS = "mean_sharpe mean_total_return mean_max_drawdown".split()
_MODAL = """SELECT panel_id, chosen AS config_id FROM (SELECT panel_id, chosen, row_number() OVER (PARTITION BY panel_id ORDER BY count(*) DESC, chosen) AS rk
    FROM selection GROUP BY 1, 2) WHERE rk = 1"""
_POINT = """SELECT panel_id, config_id, CASE WHEN stddev_samp(ret) > 1e-12 THEN sqrt(365e0) * avg(ret) / stddev_samp(ret) ELSE 0e0 END AS sharpe,
    product(1 + ret) - 1 AS total_return FROM obs JOIN modal USING (panel_id, config_id) GROUP BY 1, 2"""
_RANGE = """SELECT panel_id, quantile_cont(sharpe, 0.05) AS sharpe_lo, quantile_cont(sharpe, 0.95) AS sharpe_hi,
    quantile_cont(total_return, 0.05) AS total_return_lo, quantile_cont(total_return, 0.95) AS total_return_hi
    FROM boot JOIN modal USING (panel_id, config_id) GROUP BY 1"""
_REPORT_SQL = [
    _section("days", "'days'", "(SELECT panel_id, count(DISTINCT date) AS d FROM prices GROUP BY 1)", n="d"),
    _section("symbol", "symbol", "(SELECT panel_id, symbol, row_number() OVER (PARTITION BY panel_id ORDER BY min(ord)) - 1 AS k FROM prices GROUP BY 1, 2)", n="k"),
    _section("count", "path_id || '.' || regime", "(SELECT panel_id, path_id, regime, count(*) AS d FROM path GROUP BY 1, 2, 3)", n="d"),
    *[_section("window", f"window_id || '.{m}'", "selection", label="chosen", n="n_days", value=m) for m in _M.split()],
    *[_section("oos", f"'{c}'", f"(SELECT panel_id, {'median' if c.endswith('_median') else 'avg'}({c.removesuffix('_median')}) AS v FROM selection GROUP BY 1)", n="4", value="v") for c in _OOS],
    _section("selected", "'selected'", "modal", label="config_id"),
    *[_section("per_config", f"config_id || '.{c}'", "oos", value=c) for c in _MEANS],
    *[_section("dsr", f"'{c}'", "(SELECT d.* FROM deflated d JOIN modal m ON m.panel_id = d.panel_id AND m.config_id = d.config_id)", n="n_trials", value=c) for c in ("dsr", "sr_var")],
    *[_section("bootstrap", f"'{m}.point'", "point", value=m) for m in ("sharpe", "total_return")],
    *[_section("bootstrap", f"'{m}.{side}'", "range_", value=f"{m}_{side}") for m in ("sharpe", "total_return") for side in ("lo", "hi")],
]


@query("validation_artifact_export", sql(" UNION ALL ".join(_REPORT_SQL), deflated=_DSR, modal=_MODAL, point=_POINT, range_=_RANGE,
    steps=_STEPS, boot_paths=_PATHS_SQL, boot=_BOOT_SQL))
def _(d):
    report = workflows.out_of_sample(d.stored_daily, d.calendar, VARIANTS, n_boot=_BOOT)
    docs = export.validation_artifact(d.prices, regime.label_counts(d.panel_path), report)
    doubles = lambda names: ", ".join(f"{c}: DOUBLE" for c in names)
    point = "STRUCT<point: DOUBLE, lo: DOUBLE, hi: DOUBLE>"
    schema = (f"STRUCT<panel: STRUCT<days: BIGINT, symbols: ARRAY<STRING>>, regime_value_counts: MAP<STRING, MAP<STRING, BIGINT>>, "
              f"selection: STRUCT<per_window: ARRAY<STRUCT<window_id: BIGINT, chosen: STRING, n_days: BIGINT, {doubles(_M.split())}>>, "
              f"oos: STRUCT<{doubles(_OOS)}>, n_trials: BIGINT, selected_variant: STRING>, per_config_oos: MAP<STRING, STRUCT<{doubles(_MEANS)}>>, "
              f"deflated_sharpe: STRUCT<value: DOUBLE, n_trials: BIGINT, sr_variance: DOUBLE>, bootstrap: STRUCT<sharpe: {point}, total_return: {point}>>")
    parsed = docs.select("panel_id", F.from_json("document", schema).alias("x")).select("panel_id", "x.*")
    paths, books = F.map_entries("regime_value_counts"), F.map_entries("per_config_oos")
    one = lambda item: F.array(item)
    return _rows(
        parsed,
        ("days", one(_item(F.lit("days"), n=F.col("panel.days")))),
        ("symbol", F.transform("panel.symbols", lambda s, k: _item(s, n=k))),
        ("count", F.flatten(F.transform(paths, lambda p: F.transform(F.map_entries(p["value"]), lambda r: _item(F.concat(p["key"], F.lit("."), r["key"]), n=r["value"]))))),
        *_each("window", "selection.per_window", _M.split(), lambda w, m: _item(F.concat(w["window_id"].cast("string"), F.lit(f".{m}")), w["chosen"], w["n_days"], w[m])),
        *[("oos", one(_item(F.lit(c), n=F.col("selection.n_trials"), value=F.col(f"selection.oos.{c}")))) for c in _OOS],
        ("selected", one(_item(F.lit("selected"), F.col("selection.selected_variant")))),
        *_each("per_config", books, _MEANS, lambda b, c: _item(_dotted(b, c), value=b["value"][c])),
        *[("dsr", one(_item(F.lit(c), n=F.col("deflated_sharpe.n_trials"), value=F.col(f"deflated_sharpe.{f}")))) for c, f in (("dsr", "value"), ("sr_var", "sr_variance"))],
        *[("bootstrap", one(_item(F.lit(f"{m}.{s}"), value=F.col(f"bootstrap.{m}.{s}")))) for m in ("sharpe", "total_return") for s in ("point", "lo", "hi")],
    )
