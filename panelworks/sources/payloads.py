"""Raw API payloads flattened to tables.

Input is ``(key, body)``, and optionally ``fetched_at``, with one JSON document per
row as landed by a fetcher. Of several values for a day the last fetch wins, and
within it the last position.
Schemas are explicit; each document is parsed in the task that reads it. A
document is one API response, so in-row array work is bounded by the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CANDLE = "STRUCT<open: DOUBLE, high: DOUBLE, low: DOUBLE, close: DOUBLE, volume: DOUBLE>"
_QUOTES = f"ARRAY<STRUCT<time_open: STRING, quote: MAP<STRING, {_CANDLE}>>>"


def _unix_day(seconds: Column | str) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def ohlcv_quotes(raw: DataFrame, convert: str = "USD") -> DataFrame:
    """Historical OHLCV of ``raw(symbol, body)``.

    The symbol's entry under ``data`` may be a list (its first element counts) or
    an object; without an entry, ``data.quotes`` itself is taken.
    """
    data = F.from_json("body", "STRUCT<data: MAP<STRING, STRING>>")["data"]
    parsed = raw.withColumn("data", data).withColumn("entry", F.try_element_at("data", F.col("symbol")))
    quotes = (
        F.when(
            F.col("entry").startswith("["),
            F.get(F.from_json("entry", f"ARRAY<STRUCT<quotes: {_QUOTES}>>"), F.lit(0))["quotes"],
        )
        .when(F.col("entry").startswith("{"), F.from_json("entry", f"STRUCT<quotes: {_QUOTES}>")["quotes"])
        .otherwise(F.from_json(F.try_element_at("data", F.lit("quotes")), _QUOTES))
    )
    rows = parsed.select(*_keys(raw, "symbol"), F.posexplode(quotes).alias("i", "q"))
    rows = rows.withColumn("usd", F.try_element_at("q.quote", F.lit(convert)))
    values = {c: F.col(f"usd.{c}") for c in ("open", "high", "low", "close", "volume")}
    return _last_per_day(rows, ["symbol"], F.to_date(F.to_timestamp("q.time_open")), **values)


def latest_quotes(raw: DataFrame, convert: str = "USD") -> DataFrame:
    """Latest price and 24-hour volume per symbol of ``raw(body)``; absent is NULL. With ``fetched_at``
    the newest fetch that names a symbol gives its row."""
    schema = "STRUCT<data: MAP<STRING, STRUCT<quote: MAP<STRING, STRUCT<price: DOUBLE, volume_24h: DOUBLE>>>>>"
    fetched = ["fetched_at"] if "fetched_at" in raw.columns else []
    rows = raw.select(*fetched, F.explode(F.from_json("body", schema)["data"]).alias("symbol", "entry"))
    quote = F.try_element_at("entry.quote", F.lit(convert))
    rows = rows.select(*fetched, "symbol", quote["price"].alias("price"), quote["volume_24h"].alias("volume_24h"))
    if not fetched:
        return rows
    last = F.max_by(F.struct("price", "volume_24h"), "fetched_at")
    return rows.groupBy("symbol").agg(last.alias("v")).select("symbol", "v.*")


def _last_per_day(rows: DataFrame, keys: list[str], day: Column, **values: Column) -> DataFrame:
    """One row per key and day; the last fetch and payload position wins."""
    order = F.struct("fetched_at", "i") if "fetched_at" in rows.columns else F.col("i")
    return rows.withColumn("date", day).groupBy(*keys, "date").agg(
        *[F.max_by(c, order).alias(n) for n, c in values.items()]
    )


def _keys(raw: DataFrame, key: str) -> list[str]:
    return [key, *(c for c in ("fetched_at",) if c in raw.columns)]


def chain_tvl(raw: DataFrame) -> DataFrame:
    """Whole-chain locked value per day of ``raw(chain_id, body)``."""
    records = F.from_json("body", "ARRAY<STRUCT<date: BIGINT, tvl: DOUBLE>>")
    rows = raw.select(*_keys(raw, "chain_id"), F.posexplode(records).alias("i", "r"))
    return _last_per_day(rows, ["chain_id"], _unix_day("r.date"), value=F.col("r.tvl"))


def protocol_tvl(raw: DataFrame, chain_key: str = "Binance") -> DataFrame:
    """One protocol's locked value on one chain; a missing chain yields no rows."""
    schema = "STRUCT<chainTvls: MAP<STRING, STRUCT<tvl: ARRAY<STRUCT<date: BIGINT, totalLiquidityUSD: DOUBLE>>>>>"
    entry = F.try_element_at(F.from_json("body", schema)["chainTvls"], F.lit(chain_key))
    rows = raw.select(*_keys(raw, "chain_id"), F.posexplode(entry["tvl"]).alias("i", "r"))
    return _last_per_day(rows, ["chain_id"], _unix_day("r.date"), value=F.col("r.totalLiquidityUSD"))


def candles(raw: DataFrame) -> DataFrame:
    """Candle arrays ``[ts, o, h, l, c, v]`` of ``raw(symbol, body)``: every day landed."""
    schema = "STRUCT<data: STRUCT<attributes: STRUCT<ohlcv_list: ARRAY<ARRAY<DOUBLE>>>>>"
    listed = F.from_json("body", schema)["data"]["attributes"]["ohlcv_list"]
    rows = raw.select(*_keys(raw, "symbol"), F.posexplode(listed).alias("i", "c"))
    values = {n: F.col("c")[i] for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)}
    return _last_per_day(rows, ["symbol"], _unix_day(F.col("c")[0].cast("bigint")), **values)


def top_pools(raw: DataFrame, network: str = "bsc") -> DataFrame:
    """Highest-reserve pool per token of ``raw(token, body)``.

    Non-numeric amounts count as 0 and the first pool wins ties; tokens without
    pools yield no row. With ``fetched_at`` a token's newest fetch counts.
    """
    if "fetched_at" in raw.columns:
        raw = raw.groupBy("token").agg(F.max_by("body", "fetched_at").alias("body"))
    schema = (
        "STRUCT<data: ARRAY<STRUCT<id: STRING, attributes: "
        "STRUCT<reserve_in_usd: STRING, volume_usd: MAP<STRING, STRING>>>>>"
    )
    prefix = f"{network}_"
    bare = lambda c: F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)
    amount = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    best = F.array_max(
        F.transform(
            F.from_json("body", schema)["data"],
            lambda p, i: F.struct(
                amount(p["attributes"]["reserve_in_usd"]).alias("reserve_usd"),
                (-i).alias("first"),
                bare(F.coalesce(p["id"], F.lit(""))).alias("pool_address"),
                amount(F.try_element_at(p["attributes"]["volume_usd"], F.lit("h24"))).alias("volume_24h"),
            ),
        )
    )
    rows = raw.select("token", best.alias("best")).filter(F.col("best").isNotNull())
    return rows.select("token", "best.pool_address", "best.reserve_usd", "best.volume_24h")


def transfer_aggregates(raw: DataFrame) -> DataFrame:
    """Aggregated transfer rows of ``raw(token, body)``; numbers arrive as strings.

    Amounts carry 18 decimals, kept in the raw cast and narrowed to double.
    """
    schema = "ARRAY<STRUCT<Block: STRUCT<Date: STRING>, count: STRING, sum_amount: STRING>>"
    rows = raw.select(*_keys(raw, "token"), F.posexplode(F.from_json("body", schema)).alias("i", "r"))
    return _last_per_day(
        rows,
        ["token"],
        F.to_date(F.to_timestamp("r.Block.Date")),
        volume=F.col("r.sum_amount").cast("decimal(38,18)").cast("double"),
        count=F.col("r.count").cast("bigint"),
    )
