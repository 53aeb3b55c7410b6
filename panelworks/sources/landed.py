"""Landed API responses of all sources in one table.

``raw(source, key, fetched_at, body)`` holds one response per row as a fetcher landed it, fetches of a key
in any number and order. A body is parsed once, as a VARIANT, whatever its shape; a body that is no JSON
goes to the rejects and hides nothing that was fetched before it. Tables are read off the parsed rows by
path. Where responses overlap, each day, symbol or token takes its value from the newest response that
holds it; snapshots (pools of a token) take the newest response as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CANDLE = "STRUCT<open: DOUBLE, high: DOUBLE, low: DOUBLE, close: DOUBLE, volume: DOUBLE>"
_QUOTES = f"ARRAY<STRUCT<time_open: STRING, quote: MAP<STRING, {_CANDLE}>>>"


def parsed(raw: DataFrame) -> DataFrame:
    """``raw`` with ``doc``, the body as a VARIANT, NULL where it is not JSON."""
    return raw.withColumn("doc", F.try_parse_json("body"))


def rejects(docs: DataFrame) -> DataFrame:
    """Responses that cannot be read: (source, key, fetched_at, body, n_chars)."""
    return docs.filter(F.col("doc").isNull()).select("source", "key", "fetched_at", "body", F.coalesce(F.length("body"), F.lit(0)).alias("n_chars"))


def of_source(docs: DataFrame, source: str) -> DataFrame:
    """The readable responses of one source."""
    return docs.filter((F.col("source") == source) & F.col("doc").isNotNull())


def newest(docs: DataFrame) -> DataFrame:
    """The newest readable response of each source and key; of those fetched together, the greatest body."""
    last = F.max_by(F.struct("fetched_at", "doc"), F.struct("fetched_at", "body"))
    readable = docs.filter(F.col("doc").isNotNull())
    return readable.groupBy("source", "key").agg(last.alias("last")).select("source", "key", "last.fetched_at", "last.doc")


def _get(path: str, kind: str, doc: Column | str = "doc") -> Column:
    return F.try_variant_get(F.col(doc) if isinstance(doc, str) else doc, path, kind)


def _latest(rows: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """One row per key: the values of the newest response and its last position."""
    picked = F.max_by(F.struct(*[v.alias(n) for n, v in values.items()]), F.struct("fetched_at", "i"))
    return rows.groupBy(*keys).agg(picked.alias("v")).select(*keys, "v.*")


def bars(docs: DataFrame, source: str = "ohlcv", convert: str = "USD") -> DataFrame:
    """Daily bars; the key is the symbol. Its entry under ``data`` is an object, a list (the first counts),
    or absent, with the quotes right under ``data``."""
    rows = of_source(docs, source).withColumn("entry", F.try_element_at(_get("$.data", "map<string, variant>"), F.col("key")))
    quotes = F.coalesce(_get("$[0].quotes", _QUOTES, "entry"), _get("$.quotes", _QUOTES, "entry"), _get("$.data.quotes", _QUOTES))
    listed = rows.select(F.col("key").alias("symbol"), "fetched_at", F.posexplode(quotes).alias("i", "q"))
    listed = listed.withColumns({"date": F.to_date(F.to_timestamp("q.time_open")), "c": F.try_element_at("q.quote", F.lit(convert))})
    return _latest(listed, ["symbol", "date"], **{n: F.col(f"c.{n}") for n in ("open", "high", "low", "close", "volume")})


def quotes(docs: DataFrame, source: str = "quotes", convert: str = "USD") -> DataFrame:
    """Latest price and volume of each symbol, from the newest response that names it."""
    entries = _get("$.data", "map<string, variant>")
    rows = of_source(docs, source).select("fetched_at", F.lit(0).alias("i"), F.explode(entries).alias("symbol", "entry"))
    quote = F.try_element_at(_get("$.quote", "map<string, struct<price: double, volume_24h: double>>", "entry"), F.lit(convert))
    return _latest(rows.withColumn("q", quote), ["symbol"], price=F.col("q.price"), volume_24h=F.col("q.volume_24h"))


def tvl(docs: DataFrame, source: str = "tvl", chain_key: str | None = None) -> DataFrame:
    """Locked value per chain (the key) and day; with ``chain_key`` that of a protocol on one chain."""
    points = _get("$", "array<struct<date: bigint, tvl: double>>") if chain_key is None else F.transform(
        _get("$.tvl", "array<struct<date: bigint, totalLiquidityUSD: double>>", F.try_element_at(_get("$.chainTvls", "map<string, variant>"), F.lit(chain_key))),
        lambda p: F.struct(p["date"].alias("date"), p["totalLiquidityUSD"].alias("tvl")),
    )
    rows = of_source(docs, source).select(F.col("key").alias("chain_id"), "fetched_at", F.posexplode(points).alias("i", "p"))
    return _latest(rows.withColumn("date", F.to_date(F.timestamp_seconds("p.date"))), ["chain_id", "date"], value=F.col("p.tvl"))


def pools(docs: DataFrame, source: str = "pools", network: str = "bsc") -> DataFrame:
    """Highest-reserve pool of each token (the key) in its newest response; amounts that are no numbers
    count as 0, the first pool wins ties, and a token without pools has no row."""
    prefix = f"{network}_"
    kind = "array<struct<id: string, attributes: struct<reserve_in_usd: string, volume_usd: map<string, string>>>>"
    amount = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    bare = lambda c: F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)

    def pool(p: Column, i: Column) -> Column:
        volume = F.try_element_at(p["attributes"]["volume_usd"], F.lit("h24"))
        return F.struct(amount(p["attributes"]["reserve_in_usd"]).alias("reserve_usd"), (-i).alias("first"),
                        bare(F.coalesce(p["id"], F.lit(""))).alias("pool_address"), amount(volume).alias("volume_24h"))

    best = F.array_max(F.transform(_get("$.data", kind), pool))
    rows = newest(of_source(docs, source)).select(F.col("key").alias("token"), best.alias("best")).filter(F.col("best").isNotNull())
    return rows.select("token", "best.pool_address", "best.reserve_usd", "best.volume_24h")
