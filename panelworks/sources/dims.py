"""Small reference dimensions: universe, wallets, addresses and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The liquid subset used for quick runs.
MAJORS = ("ETH", "XRP", "ADA", "LINK", "DOGE", "AVAX", "DOT", "CAKE")

# Contract addresses of the majors.
TOKEN_ADDRESSES = {
    "CAKE": "0x0e09fabb73bd3ade0a17ecc321fd13a19e81ce82",
    "ETH": "0x2170ed0880ac9a755fd29b2688956bd959f933f8",
    "XRP": "0x1d2f0da169ceb9fc7b3144628db156f3f6c60dbe",
    "ADA": "0x3ee2200efb3400fabb9aacf31297cbdd1d435d47",
    "DOGE": "0xba2ae424d960c26247dd6c32edc70b295c744c43",
    "LINK": "0xf8a0bf9cf54bb92f17374d9e9a321e6a111a51bd",
    "DOT": "0x7083609fce4d1d8dc0c979aab8c869ea2c873402",
    "AVAX": "0x1ce0c2827e2ef14d5c4f29a091d735a204794041",
}

# Symbols traded under another name.
SYMBOL_ALIASES = {"BNB": "WBNB"}

# Published exchange hot wallets.
EXCHANGE_WALLETS = {
    "binance": [
        "0x8894e0a0c962cb723c1976a4421c95949be2d4e3",
        "0xf977814e90da44bfa03b6295a0616a897441acec",
        "0x5a52e96bacdabb82fd05763e25335261b270efcb",
        "0xe2fc31f816a9b94326492132018c3aecc4a93ae1",
    ],
    "okx": ["0x2c8fbb630289363ac80705a1a61273f76fd5a161"],
    "gate": ["0x0d0707963952f2fba59dd06f2b425ace40b492fe"],
    "bybit": ["0xf89d7b9c864f589bbf53a82105107622b35eaa40"],
}

# Smallest single transfer, in token units, that counts as large.
WHALE_MIN_AMOUNT = {
    "CAKE": 10000.0,
    "ETH": 10.0,
    "XRP": 50000.0,
    "ADA": 50000.0,
    "DOGE": 1000000.0,
    "LINK": 5000.0,
    "DOT": 5000.0,
    "AVAX": 2000.0,
}


def pairs(spark: SparkSession, mapping: dict, schema: str) -> DataFrame:
    """A small mapping as a two-column table."""
    return spark.createDataFrame(list(mapping.items()), schema)


def universe(listed: DataFrame) -> DataFrame:
    """Distinct symbols of ``listed(pos, symbol)`` keeping first-seen order."""
    return listed.groupBy("symbol").agg(F.min("pos").alias("ord"))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Universe from a JSON document with a ``symbols`` array."""
    doc = spark.read.schema("symbols ARRAY<STRING>").json(path, multiLine=True)
    return universe(doc.select(F.posexplode("symbols").alias("pos", "symbol")))


def wallet_addresses(wallets: DataFrame) -> DataFrame:
    """Distinct addresses of ``wallets(exchange, addresses)``."""
    return wallets.select(F.explode("addresses").alias("address")).distinct()


def resolve_tokens(
    tokens: DataFrame, addresses: DataFrame, aliases: DataFrame, chain: str = "bsc"
) -> DataFrame:
    """Tradable identifier of ``tokens(sym, chain)``: a contract address passes
    through, a known symbol on ``chain`` becomes its address, otherwise the alias
    or the upper-cased symbol."""
    up = F.upper("sym")
    named = tokens.withColumn("up", up)
    joined = named.join(
        addresses.select(F.col("symbol").alias("up"), "address"), "up", "left"
    ).join(aliases.select(F.col("symbol").alias("up"), "alias"), "up", "left")
    on_chain = F.when(F.col("chain") == chain, F.col("address"))
    return joined.select(
        "sym",
        "chain",
        F.when(F.col("up").startswith("0X"), F.col("sym"))
        .otherwise(F.coalesce(on_chain, F.col("alias"), F.col("up")))
        .alias("resolved"),
    )
