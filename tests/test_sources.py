import json

import pytest
from helpers import day, ordered
from pyspark.sql import functions as F

from panelworks.operators import export, rebalance, report
from panelworks.schemas import BARS
from panelworks.session import scratch_path
from panelworks.sources import dims, landed, payloads, stores

QUOTE = {"time_open": "2024-01-02T00:00:00.000Z", "quote": {"USD": {"open": 1, "high": 3, "low": 0.5, "close": 2, "volume": 9}}}


def raw(spark, key, docs):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], f"{key} string, body string")


def test_ohlcv_shapes(spark):
    docs = {
        "A": {"data": {"A": [{"quotes": [QUOTE]}, {"quotes": [QUOTE, QUOTE]}]}},
        "B": {"data": {"B": {"quotes": [QUOTE]}}},
        "C": {"data": {"id": 1, "quotes": [QUOTE]}},
        "D": {"data": {"D": []}},
        "E": {"status": 1},
    }
    got = ordered(payloads.ohlcv_quotes(raw(spark, "symbol", docs)), "symbol")
    assert [(r.symbol, r.date, r.open, r.close, r.volume) for r in got] == [(s, day(1), 1.0, 2.0, 9.0) for s in "ABC"]


def test_latest_quotes(spark):
    doc = {"data": {"A": {"quote": {"USD": {"price": 2.5, "volume_24h": 7}}}, "B": {"quote": {}}}}
    got = ordered(payloads.latest_quotes(raw(spark, "k", {"x": doc})), "symbol")
    assert [tuple(r) for r in got] == [("A", 2.5, 7.0), ("B", None, None)]


def test_tvl_keeps_the_last_of_a_day(spark):
    s = 1704067200
    body = raw(spark, "chain_id", {"c": [{"date": s + 86400, "tvl": 5}, {"date": s, "tvl": 1}, {"date": s + 60, "tvl": 2}]})
    assert [(r.date, r.value) for r in ordered(payloads.chain_tvl(body), "date")] == [(day(0), 2.0), (day(1), 5.0)]
    proto = {"chainTvls": {"Ethereum": {"tvl": [{"date": s, "totalLiquidityUSD": 9}]}, "Binance": {"tvl": [{"date": s, "totalLiquidityUSD": 4}]}}}
    assert [r.value for r in payloads.protocol_tvl(raw(spark, "chain_id", {"c": proto})).collect()] == [4.0]
    assert payloads.protocol_tvl(raw(spark, "chain_id", {"c": proto}), "Tron").count() == 0


def test_candles_keep_every_candle(spark):
    s = 1704067200
    doc = {"data": {"attributes": {"ohlcv_list": [[s + 86400 * i, i, i, i, i, i] for i in (2, 1, 0)]}}}
    got = ordered(payloads.candles(raw(spark, "symbol", {"A": doc})), "date")
    assert [(r.date, r.close) for r in got] == [(day(0), 0.0), (day(1), 1.0), (day(2), 2.0)]


def test_top_pool(spark):
    pool = lambda i, r, v="1": {"id": i, "attributes": {"reserve_in_usd": r, "volume_usd": {"h24": v}}}
    docs = {"t": {"data": [pool("bsc_a", "10"), pool("bsc_b", "20.5", "7"), pool("bsc_c", "20.5"), pool("bsc_d", None)]},
            "bad": {"data": [pool("x_a", "n/a"), pool("bsc_b", "oops")]}, "none": {"data": []}}
    got = {r.token: tuple(r)[1:] for r in payloads.top_pools(raw(spark, "token", docs)).collect()}
    assert got == {"t": ("b", 20.5, 7.0), "bad": ("x_a", 0.0, 1.0)}


def test_transfer_aggregates(spark):
    rows = [{"Block": {"Date": "2024-01-02T00:00:00Z"}, "count": "3", "sum_amount": "12.500000000000000001"},
            {"Block": {"Date": "2024-01-01T00:00:00Z"}, "count": "1", "sum_amount": "2"},
            {"Block": {"Date": "2024-01-01T00:00:00Z"}, "count": "4", "sum_amount": "6"}]
    got = ordered(payloads.transfer_aggregates(raw(spark, "token", {"t": rows})), "date")
    assert [tuple(r)[1:] for r in got] == [(day(0), 6.0, 4), (day(1), 12.5, 3)]


def bars(spark, rows):
    return spark.createDataFrame([(s, day(i), v, v, v, v, v) for s, i, v in rows],
                                 "symbol string, date date, open double, high double, low double, close double, volume double")


def test_bar_store_replaces_symbols(spark):
    path = scratch_path(spark)
    names = [f"S/{i}" for i in range(9)]
    stores.put_bars(bars(spark, [(s, d, 1.0) for s in names for d in range(3)]), path, 2)
    stores.put_bars(bars(spark, [("S/4", 1, 7.0), ("new", 0, 8.0)]), path, 2)
    everything = stores.get_bars(spark, path)
    assert everything.count() == 8 * 3 + 2
    assert [r.close for r in stores.get_bars(spark, path, ["S/4", "absent"]).collect()] == [7.0]
    sliced = stores.get_bars(spark, path, ["S/1"], str(day(1)), str(day(1)))
    assert [r.date for r in sliced.collect()] == [day(1)]
    plan = sliced._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "bucket#" in plan


def test_series_store(spark):
    path = scratch_path(spark)
    rows = lambda kind, v: spark.createDataFrame([(kind, "A", day(0), v), (kind, "B", day(0), v)], "kind string, symbol string, date date, value double")
    stores.put_series(rows("tvl", 1.0).unionByName(rows("vol", 2.0)), path, 2)
    stores.put_series(rows("tvl", 5.0).filter("symbol = 'A'"), path, 2)
    assert sorted((r.symbol, r.value) for r in stores.get_series(spark, path, "tvl").collect()) == [("A", 5.0), ("B", 1.0)]
    assert stores.get_series(spark, path, "vol", ["B"]).first().value == 2.0


def test_universe_and_tokens(spark, tmp_path):
    doc = tmp_path / "universe.json"
    doc.write_text(json.dumps({"symbols": ["B", "A", "B", "C"]}))
    assert [r.symbol for r in ordered(dims.read_universe(spark, str(doc)), "ord")] == ["B", "A", "C"]
    tokens = spark.createDataFrame([("cake", "bsc"), ("cake", "eth"), ("bnb", "bsc"), ("0xAb", "bsc"), ("zz", "bsc")], "sym string, chain string")
    got = {(r.sym, r.chain): r.resolved for r in dims.resolve_tokens(
        tokens, dims.pairs(spark, dims.TOKEN_ADDRESSES, "symbol string, address string"),
        dims.pairs(spark, dims.SYMBOL_ALIASES, "symbol string, alias string")).collect()}
    assert got == {("cake", "bsc"): dims.TOKEN_ADDRESSES["CAKE"], ("cake", "eth"): "CAKE", ("bnb", "bsc"): "WBNB", ("0xAb", "bsc"): "0xAb", ("zz", "bsc"): "ZZ"}
    wallets = spark.createDataFrame(list(dims.EXCHANGE_WALLETS.items()), "exchange string, addresses array<string>")
    assert dims.wallet_addresses(wallets.unionByName(wallets)).count() == 7


def book(spark, w):
    return spark.createDataFrame([("p", s, float(v)) for s, v in w.items()] or [("q", "none", 0.0)], "panel_id string, symbol string, w double")


def intents(spark, cur, tgt, usd=1000.0):
    rows = ordered(rebalance.weights_to_intents(book(spark, cur), book(spark, tgt), ["panel_id"], usd).filter("panel_id = 'p'"), "seq")
    return [(r.seq, r.action, r.symbol, r.usd_amount, r.fraction) for r in rows]


def test_intents_order_dust_and_union(spark):
    got = intents(spark, {"A": 0.5, "B": 0.3, "D": 0.1}, {"A": 0.2, "C": 0.4, "B": 0.3, "D": 0.105, "E": 0.4})
    assert got == [(1, "sell", "A", 300.0, -0.3), (2, "buy", "C", 400.0, 0.4), (3, "buy", "E", 400.0, 0.4)]
    assert intents(spark, {"A": 0.5}, {"A": 0.1}, 0.0) == []


def test_sequence_of_a_large_book_equals_a_sort(spark):
    n = 3000
    df = spark.range(n).select(
        F.lit("p").alias("panel_id"), F.concat(F.lit("SYMBOL-"), F.col("id")).alias("symbol"),
        F.when(F.col("id") % 3 == 0, "sell").otherwise("buy").alias("action"),
        F.round(10 + F.pmod(F.col("id") * 7919, F.lit(700)) * 13.37, 2).alias("usd_amount"), F.lit(0.1).alias("fraction"))
    got = [(r.action, r.usd_amount, r.symbol) for r in ordered(rebalance.sequenced(df, ["panel_id"]), "seq")]
    assert got == sorted(got, key=lambda t: (t[0] != "sell", -t[1], t[2]))


@pytest.mark.parametrize(
    ("regime", "off", "hold", "note"),
    [
        ("trending", True, True, "no trades: the risk-off gate is on"),
        ("high_volatility", False, True, "no trades: volatility is high"),
        ("ranging", False, False, "market portfolio: sells 1, buys 1"),
    ],
)
def test_execution_plan(spark, regime, off, hold, note):
    read = spark.createDataFrame([("p", day(0), regime, 0.9, off)], "panel_id string, date date, regime string, confidence double, risk_off boolean")
    cur, tgt = book(spark, {"A": 0.5}), book(spark, {"B": 0.5})
    plan = rebalance.execution_plan(read, cur, tgt, ["panel_id"], 1000.0)
    row = plan.first()
    assert (row.hold, row.note) == (hold, note)
    orders = rebalance.weights_to_intents(cur, tgt, ["panel_id"], 1000.0)
    assert rebalance.plan_intents(plan, orders, ["panel_id"]).count() == (0 if hold else 2)
    aligned = rebalance.execution_plan(read.withColumns({"risk_off": F.lit(False), "regime": F.lit("trending")}), cur, cur, ["panel_id"], 1000.0).first()
    assert aligned.note == "momentum: on target, no trade reaches 10"


def test_read_document_is_canonical(spark):
    df = spark.sql("""select 'p' panel_id, date'2024-01-01' date, 'trending' regime, 0.5D confidence, false risk_off,
        map('b', 1D, 'a', 2D) posterior, map('y', 1D, 'x', 2D) features, map('d', 1D, 'c', 2D) attribution""")
    text = export.read_documents(df, "svc").first().document
    doc = json.loads(text)
    assert text == json.dumps(doc, sort_keys=True, separators=(",", ":"))
    assert doc["read"]["recommended_stance"] == "momentum" and doc["version"] == 1 and "job_id" not in doc
    assert json.loads(export.read_documents(df, "svc", F.lit(7)).first().document)["job_id"] == 7


def test_cash_share_and_rebase(spark):
    rows = [("p", "c", day(i), v) for i, v in enumerate([10.0, 10.0, 12.0, 12.0, 12.0])]
    df = spark.createDataFrame(rows, "panel_id string, config_id string, date date, equity double")
    assert report.cash_share(df).first().cash_share == pytest.approx(0.75)
    assert [r.pct_return for r in ordered(report.rebased(df), "date")] == [0.0, 0.0, pytest.approx(20.0), pytest.approx(20.0), pytest.approx(20.0)]


def test_store_remembers_its_buckets(spark, tmp_path):
    from panelworks.sources import stores

    path = str(tmp_path / "bars")
    rows = spark.range(40).selectExpr(
        "concat('s', id % 20) AS symbol", "date_add(DATE'2024-01-01', CAST(id AS INT)) AS date",
        "1D AS open", "1D AS high", "1D AS low", "1D AS close", "1D AS volume",
    )
    stores.put_bars(rows, path, buckets=8)
    stores.put_bars(rows.filter("symbol = 's3'"), path)  # the store's own count holds
    names = [f"s{i}" for i in range(20)]
    assert stores.get_bars(spark, path, names).count() == stores.get_bars(spark, path).count() == 40


def test_the_last_fetch_of_a_day_wins(spark):
    s = 1704067200
    fetched = lambda docs: spark.createDataFrame([("k", t, json.dumps(d)) for t, d in docs], "k string, fetched_at int, body string")
    docs = [(2, [{"date": s, "tvl": 7}]), (1, [{"date": s, "tvl": 1}, {"date": s, "tvl": 2}, {"date": s + 86400, "tvl": 3}])]
    got = ordered(payloads.chain_tvl(fetched(docs).withColumnRenamed("k", "chain_id")), "date")
    assert [r.value for r in got] == [7.0, 3.0]
    listed = lambda rows: {"data": {"attributes": {"ohlcv_list": rows}}}
    twice = fetched([(2, listed([[s, 5, 5, 5, 5, 5]])), (1, listed([[s, 1, 1, 1, 1, 1]]))])
    assert [r.close for r in payloads.candles(twice.withColumnRenamed("k", "symbol")).collect()] == [5.0]


def test_newest_fetch_of_quotes_and_pools(spark):
    quote = lambda p: json.dumps({"data": {"A": {"quote": {"USD": {"price": p}}}}})
    raw = spark.createDataFrame([(quote(2.0), 2), (quote(1.0), 1), ("{broken", 3)], "body string, fetched_at int")
    assert [tuple(r) for r in payloads.latest_quotes(raw).collect()] == [("A", 2.0, None)]
    pool = lambda n, r: json.dumps({"data": [{"id": f"bsc_{n}", "attributes": {"reserve_in_usd": r}}]})
    raw = spark.createDataFrame([("t", pool("old", "9"), 1), ("t", pool("new", "5"), 2)], "token string, body string, fetched_at int")
    assert [tuple(r) for r in payloads.top_pools(raw).collect()] == [("t", "new", 5.0, 0.0)]


def test_landed_responses_of_every_shape(spark):
    day = lambda d, o: {"time_open": f"2024-01-0{d}T00:00:00.000Z", "quote": {"USD": {"open": o, "close": 1}}}
    rows = [
        ("ohlcv", "A", 1, json.dumps({"data": {"A": [{"quotes": [day(1, 1.0), day(2, 2.0)]}]}})),
        ("ohlcv", "A", 2, json.dumps({"data": {"A": {"quotes": [day(2, 5.0), day(2, 6.0)]}}})),
        ("ohlcv", "B", 1, json.dumps({"data": {"quotes": [day(3, 3)]}})),
        ("ohlcv", "A", 3, '{"data": {"A"'), ("ohlcv", "C", 1, None), ("ohlcv", "D", 1, ""), ("ohlcv", "E", 1, "[]"),
        ("tvl", "BSC", 1, json.dumps([{"date": 86400, "tvl": 1}, {"date": 86401, "tvl": 2.5}])),
        ("protocol", "BSC", 1, json.dumps({"chainTvls": {"Binance": {"tvl": [{"date": 0, "totalLiquidityUSD": 7}]}}})),
        ("pools", "t", 1, json.dumps({"data": [{"id": "bsc_x", "attributes": {"reserve_in_usd": "3", "volume_usd": {"h24": "n/a"}}}]})),
        ("pools", "t", 2, json.dumps({"data": []})), ("pools", "u", 1, json.dumps({"data": [{"attributes": {}}, {"id": "y"}]})),
    ]
    docs = landed.parsed(spark.createDataFrame(rows, "source string, key string, fetched_at int, body string"))
    assert {(r.key, r.fetched_at, r.n_chars) for r in landed.rejects(docs).collect()} == {("A", 3, 13), ("C", 1, 0), ("D", 1, 0)}
    assert {(r.symbol, r.date.day, r.open) for r in landed.bars(docs).collect()} == {("A", 1, 1.0), ("A", 2, 6.0), ("B", 3, 3.0)}
    assert [(r.chain_id, r.date.day, r.value) for r in landed.tvl(docs).collect()] == [("BSC", 2, 2.5)]
    assert [r.value for r in landed.tvl(docs, "protocol", "Binance").collect()] == [7.0] and landed.tvl(docs, "protocol", "Other").count() == 0
    assert {tuple(r) for r in landed.pools(docs).collect()} == {("u", "", 0.0, 0.0)}
    assert {(r.source, r.key, r.fetched_at) for r in landed.newest(docs).collect()} >= {("ohlcv", "A", 2), ("pools", "t", 2)}
    assert landed.quotes(docs).count() == 0


def test_a_put_may_read_the_store_it_replaces(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = [(s, day(i), 1.0, 2.0, 0.5, float(i), 3.0) for s in "ABCDEFGH" for i in range(5)]
    bars = spark.createDataFrame(rows, BARS)
    stores.put_bars(bars, path, buckets=2)
    doubled = stores.get_bars(spark, path, ["A", "C"]).withColumn("close", F.col("close") * 2)
    stores.put_bars(doubled, path)
    got = {(r.symbol, r.date): r.close for r in stores.get_bars(spark, path).collect()}
    assert got == {(s, d): c * (2 if s in "AC" else 1) for s, d, _, _, _, c, _ in rows}
    stores.put_bars(stores.get_bars(spark, path), path)
    assert stores.get_bars(spark, path).count() == 40
