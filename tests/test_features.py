import numpy as np
import pandas as pd
import pytest
from helpers import day, indexed, ordered, prices
from pyspark.sql import functions as F

from panelworks.operators import align, features, flows, panel, regime


def random_panel(n=90, names=4, seed=3, holes=True):
    rng = np.random.default_rng(seed)
    cols = {}
    for k in range(names):
        walk = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        cols[f"S{k}"] = [None if holes and rng.random() < 0.1 else float(v) for v in walk]
    cols["S0"] = [100.0 + i if v is None else v for i, v in enumerate(cols["S0"])]
    return cols


def wide(cols):
    return pd.DataFrame(cols, index=[day(i) for i in range(len(next(iter(cols.values()))))], dtype=float)


def brute_features(px):
    mkt = px.pct_change(fill_method=None).mean(axis=1)
    vol = mkt.rolling(20).std(ddof=0)
    trend = (mkt.rolling(20).mean() / vol).where(vol > 0, 0.0)
    cum = px / px.shift(20) - 1
    have = cum.notna().sum(axis=1)
    breadth = ((cum > 0).sum(axis=1) / have).where(have > 0)
    out = pd.DataFrame(
        {"trend_strength": trend, "realized_vol": vol, "breadth": breadth, "dispersion": cum.std(axis=1, ddof=0)}
    )
    return out.ffill().fillna(0.0)


def test_features_match_a_wide_frame(spark):
    cols = random_panel()
    got = ordered(features.feature_panel(features.market_daily(indexed(spark, cols))), "pos")
    want = brute_features(wide(cols))
    for c in want.columns:
        assert np.allclose([r[c] for r in got], want[c], atol=1e-12), c


def test_enriched_panel_gives_the_same_features(spark):
    p = indexed(spark, random_panel())
    a = ordered(features.feature_panel(features.market_daily(p)), "pos")
    b = ordered(features.feature_panel(features.market_daily(features.enriched(p))), "pos")
    assert a == b


def test_future_rows_never_change_earlier_features(spark):
    cols = random_panel()
    cut = {k: v[:70] for k, v in cols.items()}
    full = ordered(features.feature_panel(features.market_daily(indexed(spark, cols))).filter("pos < 70"), "pos")
    head = ordered(features.feature_panel(features.market_daily(indexed(spark, cut))), "pos")
    assert full == head


def brute_risk_off(px):
    flags = []
    for t in range(len(px)):
        hist = px.iloc[: t + 1]
        idx = (hist / hist.bfill().iloc[0]).mean(axis=1).dropna()
        last = idx.iloc[-1]
        off = last / idx.max() - 1 < -0.10
        if len(idx) >= 50 and last < idx.iloc[-50:].mean():
            off = True
        flags.append(bool(off))
    return flags


def test_risk_off_equals_a_prefix_loop(spark):
    cols = random_panel(n=120, seed=9)
    got = [r.risk_off for r in ordered(features.risk_off(features.market_daily(indexed(spark, cols))), "pos")]
    assert got == brute_risk_off(wide(cols))


def test_missing_cells_break_returns(spark):
    rows = ordered(features.simple_returns(indexed(spark, {"A": [1, 2, None, 4, 8], "B": [1, 1, 1, 1, 1]})).filter("symbol='A'"), "pos")
    assert [r.ret for r in rows] == [None, 1.0, None, 1.0]


def test_dense_grid_and_guard(spark):
    p = prices(spark, {"A": [1, None, 3], "B": [None, 2, None]})
    grid = ordered(panel.dense_grid(p), "symbol", "pos")
    assert [(r.symbol, r.pos, r.close) for r in grid] == [
        ("A", 0, 1.0), ("A", 1, None), ("A", 2, 3.0), ("B", 0, None), ("B", 1, 2.0), ("B", 2, None)
    ]
    lone = prices(spark, {"A": [1]}, "q")
    guard = {r.panel_id: r.accepted for r in panel.panel_guard(p.unionByName(lone)).collect()}
    assert guard == {"p": True, "q": False}


def test_price_panel_slices_and_rejects_bad_prices(spark):
    bars = prices(spark, {"A": [1, 2, 3, 4], "B": [0, -1, 5, 6], "Z": [1, 1, 1, 1]}).drop("ord", "panel_id")
    names = spark.createDataFrame([("p", "B", 0), ("p", "A", 1), ("q", "A", 0), ("p", "C", 2)], "panel_id string, symbol string, ord int")
    got = panel.price_panel(bars, names, str(day(1)), str(day(2)))
    assert {(r.panel_id, r.symbol, r.date) for r in got.collect()} == {
        ("p", "A", day(1)), ("p", "A", day(2)), ("q", "A", day(1)), ("q", "A", day(2)), ("p", "B", day(2))
    }
    lost = panel.missing_symbols(bars, names, str(day(1)), str(day(2)))
    assert [(r.panel_id, r.symbol) for r in lost.collect()] == [("p", "C")]


def series(spark, values, start=0, kind="k"):
    return spark.createDataFrame([(kind, "S", day(start + i), v) for i, v in enumerate(values)], "kind string, symbol string, date date, value double")


def test_two_alignments_differ_off_calendar(spark):
    spine = spark.createDataFrame([("p", day(0)), ("p", day(2)), ("p", day(4))], "panel_id string, date date")
    source = spark.createDataFrame([(day(1), 7.0), (day(2), None), (day(3), 9.0)], "date date, x double")
    exact = [r.x for r in ordered(align.align_exact(spine, source, ["x"], ["panel_id"]), "date")]
    asof = [r.x for r in ordered(align.align_asof(spine, source, ["x"], ["panel_id"]), "date")]
    rows = [r.x for r in ordered(align.asof_rows(spine, source, ["x"]), "date")]
    assert exact == [0.0, 0.0, 0.0]
    assert rows == [None, None, 9.0]
    assert asof == [0.0, 0.0, 9.0]


def test_trailing_z_includes_the_current_row(spark):
    z = ordered(flows.trailing_z(series(spark, [10.0, 12.0, 14.0, 16.0]), ["kind"], 3, 3), "date")
    assert [r.z for r in z] == [None, None, pytest.approx(1.0), pytest.approx(1.0)]
    flat = ordered(flows.trailing_z(series(spark, [5.0] * 4), ["kind"], 3, 2), "date")
    assert all(r.z is None for r in flat)


def test_tvl_features_fill_before_changes(spark):
    rng = np.random.default_rng(0)
    chain = pd.Series(1000 * np.exp(np.cumsum(rng.normal(0, 0.02, 45))), index=[day(i) for i in range(45)])
    proto = (chain * 0.2 * (1 + 0.1 * rng.random(45))).drop([day(i) for i in (3, 10, 11, 40)])
    frame = lambda s: spark.createDataFrame([("c", d, float(v)) for d, v in s.items()], "chain_id string, date date, value double")
    got = ordered(flows.tvl_features(frame(chain), frame(proto)), "date")
    share = proto.reindex(chain.index).ffill() / chain
    want = pd.DataFrame({"tvl_mom20": chain / chain.shift(20) - 1, "tvl_dd": chain / chain.cummax() - 1,
                         "pancake_share_mom20": share / share.shift(20) - 1})
    for c in want:
        assert np.allclose([np.nan if r[c] is None else r[c] for r in got], want[c], equal_nan=True), c


def test_missing_flow_kind_is_zero(spark):
    spine = spark.createDataFrame([("p", day(i)) for i in range(15)], "panel_id string, date date")
    got = ordered(flows.flow_features(spine, series(spark, [float(i * i) for i in range(15)], kind="whaleflow")), "date")
    assert all(r.net_cex_flow_z == 0.0 for r in got)
    assert got[-1].net_whale_flow_z > 1.0


def test_exchange_flow_counts_both_legs(spark):
    rows = [("t", "2024-01-01 01:00:00", "x", "w", 5.0), ("t", "2024-01-01 02:00:00", "w", "x", 2.0),
            ("t", "2024-01-02 02:00:00", "w", "w", 3.0), ("t", "2024-01-03 02:00:00", "x", "y", 9.0)]
    t = spark.createDataFrame(rows, "token string, ts string, sender string, receiver string, amount double").withColumn("ts", F.to_timestamp("ts"))
    w = spark.createDataFrame([("w",), ("w",)], "address string")
    got = [(r.inflow, r.outflow, r.net_inflow) for r in ordered(flows.exchange_flow(t, w), "date")]
    assert got == [(5.0, 2.0, 3.0), (3.0, 3.0, 0.0)]


def test_attribute_uses_shared_keys_only(spark):
    row = spark.sql("select map('a', 2D, 'b', -1D, 'z', 5D) z, map('a', 1D, 'b', 2D, 'q', 9D) s")
    got = row.select(regime.attribute(F.col("z"), F.col("s")).alias("m")).first().m
    assert got == {"a": pytest.approx(0.5), "b": pytest.approx(-0.5)}
    zero = spark.sql("select map('a', 0D) z, map('a', 1D) s").select(regime.attribute(F.col("z"), F.col("s")).alias("m")).first().m
    assert zero == {"a": 0.0}
