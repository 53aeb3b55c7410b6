import numpy as np
import pandas as pd
import pytest
from helpers import day, indexed, labels, ordered
from pyspark.sql import functions as F

from panelworks.operators import features, panel, portfolio, runs, weights
from panelworks.operators.weights import RouterConfig


def held(df, pos):
    return {r.symbol: r.w for r in df.filter(F.col("pos") == pos).collect()}


def test_momentum_takes_top_then_keeps_positive(spark):
    p = indexed(spark, {"A": [10, 11, 12], "B": [10, 10, 9], "C": [10, 12, 15], "D": [None, 10, 11]})
    assert held(weights.momentum(p, 2, 2), 2) == {"A": 0.5, "C": 0.5}
    assert held(weights.momentum(p, 2, 3), 2) == {"A": 0.5, "C": 0.5}
    assert held(weights.momentum(p, 2, 2), 1) == {}


def test_ties_keep_column_order(spark):
    p = indexed(spark, {"Z": [1, 2], "A": [1, 2], "M": [1, 2]})
    assert set(held(weights.momentum(p, 1, 2), 1)) == {"Z", "A"}
    assert set(held(weights.mean_reversion(p, 1, 1), 1)) == {"Z"}


def test_mean_reversion_ignores_sign(spark):
    p = indexed(spark, {"A": [10, 30], "B": [10, 20], "C": [10, 15]})
    assert held(weights.mean_reversion(p, 1, 2), 1) == {"B": 0.5, "C": 0.5}


def test_equal_weight_and_defensive(spark):
    p = indexed(spark, {"A": [1, 1, None], "USDT": [1, 1, None], "DAI": [None, 1, None], "X": [1, 1, 1]})
    assert held(weights.equal_weight(p), 0) == {"A": pytest.approx(1 / 3), "USDT": pytest.approx(1 / 3), "X": pytest.approx(1 / 3)}
    assert held(weights.defensive(p), 1) == {"USDT": 0.5, "DAI": 0.5}
    assert held(weights.defensive(p), 2) == {}


def flags(spark, values, fn, flag, **kw):
    rows = [("S", day(i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol string, date date, value double")
    return ordered(fn(df, **kw), "date")[-1][flag]


@pytest.mark.parametrize(
    ("values", "keep"),
    [
        ([10.0] * 7 + [2.0] * 7, False),
        ([10.0] * 7 + [5.0] * 7, True),
        ([10.0] * 7 + [20.0] * 7, True),
        ([0.0] * 7 + [0.0] * 7, True),
        ([10.0] * 6 + [1.0] * 7, True),
        ([10.0, None] * 7 + [1.0] * 7, False),
    ],
)
def test_volume_confirmation(spark, values, keep):
    assert flags(spark, values, weights.volume_signal, "keep") is keep


@pytest.mark.parametrize(
    ("values", "veto"),
    [
        ([1.0, 2.0, 3.0, 2.0, 1.0, 2.0, 3.0] + [2.0] * 6 + [50.0], True),
        ([1.0, 2.0, 3.0, 2.0, 1.0, 2.0, 3.0] + [2.0] * 7, False),
        ([0.0] * 13 + [50.0], False),
        ([4.0] * 13 + [12.0], False),
        ([4.0] * 13 + [12.5], True),
        ([4.0] * 12 + [50.0], False),
    ],
)
def test_inflow_veto(spark, values, veto):
    assert flags(spark, values, weights.inflow_signal, "veto") is veto


def test_confirmation_drops_only_vetoed_names(spark):
    n = 20
    p = indexed(spark, {"A": list(range(10, 10 + n)), "B": list(range(10, 10 + 2 * n, 2)), "C": [5.0] * n})
    base = weights.momentum(p, 2, 2)
    vol = spark.createDataFrame([("A", day(i), 10.0 if i < 7 else 1.0) for i in range(14)], "symbol string, date date, value double")
    got = weights.confirmed(base, vol)
    assert held(got, 5) == {"A": 0.5, "B": 0.5}
    assert held(got, 15) == {"B": 1.0}
    spike = spark.createDataFrame([("B", day(i), 4.0 if i < 13 else 99.0) for i in range(14)], "symbol string, date date, value double")
    assert held(weights.confirmed(base, vol, spike), 15) == {}
    assert held(weights.confirmed(base, None, spike), 15) == {"A": 1.0}
    assert held(weights.confirmed(base), 15) == {"A": 0.5, "B": 0.5}


def test_gate_sequences(spark):
    raw = [c == "T" for c in "FFTFTTTFTFFF"]
    rows = [("p", i, v) for i, v in enumerate(raw)]
    df = spark.createDataFrame(rows, "panel_id string, pos int, risk_off boolean")
    gate = lambda k: [int(r.gate) for r in ordered(runs.confirmed_gate(df, ["panel_id"], k), "pos")]
    assert gate(2) == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 0, 0]
    assert gate(3) == [0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 0]
    assert gate(1) == [int(v) for v in raw]


def loop_hysteresis(seq, h, default="ranging"):
    out, active, last, streak = [], default, None, 0
    for lab in seq:
        streak = streak + 1 if lab == last else 1
        last = lab
        if streak >= h:
            active = lab
        out.append(active)
    return out


def test_hysteresis_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    seq = [str(x) for x in rng.choice(["trending", "ranging", "high_volatility"], 120, p=[0.6, 0.2, 0.2])]
    got = [r.active for r in ordered(runs.hysteresis(labels(spark, seq), ["panel_id", "path_id"], 3), "pos")]
    assert got == loop_hysteresis(seq, 3)


def test_bands(spark):
    seq = [None, None, "trending", "trending", "ranging", None, "ranging"]
    got = [(r.regime, r.n_days) for r in ordered(runs.bands(labels(spark, seq), ["panel_id"]), "from_date")]
    assert got == [("unclassified", 2), ("trending", 2), ("ranging", 1), ("unclassified", 1), ("ranging", 1)]


def route_all(spark, p, path, gates, configs):
    cal = p.select("panel_id", "pos", "date", "n_dates").distinct()
    held_ = weights.equal_weight(p).unionByName(weights.momentum(p, 1, 1)).unionByName(weights.defensive(p))
    active = weights.active_strategies(cal, path, gates, configs)
    return active, weights.route(active, held_)


def test_router_slots(spark):
    p = features.forward_returns(indexed(spark, {"A": [1, 2, 3, 4, 5, 6], "USDT": [1] * 6}))
    path = labels(spark, ["trending"] * 6).filter("pos >= 2")
    gates = p.select("panel_id", "pos").distinct().withColumn("risk_off", F.col("pos").isin(0, 5))
    configs = [RouterConfig("g", "a", gated=True, hysteresis=2), RouterConfig("u", "a", hysteresis=2), RouterConfig("f", fixed="equal_weight")]
    active, routed = route_all(spark, p, path, gates, configs)
    got = {(r.config_id, r.pos): r.strategy for r in active.collect()}
    # The gate acts before the path starts; unlabelled dates are cash otherwise.
    assert [got["g", i] for i in range(6)] == ["defensive", None, "equal_weight", "momentum", "momentum", "defensive"]
    assert [got["u", i] for i in range(6)] == [None, None, "equal_weight", "momentum", "momentum", "momentum"]
    assert {got["f", i] for i in range(6)} == {"equal_weight"}
    assert {(r.symbol, r.w) for r in routed.filter("config_id='g' and pos=0").collect()} == {("USDT", 1.0)}


def loop_backtest(px, w, fee=15e-4):
    """Day loop over a wide price frame and a wide frame of decided weights."""
    prev, equity, rows = pd.Series(0.0, px.columns), 10_000.0, [(None, None, 10_000.0)]
    for t in range(1, len(px)):
        now = w.iloc[t - 1]
        turn = (now - prev).abs().sum()
        net = (now * (px.iloc[t] / px.iloc[t - 1] - 1).fillna(0.0)).sum() - turn * fee
        equity *= 1 + net
        rows.append((turn, net, equity))
        prev = now
    return rows


def test_accounting_equals_a_day_loop(spark):
    from test_features import random_panel, wide

    cols = random_panel(n=60, names=5, seed=11)
    p = indexed(spark, cols)
    px = wide(cols)
    mine = weights.momentum(p, 5, 2)
    decided = pd.DataFrame(0.0, px.index, px.columns)
    for r in mine.collect():
        decided.loc[r.date, r.symbol] = r.w
    named = portfolio.with_forward_returns(mine.withColumnRenamed("strategy", "config_id"), p)
    carried = weights.momentum(features.forward_returns(p), 5, 2).withColumnRenamed("strategy", "config_id")
    days = portfolio.spine(panel.calendar(p), ["momentum"])
    want = loop_backtest(px, decided)
    for held_ in (named, carried):
        got = ordered(portfolio.daily_accounting(held_, days), "pos")
        assert [g.turnover for g in got] == [w[0] if w[0] is None else pytest.approx(w[0]) for w in want]
        assert [g.ret for g in got] == [w[1] if w[1] is None else pytest.approx(w[1]) for w in want]
        assert [g.equity for g in got] == [pytest.approx(w[2]) for w in want]


def test_metrics_by_hand(spark):
    from helpers import returns

    df = returns(spark, {"c": [None, 0.1, -0.2, 0.05, 0.0, -0.1]})
    df = df.withColumns({"turnover": F.when(F.col("pos") > 0, F.lit(0.4)), "cost": F.lit(0.0)})
    w = portfolio.by_config()
    df = df.withColumn("equity", 100.0 * F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w))
    df = df.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)
    m = portfolio.metrics(df).first()
    r = np.array([0.1, -0.2, 0.05, 0.0, -0.1])
    assert m.sharpe == pytest.approx(np.sqrt(365) * r.mean() / r.std(ddof=1))
    assert m.sortino == pytest.approx(np.sqrt(365) * r.mean() / np.array([-0.2, -0.1]).std(ddof=1))
    assert m.win_rate == pytest.approx(0.4)
    assert m.max_drawdown == pytest.approx(0.8 * 1.05 * 0.9 - 1)
    assert m.turnover == pytest.approx(0.4)
    flat = portfolio.metrics(df.withColumn("ret", F.lit(0.0))).first()
    assert (flat.sharpe, flat.sortino, flat.win_rate) == (0.0, 0.0, 0.0)


def test_regime_pnl_buckets(spark):
    from helpers import returns

    df = returns(spark, {"c": [None, 0.10, 0.02, -0.05, 0.01]})
    path = labels(spark, ["trending", "trending", "trending", "ranging"])
    got = {r.regime: r for r in portfolio.regime_pnl(df, path).collect()}
    assert got["trending"].total_return == pytest.approx(1.10 * 1.02 - 1)
    assert (got["trending"].days, got["ranging"].days, got["unclassified"].days) == (2, 1, 1)
    assert sum(r.share_of_pnl for r in got.values()) == pytest.approx(1.0)
