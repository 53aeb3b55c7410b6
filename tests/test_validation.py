import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest
from helpers import calendar, ordered, returns
from pyspark.sql import functions as F

from panelworks.functions.normal import phi, phi_inv
from panelworks.operators import bootstrap, states, validation, windows


def members(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.window_id, r.role), set()).add(r.pos)
    return out


@pytest.mark.parametrize("n", [100, 103, 5])
def test_walk_forward_windows(spark, n):
    k, embargo, got = 6, 5, members(windows.walk_forward_windows(calendar(spark, n), 6, 5))
    win = n // k
    want = {}
    for i in range(k if win else 0):
        start = n - win * k + i * win
        want[i, "test"] = set(range(start, start + win))
        if start - embargo > 0:
            want[i, "train"] = set(range(start - embargo))
    assert got == want


@pytest.mark.parametrize(("n", "groups", "test", "embargo"), [(100, 6, 2, 5), (103, 5, 3, 2), (30, 4, 1, 0)])
def test_combinatorial_windows(spark, n, groups, test, embargo):
    got = members(windows.combinatorial_windows(calendar(spark, n), groups, test, embargo))
    size = n // groups
    head = n - size * groups
    for i, combo in enumerate(itertools.combinations(range(groups), test)):
        tests, near = set(), set()
        for g in combo:
            lo, hi = head + g * size, head + (g + 1) * size
            tests |= set(range(lo, hi))
            near |= set(range(lo - embargo, hi + embargo))
        assert got[i, "test"] == tests
        assert got.get((i, "train"), set()) == set(range(n)) - tests - near


def test_invalid_windows_are_empty(spark):
    assert windows.walk_forward_windows(calendar(spark, 10), 0).count() == 0
    assert windows.combinatorial_windows(calendar(spark, 10), 3, 4).count() == 0


def test_window_slice_total(spark):
    r = returns(spark, {"c": [None, 0.01, -0.02, 0.03, 0.0, 0.05]})
    w = calendar(spark, 6).filter("pos between 1 and 3").select("panel_id", "pos", "date", F.lit(0).alias("window_id"), F.lit("test").alias("role"))
    m = validation.evaluate_windows(r, w).first()
    assert m.total_return == pytest.approx(1.01 * 0.98 * 1.03 - 1)
    assert m.max_drawdown == pytest.approx(-0.02)
    assert m.n_days == 3


def test_empty_windows_stay_as_zeros(spark):
    r = returns(spark, {"c": [None] * 6 + [0.1] * 6})
    got = ordered(validation.evaluate_windows(r, windows.walk_forward_windows(calendar(spark, 12), 2, 0)), "window_id")
    assert [(g.n_days, g.sharpe) for g in got] == [(0, 0.0), (6, 0.0)]


def test_selection_picks_the_best_training_config(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(0, 0.001, 90)
    early = [None] + [(0.01 if i < 45 else -0.01) + noise[i] for i in range(1, 90)]
    late = [None] + [(-0.01 if i < 45 else 0.01) + noise[i] for i in range(1, 90)]
    r = returns(spark, {"A": early, "B": late, "C": early})
    folds = windows.walk_forward_windows(calendar(spark, 90), 3, 5)
    sel = ordered(validation.select_config(r, folds, ["A", "B", "C"]), "window_id")
    # Window 0 has no training rows; ties between A and C go to A.
    assert [(s.window_id, s.chosen) for s in sel] == [(1, "A"), (2, "A")]
    flipped = ordered(validation.select_config(r, folds, ["C", "B", "A"]), "window_id")
    assert {s.chosen for s in flipped} == {"C"}
    oos = validation.oos_aggregate(validation.select_config(r, folds, ["A", "B", "C"]), 3).first()
    assert oos.sharpe == pytest.approx(np.mean([s.sharpe for s in sel]))
    assert oos.n_trials == 3


def test_modal_variant_ties_and_default(spark):
    sel = spark.createDataFrame([("p", "b"), ("p", "a"), ("q", "b"), ("q", "b"), ("q", "a")], "panel_id string, chosen string")
    panels = spark.createDataFrame([("p",), ("q",), ("r",)], "panel_id string")
    assert dict(validation.modal_variant(sel, panels, "z").collect()) == {"p": "a", "q": "b", "r": "z"}


def test_expected_max_sharpe_constants(spark):
    df = spark.createDataFrame([(1,), (2,), (5,), (10,)], "n int")
    got = [r.v for r in ordered(df.select("n", validation.expected_max_sharpe(F.col("n"), F.lit(0.01)).alias("v")), "n")]
    assert got == [0.0, pytest.approx(0.051976, abs=1e-6), pytest.approx(0.119259, abs=1e-6), pytest.approx(0.157460, abs=1e-6)]


def test_probabilistic_sharpe_edges(spark):
    cases = [(0.1, 0.1, 100, 0.0, 3.0), (0.1, 0.0, 1, 0.0, 3.0), (1.0, 0.0, 50, 9.0, 3.0), (0.2, 0.1, 101, 0.0, 3.0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, sr double, b double, n int, s double, k double")
    p = validation.probabilistic_sharpe(*[F.col(c) for c in ("sr", "b", "n", "s", "k")])
    got = [r.p for r in ordered(df.select("i", p.alias("p")), "i")]
    z = 0.1 * math.sqrt(100) / math.sqrt(1 + 0.5 * 0.04)
    assert got == [pytest.approx(0.5), 0.0, 0.0, pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))))]


def test_phi_round_trip(spark):
    df = spark.createDataFrame([(-2.5,), (0.0,), (1.3,), (None,)], "z double")
    rows = df.select("z", phi_inv(phi("z")).alias("back")).collect()
    assert all(r.back == pytest.approx(r.z) if r.z is not None else r.back is None for r in rows)


def test_normal_functions_are_exact_columns(spark):
    z = [float(x) for x in np.linspace(-38, 38, 501)] + [7.0710678, -7.0710679]
    p = [float(x) for x in np.concatenate([np.logspace(-300, -1, 200), np.linspace(0.001, 0.999, 200)])]
    below = spark.createDataFrame([(x,) for x in z], "x double").select("x", phi("x").alias("y"))
    for r in below.collect():
        assert r.y == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=0, abs=1e-15)
    for r in spark.createDataFrame([(x,) for x in [*p, 0.0, 1.0, 2.0]], "x double").select("x", phi_inv("x").alias("y")).collect():
        assert r.y is None if not 0 < r.x < 1 else r.y == pytest.approx(NormalDist().inv_cdf(r.x), rel=1e-12, abs=1e-12)
    plan = validation.deflated_sharpe(returns(spark, {"a": [None, 0.1, 0.2], "b": [None, 0.2, -0.1]}), ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_deflated_sharpe_moments(spark):
    rng = np.random.default_rng(5)
    x = {k: [None] + list(rng.normal(0.001, 0.01, 200)) for k in ("a", "b")}
    x["flat"] = [None] + [0.0] * 200
    got = {r.config_id: r for r in validation.deflated_sharpe(returns(spark, x), ["a", "b", "flat"]).collect()}
    r = np.array(x["a"][1:])
    c = r - r.mean()
    assert got["a"].sr == pytest.approx(r.mean() / r.std(ddof=1))
    assert got["a"].skew == pytest.approx((c**3).mean() / r.std() ** 3)
    assert got["a"].kurt == pytest.approx((c**4).mean() / r.std() ** 4)
    assert got["flat"].dsr == 0.0
    assert 0 < got["a"].dsr < 1
    lone = validation.deflated_sharpe(returns(spark, x), ["a"]).first()
    assert lone.sr_var == 1e-12 and lone.benchmark == 0.0


@pytest.mark.parametrize(("n", "block"), [(23, 5), (20, 5), (4, 10), (1, 3)])
def test_block_sums_equal_expanded_paths(spark, n, block):
    rng = np.random.default_rng(n)
    values = [None] + list(rng.normal(0, 0.05, n))
    r = returns(spark, {"c": values})
    paths = bootstrap.bootstrap_paths(r, 30, block, seed=4)
    by_path = {}
    for row in paths.collect():
        by_path.setdefault(row.b, {})[row.j] = row.ret
    assert len(by_path) == 30
    series = values[1:]
    for p in by_path.values():
        assert sorted(p) == list(range(n))
        for j in range(n):
            if j % block:
                here, before = series.index(p[j]), series.index(p[j - 1])
                assert here == (before + 1) % n
    for row in bootstrap.bootstrap_metrics(r, 30, block, seed=4).collect():
        x = np.array([by_path[row.b][j] for j in range(n)])
        assert row.total_return == pytest.approx(np.prod(1 + x) - 1)
        sd = x.std(ddof=1) if n > 1 else 0.0
        assert row.sharpe == pytest.approx(np.sqrt(365) * x.mean() / sd if sd > 1e-12 else 0.0, rel=1e-9)
        equity = np.cumprod(1 + x)
        assert row.max_drawdown == pytest.approx((equity / np.maximum.accumulate(equity) - 1).min())
        down = x[x < 0].std(ddof=1) if (x < 0).sum() > 1 else 0.0
        assert row.sortino == pytest.approx(np.sqrt(365) * x.mean() / down if down > 1e-12 else 0.0, rel=1e-9)
    plan = bootstrap.bootstrap_metrics(r, 30, block)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_bootstrap_interval_is_ordered_and_repeatable(spark):
    rng = np.random.default_rng(2)
    r = returns(spark, {"c": [None] + list(rng.normal(0.001, 0.02, 60))})
    one = bootstrap.bootstrap_ci(r, 200, 10).first()
    again = bootstrap.bootstrap_ci(r, 200, 10).first()
    # Same draws; sums may be merged in another order.
    assert list(again)[2:] == pytest.approx(list(one)[2:], rel=1e-9)
    assert one.sharpe_lo < one.sharpe < one.sharpe_hi


def test_states_merge_to_the_whole(spark):
    rng = np.random.default_rng(9)
    runs = [[], [0.1], [-1.0, 0.5], [0.0, 0.0], list(rng.normal(0, 0.05, 9)), [-0.02, -0.02], list(rng.normal(0.01, 0.1, 30))]
    pairs = [(i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(itertools.product(runs, runs))]
    df = spark.createDataFrame(pairs, "i int, a array<double>, b array<double>")
    both = states.merge(states.of_returns(F.col("a")), states.of_returns(F.col("b")))
    whole = states.of_returns(F.concat("a", "b"))
    for r in df.select(both.alias("x"), whole.alias("y"), F.concat("a", "b").alias("r")).collect():
        assert list(r.x) == pytest.approx(list(r.y), abs=1e-12)
        if r.r:
            e = np.cumprod(1 + np.array(r.r))
            top = np.maximum.accumulate(e)
            assert r.x.worst == pytest.approx(min((e[top > 0] / top[top > 0] - 1).min(initial=0), 0)) and r.x.growth == pytest.approx(e[-1])


def test_window_metrics_read_each_return_once(spark):
    """Work per return does not depend on the number of windows: overlapping windows share segments."""
    folds = windows.combinatorial_windows(calendar(spark, 60), 6, 2, 2)
    pieces = validation.segments(folds)
    assert pieces.count() == pieces.select("pos").distinct().count() and pieces.agg(F.max("segment")).first()[0] <= 6 * 5
