import math

import numpy as np
import pytest
from helpers import day, ordered
from pyspark.sql import functions as F

from panelworks.operators import changepoint, em, hmm, regime
from panelworks.schemas import FEATURES, MODELS, REGIMES


def blocks(seed=0, size=80):
    """Three separable feature blocks: calm-up, quiet, turbulent."""
    rng = np.random.default_rng(seed)
    centres = [(1.0, 0.01, 0.9, 0.02), (0.0, 0.01, 0.5, 0.02), (-0.2, 0.06, 0.3, 0.08)]
    return np.vstack([c + rng.normal(0, 1, (size, 4)) * (0.1, 0.002, 0.05, 0.004) for c in centres])


def features(spark, x, panel_id="p"):
    rows = [(panel_id, i, day(i), *map(float, v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "panel_id string, pos int, date date, " + ", ".join(f"{c} double" for c in FEATURES))


def test_fit_recovers_blocks():
    x = blocks()
    loglik, center, scale, states, trans = hmm.fit_hmm(x, 3, 8, 200, 1e-4, 0)
    assert np.allclose(np.sum(trans, axis=1), 1)
    z = (x - center) / scale
    truth = np.array([z[:80].mean(0), z[80:160].mean(0), z[160:].mean(0)])
    for t in truth:
        assert min(np.abs(t - np.array(s["mu"])).max() for s in states) < 0.1
    assert sum(s["start"] for s in states) == pytest.approx(1.0)


def test_more_restarts_never_lower_the_likelihood():
    x = blocks(3, 40) + np.random.default_rng(1).normal(0, 0.02, (120, 4))
    scores = [hmm.fit_hmm(x, 3, r, 100, 1e-4, 0)[0] for r in (1, 3, 8)]
    assert scores == sorted(scores)


def test_expectation_matches_enumeration():
    rng = np.random.default_rng(0)
    z, k = rng.normal(size=(5, 2)), 2
    start, trans = np.array([[0.3, 0.7]]), np.array([[[0.8, 0.2], [0.4, 0.6]]])
    mu, var = rng.normal(size=(1, k, 2)), np.exp(rng.normal(size=(1, k, 2)))
    pdf = lambda t, s: np.prod(np.exp(-((z[t] - mu[0, s]) ** 2) / (2 * var[0, s])) / np.sqrt(2 * np.pi * var[0, s]))
    total, gamma = 0.0, np.zeros((5, k))
    for code in range(k**5):
        path = [(code >> t) & 1 for t in range(5)]
        p = start[0, path[0]] * pdf(0, path[0])
        for t in range(1, 5):
            p *= trans[0, path[t - 1], path[t]] * pdf(t, path[t])
        total += p
        for t in range(5):
            gamma[t, path[t]] += p
    loglik, got, _ = hmm._expect(z, start, trans, mu, var)
    assert loglik[0] == pytest.approx(math.log(total))
    assert np.allclose(got[0], gamma / total)


def test_reads_are_causal_and_complete(spark):
    x = blocks(5, 35)
    fit = {"n_restarts": 2, "n_iter": 40}
    full = ordered(regime.regime_reads(features(spark, x), min_train=60, refit_every=5, **fit), "pos")
    head = ordered(regime.regime_reads(features(spark, x[:80]), min_train=60, refit_every=5, **fit), "pos")
    assert [r.pos for r in full] == list(range(60, 105))
    assert head == full[: len(head)]
    for r in full:
        assert sum(r.posterior.values()) == pytest.approx(1.0)
        assert r.confidence == pytest.approx(max(r.posterior.values()))
        assert r.posterior[r.regime] == r.confidence
        assert sum(abs(v) for v in r.attribution.values()) == pytest.approx(1.0)
        assert set(r.features) == set(FEATURES)


def test_refit_cadence(spark):
    got = ordered(regime.refit_schedule(features(spark, np.zeros((80, 4))), 60, 5), "pos")
    assert sorted({r.refit_pos for r in got}) == [60, 66, 72, 78]
    jobs = hmm.training_jobs([hmm.PathSpec("a", features(spark, np.zeros((80, 4))))], 60, 5, refits=3)
    assert {(r.path_id, tuple(r.refits), len(r.x)) for r in jobs.collect()} == {("a", (60, 66, 72), 73), ("a", (78,), 79)}


def test_prefixes_trained_together_equal_those_trained_alone():
    x = blocks(7, 30) + np.random.default_rng(2).normal(0, 0.01, (90, 4))
    lengths = [61, 67, 73, 90]
    for n, (loglik, center, _, states, trans) in zip(lengths, hmm.fit_prefixes(x, lengths, 3, 4, 60, 1e-4, 0)):
        alone = hmm.fit_hmm(x[:n], 3, 4, 60, 1e-4, 0)
        assert loglik == pytest.approx(alone[0], abs=1e-5) and np.allclose(center, alone[1])
        assert np.allclose([s["mu"] for s in states], [s["mu"] for s in alone[3]], atol=1e-4) and np.allclose(trans, alone[4], atol=1e-4)


def test_paths_trained_in_one_call_equal_each_alone(spark):
    f = features(spark, blocks(5, 25))
    wide = f.withColumn("flow", F.sin("pos"))
    fit = {"n_restarts": 2, "n_iter": 20}
    specs = [hmm.PathSpec("base", f), hmm.PathSpec("flow", wide, (*FEATURES, "flow"))]
    both = regime.path_reads(specs, **fit)
    for spec in specs:
        alone = ordered(regime.regime_reads(spec.features, spec.path_id, cols=spec.cols, **fit), "pos")
        got = ordered(both.filter(F.col("path_id") == spec.path_id), "pos")
        assert [(r.pos, r.regime) for r in got] == [(r.pos, r.regime) for r in alone] and len(got) == 15
        assert np.allclose([r.confidence for r in got], [r.confidence for r in alone])
        assert set(got[0].features) == set(spec.cols)


def params_of(fitted, refit_pos):
    from panelworks.schemas import FITTED

    return [("p", "m", refit_pos, *fitted)], FITTED


@pytest.mark.parametrize("chunk", [7, 64])
def test_em_step_in_a_plan_equals_the_batch(spark, chunk):
    x = blocks(4, 40)
    center, scale = x.mean(0), x.std(0)
    z = (x - center) / scale
    rng = np.random.default_rng(3)
    start, trans = np.array([[0.5, 0.3, 0.2]]), rng.dirichlet([2, 2, 2], (1, 3))
    mu, var = rng.normal(size=(1, 3, 4)), np.exp(rng.normal(size=(1, 3, 4)))
    loglik, gamma, moves = hmm._expect(z, start, trans, mu, var)
    want = hmm._maximise(z[None], gamma, moves)
    states = [{"start": float(start[0, k]), "mu": mu[0, k].tolist(), "var": var[0, k].tolist()} for k in range(3)]
    given = spark.createDataFrame(*params_of((0.0, center.tolist(), scale.tolist(), states, trans[0].tolist()), len(x) - 1))
    got = em.em_step(features(spark, x), given, chunk=chunk).first()
    assert got.loglik == pytest.approx(loglik[0])
    assert np.allclose([s.start for s in got.states], want[0][0]) and np.allclose(got.trans, want[1][0])
    assert np.allclose([s.mu for s in got.states], want[2][0]) and np.allclose([s["var"] for s in got.states], want[3][0])


def test_em_step_confirms_a_trained_likelihood(spark):
    x = blocks(8, 30)
    fitted = hmm.fit_hmm(x[:70], 3, 4, 80, 1e-4, 0)
    got = em.em_step(features(spark, x), spark.createDataFrame(*params_of(fitted, 69))).first()
    assert got.loglik == pytest.approx(fitted[0])
    again = em.em_steps(features(spark, x), spark.createDataFrame(*params_of(fitted, 69)), 2, chunk=16).first()
    assert again.loglik >= fitted[0] - 1e-9


def test_scaler_prefix(spark):
    x = blocks(1, 30)
    x[:, 2] = 0.5
    got = ordered(regime.scaler_prefix(features(spark, x), 60, 5), "refit_pos")[1]
    assert got.realized_vol_scale == pytest.approx(x[:67, 1].std())
    assert got.breadth_scale == pytest.approx(1.0)


def model(spark, mus, start=(0.2, 0.3, 0.5)):
    states = [(float(s), [float(v) for v in m], [1.0, 0.5, 2.0, 1.0]) for s, m in zip(start, mus)]
    return spark.createDataFrame([("p", "m", 0, 0.0, [0.0] * 4, [1.0] * 4, states)], MODELS)


MUS = [(0.1, -1.0, 0.0, 0.0), (-2.0, 0.5, 0.0, 0.0), (1.0, 3.0, 0.0, 0.0)]


def test_state_labels(spark):
    rows = {r.regime: r.trend_strength for r in regime.signatures(regime.label_states(model(spark, MUS))).collect()}
    assert rows == {"trending": -2.0, "ranging": 0.1, "high_volatility": 1.0}
    tied = [(1.0, 2.0, 0, 0), (1.0, 2.0, 0, 0), (1.0, 2.0, 0, 1)]
    labelled = regime.label_states(model(spark, tied, (0.1, 0.2, 0.7))).first()
    assert [s["start"] for s in labelled.regimes] == [0.2, 0.7, 0.1]


@pytest.mark.parametrize("start", [(0.2, 0.3, 0.5), (0.0, 1.0, 0.0), (1 / 3, 1 / 3, 1 / 3)])
def test_posterior_by_hand(spark, start):
    x = np.array([[0.4, 0.2, -0.3, 1.0]])
    scheduled = features(spark, x).withColumn("refit_pos", F.lit(0))
    got = regime.posterior(scheduled, regime.label_states(model(spark, MUS, start))).first()
    var = np.array([1.0, 0.5, 2.0, 1.0])
    p = [s * np.prod(np.exp(-((x[0] - m) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var)) for s, m in zip(start, MUS)]
    p = np.array(p) / sum(p)
    want = {"trending": p[1], "ranging": p[0], "high_volatility": p[2]}
    for r in REGIMES:
        assert got[f"p_{r}"] == pytest.approx(want[r])


def test_latest_reads_one_row_per_panel(spark):
    f = features(spark, blocks(1, 25)).unionByName(features(spark, blocks(2, 30), "q"))
    got = {r.panel_id: r.pos for r in regime.latest_reads(f, n_restarts=2, n_iter=30).collect()}
    assert got == {"p": 74, "q": 89}


def test_stance(spark):
    df = spark.createDataFrame([("trending", False), ("ranging", False), ("high_volatility", False), ("odd", False), (None, False), ("trending", True)], "r string, o boolean")
    got = [x.s for x in df.select(regime.stance(F.col("r"), F.col("o")).alias("s")).collect()]
    assert got == ["momentum", "market portfolio", "defensive", "market portfolio", "market portfolio", "defensive"]


def test_change_point_spikes_at_a_mean_shift(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 50), rng.normal(5, 1, 50)])
    rows = [(s, i, float(v)) for s in ("a", "b") for i, v in enumerate(x)]
    got = changepoint.change_points(spark.createDataFrame(rows, "series_id string, pos int, x double"))
    for s in ("a", "b"):
        prob = np.array([r.cp_prob for r in ordered(got.filter(F.col("series_id") == s), "pos")])
        assert prob.min() >= 0 and prob.max() <= 1
        assert prob[50:54].max() > 5 * np.median(prob[20:48])


def test_change_points_over_stretches_equal_the_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(s, i, float(v)) for s, n in (("a", 90), ("b", 35), ("c", 61)) for i, v in enumerate(np.concatenate([rng.normal(0, 1, n), rng.normal(4, 1, 20)])) if (s, i) != ("c", 40)]
    series = spark.createDataFrame(rows, "series_id string, pos int, x double")
    whole = {(r.series_id, r.pos): r.cp_prob for r in changepoint.change_points(series).collect()}
    for chunk in (7, 30):
        got = {(r.series_id, r.pos): r.cp_prob for r in changepoint.change_points_chunked(series, chunk).collect()}
        assert got.keys() == whole.keys() and all(got[k] == pytest.approx(whole[k], abs=1e-12) for k in got)
    pruned = {(r.series_id, r.pos): r.cp_prob for r in changepoint.change_points_chunked(series, 30, prune=1e-6).collect()}
    state = {r.series_id: r for r in changepoint.advance(series, prune=1e-6).collect()}
    for k in whole:
        assert pruned[k] == pytest.approx(whole[k], abs=10 * state[k[0]].lost + 1e-9)
    assert all(0 < r.lost < 1e-3 and len(r.run) < 70 for r in state.values())
    assert changepoint.change_points_chunked(series.limit(0)).count() == 0


def test_change_point_underflow_restarts():
    out = changepoint.short_run_mass(np.array([0.0, 1e200, 0.0]), 0.01, 0.0, 1.0, 1.0, 1.0)
    assert np.isfinite(out).all()
