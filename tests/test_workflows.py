import numpy as np
import pytest
from helpers import labels, prices
from pyspark.sql import functions as F

from panelworks.operators.weights import RouterConfig
from panelworks.plans import workflows


def walk(n, seed, names=3):
    rng = np.random.default_rng(seed)
    return {f"S{k}": [float(v) for v in 100 * np.exp(np.cumsum(rng.normal(0.001, 0.02, n)))] for k in range(names)}


def test_comparison_then_validation(spark):
    panels = prices(spark, walk(90, 1)).unionByName(prices(spark, {"X": [1.0]}, "lone"))
    seq = ["trending" if (i // 7) % 2 else "ranging" for i in range(90)]
    path = labels(spark, seq).filter("pos >= 20")
    configs = [RouterConfig("gated", "a", gated=True), RouterConfig("free", "a"), RouterConfig("market", fixed="equal_weight")]
    out = workflows.strategy_comparison(panels, configs, path)
    daily = out["daily"].toPandas()
    assert set(daily.panel_id) == {"p"}
    assert len(daily) == 3 * 90
    totals = {r.config_id: r.total_return for r in out["metrics"].collect()}
    for c, g in daily.sort_values("pos").groupby("config_id"):
        assert np.isclose(totals[c], np.prod(1 + g.ret.dropna()) - 1)
    assert {r.days for r in out["regime_pnl"].groupBy("config_id").agg(F.sum("days").alias("days")).collect()} == {89}

    report = workflows.out_of_sample(out["daily"], out["calendar"], ["gated", "free"], 3, 5, n_boot=50)
    picked = report["selected"].first().selected
    assert picked in ("gated", "free")
    assert [r.config_id for r in report["deflated_sharpe"].collect()] == [picked]
    assert [r.config_id for r in report["intervals"].collect()] == [picked]
    assert report["per_config"].count() == 3


def test_latest_read_with_extra_features(spark):
    panels = prices(spark, walk(70, 2)).unionByName(prices(spark, walk(64, 3), "q"))
    dates = panels.select("date").distinct()
    extra = dates.select("date", (F.dayofyear("date") % 5).cast("double").alias("flow"))
    got = workflows.latest_read(panels, extra, ("flow",), n_restarts=2, n_iter=20).collect()
    assert {r.panel_id: r.pos for r in got} == {"p": 69, "q": 63}
    assert all("flow" in r.features and r.stance for r in got)


def test_walk_forward_path_is_trained_when_absent(spark):
    out = workflows.strategy_comparison(prices(spark, walk(66, 4)), [RouterConfig("free")])
    assert out["path"].count() == 6
    assert out["label_counts"].agg(F.sum("days")).first()[0] == 6


def test_paths_of_several_feature_sets_are_routed_side_by_side(spark):
    panels = prices(spark, walk(66, 4))
    extra = panels.select("date").distinct().select("date", (F.dayofyear("date") % 5).cast("double").alias("flow"))
    configs = [RouterConfig("free"), RouterConfig("fused", path_id="flow"), RouterConfig("market", fixed="equal_weight")]
    out = workflows.strategy_comparison(panels, configs, extra_paths={"flow": (extra, ("flow",))})
    assert {(r.path_id, r["count"]) for r in out["path"].groupBy("path_id").count().collect()} == {("baseline", 6), ("flow", 6)}
    assert {r.config_id for r in out["metrics"].collect()} == {"free", "fused", "market"}


def test_unknown_names_raise_and_own_strategies_need_no_returns(spark):
    panels = prices(spark, walk(40, 5))
    path = labels(spark, ["ranging"] * 40)
    for bad in (RouterConfig("c", "a", slots={"trending": "momentun", "ranging": "momentum", "high_volatility": "defensive"}),
                RouterConfig("c", "b"), RouterConfig("c", fixed="mine")):
        with pytest.raises(ValueError):
            workflows.strategy_comparison(panels, [bad], path)
    own = spark.range(40).selectExpr("'p' panel_id", "'mine' strategy", "CAST(id AS INT) pos", "date_add(DATE'2024-01-01', CAST(id AS INT)) date", "'S0' symbol", "1D w")
    out = workflows.strategy_comparison(panels, [RouterConfig("own", fixed="mine")], path, extra_strategies=own, fee_bps=0.0, slippage_bps=0.0)
    closes = walk(40, 5)["S0"]
    assert np.isclose(out["metrics"].first().total_return, closes[-1] / closes[0] - 1)
