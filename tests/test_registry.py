"""A cross-section of registered queries against their SQL on the smallest tables.

``python tests/compare.py <dir> [names]`` runs all of them.
"""

import pytest
from compare import connect, difference

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [
    "missing_worklist", "align_asof", "cex_flow_daily", "token_resolve", "ohlcv_json_flatten", "top_pool", "bars_store",
    "feature_panel", "posterior_score", "attribution_topk", "w_router", "metrics_bundle", "select_config",
    "em_step", "regime_path_em", "regime_artifact_export", "windows_combinatorial", "deflated_sharpe", "bootstrap_ci", "bocpd", "intents", "execution_plan", "scale_backtest",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_is_callable_and_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(NAMES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got)
    assert difference(got, con.execute(entry.oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
