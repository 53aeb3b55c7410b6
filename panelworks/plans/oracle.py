"""Reference SQL for the registered queries, as shared common table expressions.

The SQL is written independently of the Spark plans: it builds dense grids, shifts
rows and joins ranges where the plans work on sparse rows and positions.
"""

from __future__ import annotations

import re

from ..schemas import FEATURES
from .standins import APART, CONFIGS, MOVE, PATHS, STAY

_ORDER = ("high_volatility", "ranging", "trending")


def _configs() -> str:
    rows = []
    for i, c in enumerate(CONFIGS):
        fixed = f"'{c.fixed}'" if c.fixed else "NULL"
        rows.append(
            f"('{c.config_id}', {i}, '{c.path_id}', {str(c.gated).lower()}, {c.confirm}, {c.hysteresis}, "
            f"'{c.slots['trending']}', '{c.slots['ranging']}', '{c.slots['high_volatility']}', {fixed})"
        )
    return ", ".join(rows)


def _models() -> str:
    """Class-conditional models, one row per refit, as wide columns."""
    w = "(PARTITION BY f.panel_id ORDER BY f.pos ROWS UNBOUNDED PRECEDING)"
    cols = []
    for c in FEATURES:
        cols.append(f"avg(f.{c}) OVER {w} AS m_{c}")
        cols.append(f"CASE WHEN stddev_pop(f.{c}) OVER {w} > 0 THEN stddev_pop(f.{c}) OVER {w} ELSE 1e0 END AS s_{c}")
    for r in _ORDER:
        cols.append(f"count(CASE WHEN l.regime = '{r}' THEN 1 END) OVER {w} AS n_{r}")
        for c in FEATURES:
            own = f"CASE WHEN l.regime = '{r}' THEN f.{c} END"
            cols.append(f"avg({own}) OVER {w} AS m_{r}_{c}")
            cols.append(f"var_pop({own}) OVER {w} AS v_{r}_{c}")
    return (
        f"SELECT f.panel_id, f.pos AS refit_pos, {', '.join(cols)} FROM feats f "
        "LEFT JOIN path l ON l.panel_id = f.panel_id AND l.pos = f.pos AND l.path_id = 'baseline'"
    )


def _model_states() -> str:
    parts = []
    for k, r in enumerate(_ORDER):
        mu = ", ".join(f"coalesce((m_{r}_{c} - m_{c}) / s_{c}, 0e0) AS mu_{c}" for c in FEATURES)
        var = ", ".join(f"coalesce(v_{r}_{c} / s_{c} / s_{c}, 1e0) + 1e-2 AS var_{c}" for c in FEATURES)
        parts.append(
            f"SELECT panel_id, refit_pos, {k} AS state, "
            f"(n_{r} + 1e0) / (n_high_volatility + n_ranging + n_trending + 3e0) AS start, {mu}, {var} "
            "FROM prefix_models WHERE refit_pos >= 60 AND (refit_pos - 60) % 6 = 0"
        )
    return " UNION ALL ".join(parts)


_Z = ", ".join(f"(f.{c} - m.m_{c}) / m.s_{c} AS z_{c}" for c in FEATURES)
_FIT = " + ".join(
    f"ln(2e0 * pi() * s.var_{c}) + (z.z_{c} - s.mu_{c}) * (z.z_{c} - s.mu_{c}) / s.var_{c}" for c in FEATURES
)
_PATHS = ", ".join(f"('{k}', {v}e0)" for k, v in PATHS.items())

CTES = {
    "ship": "SELECT l.*, p.p_brand AS symbol FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey",
    "sold": """
        SELECT 'brands' AS panel_id, symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
               CAST(date_diff('day', DATE '1990-01-01', CAST(date_trunc('week', l_shipdate) AS DATE)) // 7 AS INTEGER) AS period,
               sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, sum(l_quantity) AS units
        FROM ship GROUP BY ALL
        UNION ALL
        SELECT 'nation_' || s_nationkey, symbol, CAST(date_trunc('month', l_shipdate) AS DATE),
               CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER),
               sum(CAST(round(l_extendedprice * 100) AS BIGINT)), sum(l_quantity)
        FROM ship JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
    "prices": """
        SELECT panel_id, symbol, CAST(substr(symbol, 7) AS INTEGER) AS ord, date,
               CAST(sum(cents) OVER w AS DOUBLE) / 1e2 / sum(units) OVER w AS close
        FROM sold WINDOW w AS (PARTITION BY panel_id, symbol ORDER BY period RANGE BETWEEN 7 PRECEDING AND CURRENT ROW)""",
    "cal": """
        SELECT panel_id, date, count(*) AS n_names,
               row_number() OVER (PARTITION BY panel_id ORDER BY date) - 1 AS pos,
               count(*) OVER (PARTITION BY panel_id) AS n_dates
        FROM prices GROUP BY panel_id, date""",
    "dense": """
        SELECT c.panel_id, n.symbol, n.ord, c.pos, c.date, c.n_dates, c.n_names, p.close
        FROM cal c JOIN (SELECT DISTINCT panel_id, symbol, ord FROM prices) n ON n.panel_id = c.panel_id
        LEFT JOIN prices p ON p.panel_id = c.panel_id AND p.symbol = n.symbol AND p.date = c.date""",
    "rets": """
        SELECT *, close / lag(close, 1) OVER w - 1 AS ret, close / lag(close, 20) OVER w - 1 AS cum,
               close / lag(close, 30) OVER w - 1 AS mom, close / lag(close, 10) OVER w - 1 AS rev,
               first_value(close IGNORE NULLS) OVER (PARTITION BY panel_id, symbol ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_close
        FROM dense WINDOW w AS (PARTITION BY panel_id, symbol ORDER BY pos)""",
    "mkt": """
        SELECT panel_id, pos, date, avg(ret) AS market_return,
               count(CASE WHEN cum > 0 THEN 1 END) / nullif(CAST(count(cum) AS DOUBLE), 0) AS breadth,
               stddev_pop(cum) AS dispersion, avg(close / first_close) AS index_value
        FROM rets GROUP BY panel_id, pos, date""",
    "feat_raw": """
        SELECT *, CASE WHEN count(market_return) OVER w = 20 THEN stddev_pop(market_return) OVER w END AS realized_vol,
               CASE WHEN count(market_return) OVER w = 20 AND stddev_pop(market_return) OVER w > 0
                    THEN avg(market_return) OVER w / stddev_pop(market_return) OVER w ELSE 0e0 END AS trend_strength
        FROM mkt WINDOW w AS (PARTITION BY panel_id ORDER BY pos ROWS 19 PRECEDING)""",
    "feats": "SELECT panel_id, pos, date, "
    + ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER w, 0) AS {c}" for c in FEATURES)
    + " FROM feat_raw WINDOW w AS (PARTITION BY panel_id ORDER BY pos ROWS UNBOUNDED PRECEDING)",
    "risk_stats": """
        SELECT panel_id, pos, date, index_value, index_value / max(index_value) OVER w - 1 AS drawdown,
               CASE WHEN count(index_value) OVER w >= 50 THEN avg(index_value) OVER
                   (PARTITION BY panel_id ORDER BY pos ROWS 49 PRECEDING) END AS moving_average
        FROM mkt WHERE index_value IS NOT NULL
        WINDOW w AS (PARTITION BY panel_id ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
    "risk": """
        SELECT *, drawdown < -0.1e0 OR coalesce(index_value < moving_average, false) AS risk_off FROM risk_stats""",
    "expanding": """
        SELECT *, avg(realized_vol) OVER w AS rv_mean, avg(abs(trend_strength)) OVER w AS tr_mean
        FROM feats WINDOW w AS (PARTITION BY panel_id ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
    "path": f"""
        SELECT panel_id, path_id, pos, date,
               CASE WHEN realized_vol > rv_mean * scale * 1.25e0 THEN 'high_volatility'
                    WHEN abs(trend_strength) > tr_mean * scale THEN 'trending' ELSE 'ranging' END AS regime
        FROM expanding, (VALUES {_PATHS}) AS s(path_id, scale) WHERE pos >= 30""",
    "configs": f"""
        SELECT * FROM (VALUES {_configs()}) AS c(config_id, config_ord, path_id, gated, confirm, hysteresis,
            s_trending, s_ranging, s_high_volatility, fixed)""",
    "side": """
        SELECT * FROM (
          SELECT 'dexvol' AS kind, symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, sum(l_quantity) AS value
          FROM ship GROUP BY ALL
          UNION ALL
          SELECT 'whaleflow', symbol, CAST(date_trunc('week', l_shipdate) AS DATE), sum(l_quantity)
          FROM ship WHERE l_quantity >= 40 GROUP BY ALL
          UNION ALL
          SELECT 'cexflow', symbol, CAST(date_trunc('week', l_shipdate) AS DATE),
                 sum(CASE l_returnflag WHEN 'R' THEN l_quantity WHEN 'A' THEN -l_quantity ELSE 0 END)
          FROM ship GROUP BY ALL)""",
    "part_prices": """
        SELECT CAST(l_partkey AS VARCHAR) AS symbol, l_partkey AS ord, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 1e2 / sum(l_quantity) AS close
        FROM lineitem GROUP BY ALL""",
    "part_cal": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) AS n_names FROM part_prices GROUP BY date",
    "part_dense": """
        SELECT n.symbol, n.ord, c.pos, c.date, c.n_names, p.close FROM part_cal c
        CROSS JOIN (SELECT DISTINCT symbol, ord FROM part_prices) n
        LEFT JOIN part_prices p ON p.symbol = n.symbol AND p.date = c.date""",
    "part_rets": """
        SELECT *, close / lag(close, 1) OVER w - 1 AS ret, close / lag(close, 20) OVER w - 1 AS cum,
               close / lag(close, 30) OVER w - 1 AS mom
        FROM part_dense WINDOW w AS (PARTITION BY symbol ORDER BY pos)""",
    "part_top": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY mom DESC, ord) AS rk
                       FROM part_rets WHERE mom IS NOT NULL) WHERE rk <= 5 AND mom > 0""",
    "part_w": """
        SELECT 'momentum' AS config_id, pos, symbol, 1e0 / count(*) OVER (PARTITION BY pos) AS w FROM part_top
        UNION ALL SELECT 'equal_weight', pos, symbol, 1e0 / n_names FROM part_dense WHERE close IS NOT NULL""",
    "part_acct": """
        SELECT c.config_id, r.pos, r.date, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS turnover,
               sum(coalesce(a.w, 0) * coalesce(r.ret, 0)) AS gross
        FROM part_rets r CROSS JOIN (VALUES ('momentum'), ('equal_weight')) AS c(config_id)
        LEFT JOIN part_w a ON a.config_id = c.config_id AND a.symbol = r.symbol AND a.pos = r.pos - 1
        LEFT JOIN part_w b ON b.config_id = c.config_id AND b.symbol = r.symbol AND b.pos = r.pos - 2
        GROUP BY ALL""",
    "w_equal": "SELECT panel_id, pos, date, symbol, 1e0 / n_names AS w FROM dense WHERE close IS NOT NULL",
    "w_mom_top": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY panel_id, pos ORDER BY mom DESC, ord) AS rk
                       FROM rets WHERE mom IS NOT NULL) WHERE rk <= 3 AND mom > 0""",
    "w_mom": """
        SELECT panel_id, pos, date, symbol, 1e0 / count(*) OVER (PARTITION BY panel_id, pos) AS w FROM w_mom_top""",
    "w_rev_top": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY panel_id, pos ORDER BY rev, ord) AS rk
                       FROM rets WHERE rev IS NOT NULL) WHERE rk <= 5""",
    "w_rev": """
        SELECT panel_id, pos, date, symbol, 1e0 / count(*) OVER (PARTITION BY panel_id, pos) AS w FROM w_rev_top""",
    "w_def": """
        SELECT panel_id, pos, date, symbol, 1e0 / count(*) OVER (PARTITION BY panel_id, pos) AS w
        FROM dense WHERE close IS NOT NULL AND symbol IN ('Brand#1', 'Brand#2')""",
    "vol_sig": """
        SELECT symbol, date, NOT coalesce(n >= 14 AND prior > 0 AND recent / prior < 0.5e0, false) AS keep FROM (
          SELECT symbol, date, count(*) OVER (PARTITION BY symbol ORDER BY date) AS n,
                 avg(value) OVER (PARTITION BY symbol ORDER BY date ROWS 6 PRECEDING) AS recent,
                 avg(value) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) AS prior
          FROM side WHERE kind = 'dexvol' AND value IS NOT NULL)""",
    "veto_sig": """
        SELECT symbol, date, coalesce(n >= 14 AND CASE WHEN sd > 0 THEN (value - mean) / sd > 2
                                               WHEN mean > 0 THEN value > mean * 3 ELSE false END, false) AS veto FROM (
          SELECT symbol, date, value, count(*) OVER (PARTITION BY symbol ORDER BY date) AS n,
                 avg(value) OVER p AS mean, stddev_samp(value) OVER p AS sd
          FROM side WHERE kind = 'cexflow' AND value IS NOT NULL
          WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING))""",
    "conf_flags": """
        SELECT m.*, v.keep, x.veto FROM w_mom m
        ASOF LEFT JOIN vol_sig v ON m.symbol = v.symbol AND m.date >= v.date
        ASOF LEFT JOIN veto_sig x ON m.symbol = x.symbol AND m.date >= x.date""",
    "w_conf": """
        SELECT panel_id, pos, date, symbol, 1e0 / count(*) OVER (PARTITION BY panel_id, pos) AS w
        FROM conf_flags WHERE coalesce(keep, true) AND NOT coalesce(veto, false)""",
    "all_w": """
        SELECT 'equal_weight' AS strategy, * FROM w_equal UNION ALL SELECT 'momentum', * FROM w_mom
        UNION ALL SELECT 'mean_reversion', * FROM w_rev UNION ALL SELECT 'defensive', * FROM w_def
        UNION ALL SELECT 'momentum_onchain', * FROM w_conf""",
    "lab_cfg": """
        SELECT c.config_id, c.hysteresis, p.* FROM path p JOIN configs c ON c.path_id = p.path_id""",
    "lab_isl": """
        SELECT *, row_number() OVER (PARTITION BY panel_id, config_id ORDER BY pos)
               - row_number() OVER (PARTITION BY panel_id, config_id, regime ORDER BY pos) AS isl FROM lab_cfg""",
    "lab_run": """
        SELECT *, row_number() OVER (PARTITION BY panel_id, config_id, regime, isl ORDER BY pos) AS run FROM lab_isl""",
    "lab_active": """
        SELECT *, coalesce(last_value(CASE WHEN run >= hysteresis THEN regime END IGNORE NULLS) OVER
            (PARTITION BY panel_id, config_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'ranging') AS active FROM lab_run""",
    "gate_isl": """
        SELECT r.panel_id, r.pos, r.date, r.risk_off, c.*, row_number() OVER (PARTITION BY r.panel_id, c.config_id ORDER BY r.pos)
               - row_number() OVER (PARTITION BY r.panel_id, c.config_id, r.risk_off ORDER BY r.pos) AS isl
        FROM risk r CROSS JOIN configs c""",
    "gate_run": """
        SELECT *, row_number() OVER (PARTITION BY panel_id, config_id, risk_off, isl ORDER BY pos) AS run FROM gate_isl""",
    "gate": """
        SELECT *, coalesce(last_value(CASE WHEN run >= confirm THEN risk_off END IGNORE NULLS) OVER
            (PARTITION BY panel_id, config_id ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS gate FROM gate_run""",
    "active": """
        SELECT s.*, coalesce(fixed, CASE slot WHEN 'trending' THEN s_trending WHEN 'ranging' THEN s_ranging
                                   WHEN 'high_volatility' THEN s_high_volatility END) AS strategy
        FROM (SELECT g.*, a.active, CASE WHEN g.gated AND g.gate THEN 'high_volatility' ELSE a.active END AS slot
              FROM gate g LEFT JOIN lab_active a ON a.panel_id = g.panel_id AND a.config_id = g.config_id AND a.pos = g.pos) s""",
    "routed": """
        SELECT a.panel_id, a.config_id, a.pos, w.symbol, w.w FROM active a
        JOIN all_w w ON w.panel_id = a.panel_id AND w.strategy = a.strategy AND w.pos = a.pos""",
    "acct": """
        SELECT r.panel_id, c.config_id, r.pos, r.date,
               sum(abs(coalesce(w1.w, 0) - coalesce(w2.w, 0))) AS turnover,
               sum(coalesce(w1.w, 0) * coalesce(r.ret, 0)) AS gross
        FROM rets r CROSS JOIN configs c
        LEFT JOIN routed w1 ON w1.panel_id = r.panel_id AND w1.config_id = c.config_id AND w1.symbol = r.symbol AND w1.pos = r.pos - 1
        LEFT JOIN routed w2 ON w2.panel_id = r.panel_id AND w2.config_id = c.config_id AND w2.symbol = r.symbol AND w2.pos = r.pos - 2
        GROUP BY ALL""",
    "net": """
        SELECT panel_id, config_id, pos, date, CASE WHEN pos > 0 THEN turnover END AS turnover,
               CASE WHEN pos > 0 THEN turnover * 15e0 / 1e4 END AS cost,
               CASE WHEN pos > 0 THEN gross - turnover * 15e0 / 1e4 END AS ret FROM acct""",
    "eq": """
        SELECT *, 1e4 * product(1 + coalesce(ret, 0)) OVER
            (PARTITION BY panel_id, config_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS equity FROM net""",
    "daily": """
        SELECT *, equity / nullif(max(equity) OVER
            (PARTITION BY panel_id, config_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) - 1 AS drawdown FROM eq""",
    "wf_bounds": """
        SELECT panel_id, k AS window_id, n - (n // 6) * 6 + k * (n // 6) AS t0, n - (n // 6) * 6 + (k + 1) * (n // 6) AS t1
        FROM (SELECT panel_id, max(n_dates) AS n FROM cal GROUP BY 1), range(6) AS r(k) WHERE n >= 6""",
    "wf": """
        SELECT c.panel_id, CAST(b.window_id AS BIGINT) AS window_id, 'test' AS role, c.pos, c.date
        FROM cal c JOIN wf_bounds b ON b.panel_id = c.panel_id AND c.pos >= b.t0 AND c.pos < b.t1
        UNION ALL
        SELECT c.panel_id, b.window_id, 'train', c.pos, c.date
        FROM cal c JOIN wf_bounds b ON b.panel_id = c.panel_id AND c.pos < b.t0 - 5""",
    "groups6": """
        SELECT panel_id, g, n - (n // 6) * 6 + g * (n // 6) AS g0, n - (n // 6) * 6 + (g + 1) * (n // 6) AS g1
        FROM (SELECT panel_id, max(n_dates) AS n FROM cal GROUP BY 1), range(6) AS r(g) WHERE n >= 6""",
    "combos": """
        SELECT a.panel_id, row_number() OVER (PARTITION BY a.panel_id ORDER BY a.g, b.g) - 1 AS window_id,
               a.g0 AS a0, a.g1 AS a1, b.g0 AS b0, b.g1 AS b1
        FROM groups6 a JOIN groups6 b ON a.panel_id = b.panel_id AND a.g < b.g""",
    "cpcv": """
        SELECT * FROM (
          SELECT c.panel_id, k.window_id, c.pos, c.date,
                 CASE WHEN (c.pos >= a0 AND c.pos < a1) OR (c.pos >= b0 AND c.pos < b1) THEN 'test'
                      WHEN (c.pos >= a0 - 5 AND c.pos < a1 + 5) OR (c.pos >= b0 - 5 AND c.pos < b1 + 5) THEN NULL
                      ELSE 'train' END AS role
          FROM cal c JOIN combos k ON k.panel_id = c.panel_id) WHERE role IS NOT NULL""",
    "win_rows": """
        SELECT d.panel_id, d.config_id, w.window_id, w.role, d.pos, d.ret,
               product(1 + d.ret) OVER (PARTITION BY d.panel_id, d.config_id, w.window_id, w.role ORDER BY d.pos
                   ROWS UNBOUNDED PRECEDING) AS e
        FROM daily d JOIN wf w ON w.panel_id = d.panel_id AND w.pos = d.pos WHERE d.ret IS NOT NULL""",
    "win_dd": """
        SELECT *, e / max(e) OVER (PARTITION BY panel_id, config_id, window_id, role ORDER BY pos
            ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM win_rows""",
    "win_metrics": """
        SELECT panel_id, config_id, window_id, role, count(*) AS n_days, product(1 + ret) - 1 AS total_return,
               CASE WHEN stddev_samp(ret) >= 1e-12 THEN sqrt(365e0) * avg(ret) / stddev_samp(ret) ELSE 0e0 END AS sharpe,
               CASE WHEN stddev_samp(CASE WHEN ret < 0 THEN ret END) >= 1e-12
                    THEN sqrt(365e0) * avg(ret) / stddev_samp(CASE WHEN ret < 0 THEN ret END) ELSE 0e0 END AS sortino,
               min(dd) AS max_drawdown
        FROM win_dd GROUP BY ALL""",
    "tests": """
        SELECT c.panel_id, c.config_id, b.window_id, b.test_start, b.test_end, coalesce(m.n_days, 0) AS n_days,
               coalesce(m.total_return, 0) AS total_return, coalesce(m.sharpe, 0) AS sharpe,
               coalesce(m.sortino, 0) AS sortino, coalesce(m.max_drawdown, 0) AS max_drawdown
        FROM (SELECT DISTINCT panel_id, config_id FROM daily) c
        JOIN (SELECT panel_id, window_id, min(date) AS test_start, max(date) AS test_end FROM wf WHERE role = 'test' GROUP BY 1, 2) b
          ON b.panel_id = c.panel_id
        LEFT JOIN win_metrics m ON m.panel_id = c.panel_id AND m.config_id = c.config_id
          AND m.window_id = b.window_id AND m.role = 'test'""",
    "ranked_train": """
        SELECT m.*, row_number() OVER (PARTITION BY m.panel_id, m.window_id ORDER BY round(m.sharpe, 10) DESC, c.config_ord) AS rk
        FROM win_metrics m JOIN configs c ON c.config_id = m.config_id
        WHERE m.role = 'train' AND m.config_id IN ('gated', 'confirm2', 'confirm3', 'ungated')""",
    "selection": """
        SELECT t.panel_id, t.window_id, t.config_id AS chosen, t.n_days, t.total_return, t.sharpe, t.sortino, t.max_drawdown
        FROM ranked_train r JOIN tests t ON t.panel_id = r.panel_id AND t.window_id = r.window_id AND t.config_id = r.config_id
        WHERE r.rk = 1""",
    "oos": """
        SELECT panel_id, config_id, avg(sharpe) AS mean_sharpe, avg(total_return) AS mean_total_return,
               avg(max_drawdown) AS mean_max_drawdown FROM tests GROUP BY 1, 2""",
    "moments": """
        SELECT panel_id, config_id, count(ret) AS n_obs, stddev_samp(ret) AS sd,
               CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) ELSE 0e0 END AS sr,
               avg(power(ret - mu, 3)) / nullif(power(stddev_pop(ret), 3), 0) AS skew,
               avg(power(ret - mu, 4)) / nullif(power(stddev_pop(ret), 4), 0) AS kurt
        FROM (SELECT *, avg(ret) OVER (PARTITION BY panel_id, config_id) AS mu FROM daily) GROUP BY 1, 2""",
    "srvar": """
        SELECT panel_id, greatest(coalesce(var_samp(sr), 0), 1e-12) AS sr_var, count(*) AS n_trials
        FROM moments WHERE config_id IN ('gated', 'confirm2', 'confirm3', 'ungated') GROUP BY 1""",
    "obs": """
        SELECT panel_id, config_id, ret, row_number() OVER (PARTITION BY panel_id, config_id ORDER BY pos) - 1 AS i,
               count(*) OVER (PARTITION BY panel_id, config_id) AS n
        FROM daily WHERE ret IS NOT NULL""",
    "chain": "SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS tvl FROM orders GROUP BY 1",
    "proto": """
        SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS protocol FROM orders
        WHERE o_orderpriority = '1-URGENT' GROUP BY 1""",
    "share": """
        SELECT date, tvl, last_value(protocol IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) / tvl AS share
        FROM chain LEFT JOIN proto USING (date)""",
    "tvl_native": """
        SELECT date, tvl / lag(tvl, 20) OVER w - 1 AS tvl_mom20,
               tvl / max(tvl) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS tvl_dd,
               share / lag(share, 20) OVER w - 1 AS pancake_share_mom20
        FROM share WINDOW w AS (ORDER BY date)""",
    "transfers": """
        SELECT event_type AS token, ts, CAST(ts AS DATE) AS date, user_id AS sender,
               (user_id * 7 + event_id) % 150 AS receiver, value AS amount FROM events""",
    "wallets": "SELECT sender AS address FROM transfers GROUP BY 1 HAVING max(amount) >= 300",
    "ticks": """
        SELECT symbol, l_shipdate AS ts, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price,
               l_quantity AS qty, row_number() OVER (PARTITION BY symbol, CAST(l_shipdate AS DATE)
                   ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS k FROM ship""",
    "bars": """
        SELECT symbol, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
               arg_max(price, k) AS close, sum(qty) AS volume FROM ticks GROUP BY 1, 2""",
    "flow_mean": "SELECT kind, date, avg(value) AS value FROM side GROUP BY 1, 2",
    "flow_z": """
        SELECT kind, date, value, CASE WHEN count(value) OVER w >= 10
            THEN (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) END AS z
        FROM flow_mean WINDOW w AS (PARTITION BY kind ORDER BY date ROWS 59 PRECEDING)""",
    "prefix_models": _models(),
    "states": _model_states(),
    "ranked_states": """
        SELECT *, CASE WHEN v = 1 THEN 'high_volatility' WHEN row_number() OVER
            (PARTITION BY panel_id, refit_pos ORDER BY v = 1, abs(mu_trend_strength) DESC, state) = 1 THEN 'trending'
            ELSE 'ranging' END AS regime
        FROM (SELECT *, row_number() OVER (PARTITION BY panel_id, refit_pos ORDER BY mu_realized_vol DESC, state) AS v FROM states)""",
    "sched": "SELECT *, pos - (pos - 60) % 6 AS refit_pos FROM feats WHERE pos >= 60",
    "zrows": f"""
        SELECT f.*, {_Z} FROM sched f JOIN prefix_models m ON m.panel_id = f.panel_id AND m.refit_pos = f.refit_pos""",
    "scores": f"""
        SELECT z.*, s.regime, s.mu_trend_strength, s.mu_realized_vol, s.mu_breadth, s.mu_dispersion,
               ln(s.start) - 0.5e0 * ({_FIT}) AS ll
        FROM zrows z JOIN ranked_states s ON s.panel_id = z.panel_id AND s.refit_pos = z.refit_pos""",
    "post": """
        SELECT *, exp(ll - max(ll) OVER p) / sum(exp(ll - mx)) OVER p AS prob
        FROM (SELECT *, max(ll) OVER (PARTITION BY panel_id, pos) AS mx FROM scores)
        WINDOW p AS (PARTITION BY panel_id, pos)""",
    "best": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY panel_id, pos ORDER BY prob DESC,
            CASE regime WHEN 'trending' THEN 0 WHEN 'ranging' THEN 1 ELSE 2 END) AS rk FROM post) WHERE rk = 1""",
    "contrib": "SELECT *, "
    + ", ".join(f"z_{c} * mu_{c} AS c_{c}" for c in FEATURES)
    + ", "
    + " + ".join(f"abs(z_{c} * mu_{c})" for c in FEATURES)
    + " AS whole FROM best",
}

_KEYS = "m.panel_id = {0}.panel_id AND m.refit_pos = {0}.refit_pos"
_T = [[STAY if i == j else MOVE for j in range(3)] for i in range(3)]


def _em() -> dict[str, str]:
    """One EM step by recursion over dates: forward, backward, sums per model and state."""
    density = [
        "-0.5e0 * (" + " + ".join(f"ln(2e0 * pi() * s{k}.var_{c}) + pow((f.{c} - p.m_{c}) / p.s_{c} - s{k}.mu_{c}, 2) / s{k}.var_{c}" for c in FEATURES) + f") AS l{k}"
        for k in range(3)
    ]
    states = " ".join(f"JOIN em_start s{k} ON s{k}.panel_id = p.panel_id AND s{k}.refit_pos = p.refit_pos AND s{k}.state = {k}" for k in range(3))
    moved = [" + ".join(f"m.a{i} * {_T[i][j]!r}e0" for i in range(3)) for j in range(3)]
    back = [" + ".join(f"{_T[i][j]!r}e0 * b.b{j} * m.e{j}" for j in range(3)) for i in range(3)]
    scaled = lambda n: ", ".join(f"u{k} / (u0 + u1 + u2) AS {n}{k}" for k in range(3))
    gamma = ", ".join(f"a{k} * e{k} / (a0 * e0 + a1 * e1 + a2 * e2) AS g{k}" for k in range(3))
    pair = {(i, j): f"p{i} * {_T[i][j]!r}e0 * b{j} * e{j}" for i in range(3) for j in range(3)}
    moves = ", ".join(f"{x} / ({' + '.join(pair.values())}) AS x{i}{j}" for (i, j), x in pair.items())
    new = []
    for k in range(3):
        mu = ", ".join(f"sum(g{k} * z_{c}) / greatest(sum(g{k}), 1e-10) AS mu_{c}" for c in FEATURES)
        sq = ", ".join(f"sum(g{k} * z_{c} * z_{c}) AS q_{c}" for c in FEATURES)
        out = ", ".join(f"sum(x{k}{j}) / (sum(x{k}0) + sum(x{k}1) + sum(x{k}2)) AS t{j}" for j in range(3))
        new.append(f"SELECT panel_id, refit_pos, {k} AS state, sum(ll) AS loglik, max(CASE WHEN pos = 0 THEN g{k} END) AS start, greatest(sum(g{k}), 1e-10) AS mass, {mu}, {sq}, {out} FROM em_dates GROUP BY 1, 2")
    var = ", ".join(f"greatest((1e-2 + greatest(q_{c} - mass * mu_{c} * mu_{c}, 0e0)) / mass, 1e-12) AS var_{c}" for c in FEATURES)
    own = CTES["ranked_states"].replace("FROM states", "FROM em_states")
    return {
        "em_start": f"SELECT panel_id, refit_pos, state, start, {', '.join(f'mu_{c} + (state - 1) * {APART!r}e0 AS mu_{c}, var_{c}' for c in FEATURES)} FROM states",
        "em_rows": f"""
        SELECT *, exp(l0 - peak) AS b0, exp(l1 - peak) AS b1, exp(l2 - peak) AS b2 FROM (
            SELECT *, greatest(l0, l1, l2) AS peak FROM (
                SELECT p.panel_id, p.refit_pos, f.pos, {', '.join(f"(f.{c} - p.m_{c}) / p.s_{c} AS z_{c}" for c in FEATURES)}, {', '.join(density)}
                FROM prefix_models p {states} JOIN feats f ON f.panel_id = p.panel_id AND f.pos <= p.refit_pos))""",
        "em_ahead": f"""
        SELECT panel_id, refit_pos, pos, {scaled('a')}, ln(u0 + u1 + u2) AS ll FROM (
            SELECT b.panel_id, b.refit_pos, b.pos, {', '.join(f"s{k}.start * b.b{k} AS u{k}" for k in range(3))}
            FROM em_rows b {states.replace('p.', 'b.')} WHERE b.pos = 0)
        UNION ALL
        SELECT panel_id, refit_pos, pos, {scaled('a')}, ln(u0 + u1 + u2) FROM (
            SELECT b.panel_id, b.refit_pos, b.pos, {', '.join(f"({moved[j]}) * b.b{j} AS u{j}" for j in range(3))}
            FROM em_ahead m JOIN em_rows b ON {_KEYS.format('b')} AND b.pos = m.pos + 1)""",
        "em_behind": f"""
        SELECT panel_id, refit_pos, pos, 1e0 AS e0, 1e0 AS e1, 1e0 AS e2 FROM em_rows WHERE pos = refit_pos
        UNION ALL
        SELECT panel_id, refit_pos, pos, {scaled('e')} FROM (
            SELECT b.panel_id, b.refit_pos, b.pos - 1 AS pos, {', '.join(f"{back[i]} AS u{i}" for i in range(3))}
            FROM em_behind m JOIN em_rows b ON {_KEYS.format('b')} AND b.pos = m.pos WHERE b.pos > 0)""",
        "em_dates": f"""
        SELECT panel_id, refit_pos, pos, {', '.join(f"z_{c}" for c in FEATURES)}, ll + peak AS ll, {gamma}, {moves} FROM (
            SELECT b.*, m.a0, m.a1, m.a2, m.ll, e.e0, e.e1, e.e2, q.a0 AS p0, q.a1 AS p1, q.a2 AS p2
            FROM em_rows b JOIN em_ahead m ON {_KEYS.format('b')} AND m.pos = b.pos
            JOIN em_behind e ON e.panel_id = b.panel_id AND e.refit_pos = b.refit_pos AND e.pos = b.pos
            LEFT JOIN em_ahead q ON q.panel_id = b.panel_id AND q.refit_pos = b.refit_pos AND q.pos = b.pos - 1)""",
        "em_states": f"SELECT *, {var} FROM ({' UNION ALL '.join(new)})",
        "em_ranked": own,
        "em_scores": CTES["scores"].replace("JOIN ranked_states", "JOIN em_ranked"),
        "em_post": CTES["post"].replace("FROM scores", "FROM em_scores"),
        "em_best": CTES["best"].replace("FROM post", "FROM em_post"),
    }


CTES |= _em()

_SOURCE = re.compile(r"(?:FROM|JOIN)\s+(\w+)")


def sql(select: str, **extra: str) -> str:
    """``select`` preceded by the table expressions it needs, in dependency order."""
    ctes = {**CTES, **extra}
    needed: list[str] = []
    open_: set[str] = set()  # a recursive one names itself
    recursive = False

    def visit(text: str) -> None:
        nonlocal recursive
        for name in _SOURCE.findall(text):
            recursive |= name in open_
            if name in ctes and name not in needed and name not in open_:
                open_.add(name)
                visit(ctes[name])
                open_.remove(name)
                needed.append(name)

    visit(select)
    body = ", ".join(f"{name} AS ({ctes[name]})" for name in needed)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body} {select}" if needed else select


def pick(source: str, keys: str = "", ints: str = "", doubles: str = "", where: str = "") -> str:
    """Final select: keys as they are, integers as BIGINT, doubles at 6 places."""
    cols = [c for c in keys.split()]
    cols += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    cols += [f"floor(1e6 * ({c}) + 0.5e0) / 1e6 AS {c}" for c in doubles.split()]
    return sql(f"SELECT {', '.join(cols)} FROM {source}" + (f" WHERE {where}" if where else ""))
