"""Table layouts shared by the operators. Missing values are NULL, never NaN."""

BARS = "symbol STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
SERIES = "kind STRING, symbol STRING, date DATE, value DOUBLE"

# The three regimes in their fixed order, which also breaks posterior ties.
REGIMES = ("trending", "ranging", "high_volatility")
# Market features in their fixed column order.
FEATURES = ("trend_strength", "realized_vol", "breadth", "dispersion")

STATE = "STRUCT<start: DOUBLE, mu: ARRAY<DOUBLE>, var: ARRAY<DOUBLE>>"
MODELS = (
    "panel_id STRING, path_id STRING, refit_pos INT, loglik DOUBLE, "
    f"center ARRAY<DOUBLE>, scale ARRAY<DOUBLE>, states ARRAY<{STATE}>"
)
# A trained model also has its transitions, one row per state.
FITTED = f"{MODELS}, trans ARRAY<ARRAY<DOUBLE>>"
