"""Mergeable states of return sequences.

A state of a run of returns holds count, mean and squared deviations of all and of the negative returns,
and of the equity that starts at one before the run: its end, highest, lowest and worst ratio to an
earlier high. States of neighbouring runs merge in order into the state of both, so a window or a
resampled path is evaluated from the few states of its pieces. All of it is column arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import FLAT, PERIODS_PER_YEAR

FIELDS = ("n", "mean", "m2", "neg", "neg_mean", "neg_m2", "growth", "peak", "low", "worst")


def _state(*values: Column) -> Column:
    return F.struct(*[v.alias(f) for f, v in zip(FIELDS, values, strict=True)])


def nothing() -> Column:
    """State of no returns."""
    return _state(*[F.lit(1.0 if f in ("growth", "peak", "low") else 0.0) for f in FIELDS])


def of_return(r: Column) -> Column:
    """State of one return."""
    zero, below = F.lit(0.0), r < 0
    return _state(F.lit(1.0), r, zero, below.cast("double"), F.when(below, r).otherwise(0.0), zero, 1.0 + r, 1.0 + r, 1.0 + r, zero)


def _moments(a: Column, b: Column, n: str, mean: str, m2: str) -> tuple[Column, Column, Column]:
    count = a[n] + b[n]
    part = F.when(count > 0, b[n] / count).otherwise(0.0)
    gap = b[mean] - a[mean]
    return count, a[mean] + gap * part, a[m2] + b[m2] + gap * gap * a[n] * part


def merge(a: Column, b: Column) -> Column:
    """State of run ``a`` followed by run ``b``. After a total loss equity stays at zero."""
    across = F.when(a["peak"] > 0, a["growth"] * b["low"] / a["peak"] - 1.0)
    both = _state(
        *_moments(a, b, "n", "mean", "m2"), *_moments(a, b, "neg", "neg_mean", "neg_m2"), a["growth"] * b["growth"],
        F.greatest(a["peak"], a["growth"] * b["peak"]), F.least(a["low"], a["growth"] * b["low"]), F.least(a["worst"], F.when(a["growth"] != 0, b["worst"]), across),
    )
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)


def of_returns(returns: Column) -> Column:
    """State of an array of returns in order."""
    return F.aggregate(returns, nothing(), lambda s, r: merge(s, of_return(r)))


def merged(states: Column) -> Column:
    """State of an array of states in order."""
    return F.aggregate(states, nothing(), merge)


def _per_deviation(state: Column, n: str, m2: str, periods: int) -> Column:
    sd = F.sqrt(state[m2] / F.when(state[n] > 1, state[n] - 1.0))
    return F.coalesce(F.when(sd >= FLAT, math.sqrt(periods) * state["mean"] / sd), F.lit(0.0))


def metrics(state: Column, periods: int = PERIODS_PER_YEAR) -> dict[str, Column]:
    """Total return, annualised Sharpe and Sortino ratios and maximum drawdown of a state.

    The drawdown counts from the equity after the first return on.
    """
    return {
        "total_return": state["growth"] - 1.0,
        "sharpe": _per_deviation(state, "n", "m2", periods),
        "sortino": _per_deviation(state, "neg", "neg_m2", periods),
        "max_drawdown": state["worst"],
    }
