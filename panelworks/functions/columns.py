"""Column expressions used across operators. All of them stay inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

PERIODS_PER_YEAR = 365
FLAT = 1e-12


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den``, NULL where the divisor is zero."""
    return col(num) / F.nullif(col(den), F.lit(0.0))


def so_far(window: WindowSpec) -> WindowSpec:
    """Frame from the first row through the current one."""
    return window.rowsBetween(Window.unboundedPreceding, 0)


def trailing(window: WindowSpec, rows: int) -> WindowSpec:
    """Frame of the last ``rows`` rows including the current one."""
    return window.rowsBetween(-(rows - 1), 0)


def carry_forward(c: Column | str, window: WindowSpec) -> Column:
    """Last non-NULL value up to the current row."""
    return F.last(col(c), ignorenulls=True).over(so_far(window))


def at_offset(c: Column | str, window: WindowSpec, offset: int) -> Column:
    """Value exactly ``offset`` calendar positions away, NULL where that cell is
    absent. A one-position range frame on a sparse table gives the same answer
    as shifting a dense grid, without building the grid."""
    return F.max(col(c)).over(window.rangeBetween(offset, offset))


def sharpe(r: Column | str, periods: int = PERIODS_PER_YEAR) -> Column:
    """Annualised Sharpe aggregate; 0 for empty, single or flat returns."""
    sd = F.stddev_samp(col(r))
    return F.coalesce(F.when(sd >= FLAT, math.sqrt(periods) * F.avg(col(r)) / sd), F.lit(0.0))


def sortino(r: Column | str, periods: int = PERIODS_PER_YEAR) -> Column:
    """Annualised Sortino aggregate over the sample deviation of losses only.

    Equal losses leave rounding noise instead of a zero deviation, so the flat
    threshold of the Sharpe ratio applies here too.
    """
    r = col(r)
    sd = F.stddev_samp(F.when(r < 0, r))
    return F.coalesce(F.when(sd >= FLAT, math.sqrt(periods) * F.avg(r) / sd), F.lit(0.0))


def win_rate(r: Column | str) -> Column:
    """Share of strictly positive among non-NULL returns; 0 if there are none."""
    r = col(r)
    return F.coalesce(ratio(F.count_if(r > 0).cast("double"), F.count(r).cast("double")), F.lit(0.0))


def compounded(r: Column | str) -> Column:
    """Compounded return aggregate, 0 for an empty group."""
    return F.coalesce(F.product(1.0 + col(r)) - 1.0, F.lit(0.0))


def per_period_sharpe(r: Column | str) -> Column:
    """Mean over sample deviation without annualisation; 0 when flat."""
    sd = F.stddev_samp(col(r))
    return F.coalesce(F.when(sd > FLAT, F.avg(col(r)) / sd), F.lit(0.0))
