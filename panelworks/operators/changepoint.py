"""Bayesian online change-point detection over many series.

The run-length recursion is sequential within a series and independent across series. ``change_points``
takes a series of at most one calendar in one group; the work per series is quadratic in its length, so
series are spread over an explicit number of partitions.

``advance`` carries the recursion over one stretch of time from a table of states, one row per series:
the run lengths with their masses and posterior parameters. Long series are taken stretch by stretch
(``change_points_chunked``), and rows that arrive later go on from the kept table. With ``prune`` run lengths
of less mass are given up after each step, which bounds the state; ``lost`` is the mass given up so far in
all. With 0 nothing is given up and stretches give what the whole series gives.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

STATE = "run ARRAY<INT>, mass ARRAY<DOUBLE>, mu ARRAY<DOUBLE>, beta ARRAY<DOUBLE>, lost DOUBLE"


def change_points(
    series: DataFrame,
    hazard: float = 0.01,
    mu0: float = 0.0,
    kappa0: float = 1.0,
    alpha0: float = 1.0,
    beta0: float = 1.0,
) -> DataFrame:
    """``(series_id, pos, x)`` to ``(series_id, pos, cp_prob)``: the posterior mass
    of run lengths 0 and 1 at each step."""

    def detect(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        prob = short_run_mass(pdf["x"].to_numpy(float), hazard, mu0, kappa0, alpha0, beta0)
        return pdf[["series_id", "pos"]].assign(cp_prob=prob)

    parts = 4 * series.sparkSession.sparkContext.defaultParallelism
    return (
        series.select("series_id", "pos", "x")
        .repartition(parts, "series_id")
        .groupBy("series_id")
        .applyInPandas(detect, "series_id string, pos int, cp_prob double")
    )


def advance(
    series: DataFrame,
    states: DataFrame | None = None,
    prune: float = 0.0,
    hazard: float = 0.01,
    mu0: float = 0.0,
    kappa0: float = 1.0,
    alpha0: float = 1.0,
    beta0: float = 1.0,
) -> DataFrame:
    """One row per series: ``pos`` and ``cp_prob`` of its rows ``(series_id, pos, x)`` in order, and the state
    after them. ``states`` are rows of an earlier stretch; series without rows keep theirs."""
    prior = (hazard, mu0, kappa0, alpha0, beta0)

    def step(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        name = rows["series_id"].iloc[0] if len(rows) else held["series_id"].iloc[0]
        state = tuple(np.array(held[c].iloc[0]) for c in ("run", "mass", "mu", "beta")) + (float(held["lost"].iloc[0]),) if len(held) else _fresh(mu0, beta0)
        prob, (run, mass, mu, beta, lost) = _recursion(rows["x"].to_numpy(float), state, prune, *prior)
        return pd.DataFrame([(name, rows["pos"].tolist(), prob, run, mass, mu, beta, lost)], columns=["series_id", "pos", "cp_prob", "run", "mass", "mu", "beta", "lost"])

    spark = series.sparkSession
    if states is None:
        states = spark.createDataFrame([], f"series_id STRING, {STATE}")
    parts = 4 * spark.sparkContext.defaultParallelism
    rows = series.select("series_id", "pos", "x").repartition(parts, "series_id").groupBy("series_id")
    kept = states.select("series_id", "run", "mass", "mu", "beta", "lost").repartition(parts, "series_id").groupBy("series_id")
    return rows.cogroup(kept).applyInPandas(step, f"series_id STRING, pos ARRAY<INT>, cp_prob ARRAY<DOUBLE>, {STATE}")


def change_points_chunked(series: DataFrame, chunk: int = 512, prune: float = 0.0, **prior: float) -> DataFrame:
    """``change_points`` of series of any length, ``chunk`` positions at a time; states are written between."""
    first, last = series.agg(F.min("pos"), F.max("pos")).first()
    done, states = [], None
    for low in range(first, last + 1, chunk) if first is not None else ():
        states = materialize(advance(series.filter(F.col("pos").between(low, low + chunk - 1)), states, prune, **prior))
        done.append(states.select("series_id", F.inline(F.arrays_zip("pos", "cp_prob"))))
    if not done:
        return series.select("series_id", "pos", F.lit(0.0).alias("cp_prob")).limit(0)
    return reduce(DataFrame.unionByName, done)


def _fresh(mu0: float, beta0: float) -> tuple:
    return np.zeros(1, dtype=np.int64), np.ones(1), np.full(1, mu0), np.full(1, beta0), 0.0


def short_run_mass(x, hazard, mu0, kappa0, alpha0, beta0) -> np.ndarray:
    """The recursion over one whole series."""
    return _recursion(x, _fresh(mu0, beta0), 0.0, hazard, mu0, kappa0, alpha0, beta0)[0]


def _recursion(x, state, prune, hazard, mu0, kappa0, alpha0, beta0) -> tuple[np.ndarray, tuple]:
    """Normal-inverse-Gamma recursion from a state: mass of run lengths 0 and 1 per step, and the new state.

    Kappa and alpha depend on the run length only, so their predictive constants
    are tabulated once; an underflowing step restarts at run length 0.
    """
    run, mass, mu, beta, lost = state
    alphas = alpha0 + np.arange(int(run.max()) + len(x) + 1) / 2.0
    table = np.array([math.lgamma(a + 0.5) - math.lgamma(a) - 0.5 * math.log(2 * math.pi * a) for a in alphas])
    out = np.zeros(len(x))
    for t, value in enumerate(x):
        k, a = kappa0 + run, alpha0 + run / 2.0
        scale2 = beta * (k + 1) / (a * k)
        with np.errstate(over="ignore", invalid="ignore"):
            gap2 = (value - mu) ** 2
            tail = np.log1p(gap2 / (2 * a * scale2))
            predictive = np.exp(table[run] - 0.5 * np.log(scale2) - (a + 0.5) * tail)
        weighted = mass * predictive
        mass = np.concatenate(([hazard * weighted.sum()], (1 - hazard) * weighted))
        total = mass.sum()
        if total > 0 and np.isfinite(total):
            mass = mass / total
        else:
            mass = np.zeros(len(mass))
            mass[0] = 1.0
        beta = np.concatenate(([beta0], beta + k * gap2 / (2 * (k + 1))))
        mu = np.concatenate(([mu0], (k * mu + value) / (k + 1)))
        run = np.concatenate(([0], run + 1))
        out[t] = mass[run <= 1].sum()
        if prune > 0:
            stay = (mass >= prune) | (run <= 1)
            lost += mass[~stay].sum()
            run, mass, mu, beta = run[stay], mass[stay] / mass[stay].sum(), mu[stay], beta[stay]
    return out, (run, mass, mu, beta, lost)
