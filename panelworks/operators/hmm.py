"""Training of regime models: many small Gaussian HMMs, one per panel, path and refit.

A path is a set of features under a name. Its history is packed once per panel, and a training job is a
range of ``REFITS`` consecutive refits over the history up to the last of them: all refits of a job, with
all their restarts, are trained together, each masked to its own length. So a panel of n dates ships
n / (2 REFITS) histories, not one per refit, and a step in time is one small matrix product for all of
them. Jobs of all panels and paths are one table, spread over an explicit number of partitions, because
they are heavy on CPU and small in bytes and would otherwise be coalesced into few tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FEATURES, FITTED

# Variance prior and floor of the diagonal Gaussian M-step (fixed values).
VAR_PRIOR = 1e-2
VAR_FLOOR = 1e-3
VAR_LEAST = 1e-12
REFITS = 16  # refits trained together


@dataclass(frozen=True)
class PathSpec:
    """Features (panel_id, pos, date, cols) that a regime path is trained on."""

    path_id: str
    features: DataFrame
    cols: tuple[str, ...] = FEATURES


def refit_position(min_train: int, refit_every: int):
    """Position of the model in force: a new fit every ``refit_every + 1`` rows."""
    step = refit_every + 1
    return F.col("pos") - F.pmod(F.col("pos") - min_train, F.lit(step))


def _histories(features: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """Feature history of each panel in date order, with its last position."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.array(*cols).alias("x"))))
    return features.groupBy("panel_id").agg(rows["x"].alias("x"), F.max("pos").alias("last"))


def training_jobs(paths: Sequence[PathSpec], min_train: int = 60, refit_every: int = 5, refits: int = REFITS) -> DataFrame:
    """``(panel_id, path_id, refits, x)``: ranges of refit positions, with the history up to the last."""

    def of(path: PathSpec) -> DataFrame:
        enough = _histories(path.features, path.cols).filter(F.col("last") >= min_train)
        every = F.sequence(F.lit(min_train), F.col("last"), F.lit(refit_every + 1))
        starts = F.sequence(F.lit(1), F.size(every), F.lit(refits))
        jobs = enough.select("panel_id", "x", F.explode(F.transform(starts, lambda s: F.slice(every, s, refits))).alias("refits"))
        return jobs.select("panel_id", F.lit(path.path_id).alias("path_id"), "refits", F.slice("x", 1, F.array_max("refits") + 1).alias("x"))

    return reduce(DataFrame.unionByName, map(of, paths))


def latest_jobs(path: PathSpec) -> DataFrame:
    """One training job per panel over its whole history."""
    return _histories(path.features, path.cols).select("panel_id", F.lit(path.path_id).alias("path_id"), F.array("last").alias("refits"), "x")


def fit_models(
    jobs: DataFrame,
    n_states: int = 3,
    n_restarts: int = 8,
    n_iter: int = 200,
    tol: float = 1e-4,
    seed: int = 0,
) -> DataFrame:
    """Train every job and return the model table, one row per refit."""

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for jobs in batches:
            rows = []
            for job in jobs.itertuples(index=False):
                x = np.array(job.x.tolist(), dtype=float)
                fitted = fit_prefixes(x, [r + 1 for r in job.refits], n_states, n_restarts, n_iter, tol, seed)
                rows += [(job.panel_id, job.path_id, r, *f) for r, f in zip(job.refits, fitted)]
            yield pd.DataFrame(rows, columns=["panel_id", "path_id", "refit_pos", "loglik", "center", "scale", "states", "trans"])

    parts = 4 * jobs.sparkSession.sparkContext.defaultParallelism
    return jobs.repartition(parts, "panel_id", "path_id", "refits").mapInPandas(train, FITTED)


def fit_hmm(x: np.ndarray, n_states: int, n_restarts: int, n_iter: int, tol: float, seed: int):
    """Log-likelihood, scaler, states and transitions of the likeliest restart over one history."""
    return fit_prefixes(x, [len(x)], n_states, n_restarts, n_iter, tol, seed)[0]


def fit_prefixes(x: np.ndarray, lengths: Sequence[int], n_states: int, n_restarts: int, n_iter: int, tol: float, seed: int) -> list[tuple]:
    """``fit_hmm`` of the first ``lengths`` rows of ``x``, all of them and all restarts at once.

    Each prefix is standardised by its own mean and deviation; a trial leaves the batch when it has
    converged.
    """
    lengths = np.asarray(lengths)
    x = x[: lengths.max()]
    centers = np.array([x[:n].mean(axis=0) for n in lengths])
    scales = np.array([x[:n].std(axis=0) for n in lengths])
    scales = np.where(scales > 0, scales, 1.0)
    inside = np.arange(len(x)) < lengths[:, None]
    z = np.where(inside[..., None], (x - centers[:, None]) / scales[:, None], 0.0)
    trials = np.repeat(np.arange(len(lengths)), n_restarts)  # the prefix of each trial
    first = [_initial(z[j, :n], n_states, n_restarts, seed) for j, n in enumerate(lengths)]
    start, trans, mu, var = (np.concatenate(part) for part in zip(*first))
    live, before = np.ones(len(trials), bool), np.full(len(trials), -np.inf)
    for _ in range(n_iter):
        i = np.flatnonzero(live)
        n = int(lengths[trials[i]].max())
        own = z[trials[i], :n]
        loglik, gamma, moves = _expect(own, start[i], trans[i], mu[i], var[i], lengths[trials[i]])
        start[i], trans[i], mu[i], var[i] = _maximise(own, gamma, moves)
        live[i] = loglik - before[i] >= tol
        before[i] = loglik
        if not live.any():
            break
    loglik = _expect(z[trials], start, trans, mu, var, lengths[trials])[0].reshape(len(lengths), n_restarts)
    best = np.argmax(np.where(np.isfinite(loglik), loglik, -np.inf), axis=1)
    out = []
    for j, r in enumerate(best):
        t = j * n_restarts + r
        states = [{"start": float(start[t, k]), "mu": mu[t, k].tolist(), "var": var[t, k].tolist()} for k in range(n_states)]
        out.append((float(loglik[j, r]), centers[j].tolist(), scales[j].tolist(), states, trans[t].tolist()))
    return out


def _initial(z: np.ndarray, k: int, restarts: int, seed: int):
    """Uniform chain, pooled variances and k-means centres, seeded per restart."""
    centres = np.empty((restarts, k, z.shape[1]))
    for r in range(restarts):
        rng = np.random.default_rng(seed + r)
        c = z[rng.integers(len(z))][None]
        while len(c) < k:
            far = ((z[:, None] - c) ** 2).sum(-1).min(1)
            p = far / far.sum() if far.sum() > 0 else None
            c = np.vstack([c, z[rng.choice(len(z), p=p)]])
        for _ in range(25):
            near = ((z[:, None] - c) ** 2).sum(-1).argmin(1)
            moved = np.array([z[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
            if np.allclose(moved, c):
                break
            c = moved
        centres[r] = c
    start = np.full((restarts, k), 1.0 / k)
    trans = np.full((restarts, k, k), 1.0 / k)
    var = np.tile(z.var(axis=0) + VAR_FLOOR, (restarts, k, 1))
    return start, trans, centres, var


def _expect(z, start, trans, mu, var, lengths=None):
    """Scaled forward-backward for all trials at once, each over its first ``lengths`` rows of its ``z``
    (one ``z`` may serve all); posteriors beyond are zero."""
    z = z[None] if z.ndim == 2 else z
    trials, k = start.shape
    n = z.shape[1]
    lengths = np.full(trials, n) if lengths is None else lengths
    inside = np.arange(n) < lengths[:, None]
    inverse = 1.0 / var
    # Squares expanded, so that no (trial, row, state, feature) array is built.
    fit = z**2 @ inverse.transpose(0, 2, 1) - 2 * z @ (mu * inverse).transpose(0, 2, 1) + (mu**2 * inverse).sum(-1)[:, None]
    logb = -0.5 * (np.log(2 * np.pi * var).sum(-1)[:, None] + fit)
    peak = logb.max(axis=2, keepdims=True)
    b = np.where(inside[..., None], np.exp(logb - peak), 1.0)
    alpha, beta, norm = np.empty_like(b), np.ones_like(b), np.empty((trials, n))
    now = start * b[:, 0]
    for t in range(n):
        if t:
            now = (now[:, None] @ trans)[:, 0] * b[:, t]
        norm[:, t] = np.maximum(now.sum(1), 1e-300)
        now = now / norm[:, t, None]
        alpha[:, t] = now
    back = trans.transpose(0, 2, 1)
    for t in range(n - 2, -1, -1):
        before = ((b[:, t + 1] * beta[:, t + 1])[:, None] @ back)[:, 0] / norm[:, t + 1, None]
        beta[:, t] = np.where(inside[:, t + 1, None], before, 1.0)  # a trial's last row has ones
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    gamma *= inside[..., None]
    ahead = b[:, 1:] * beta[:, 1:] / norm[:, 1:, None] * inside[:, 1:, None]
    moves = trans * (alpha[:, :-1].transpose(0, 2, 1) @ ahead)
    return (np.where(inside, np.log(norm) + peak[..., 0], 0.0)).sum(1), gamma, moves


def _maximise(z, gamma, moves):
    start = gamma[:, 0] / gamma[:, 0].sum(1, keepdims=True)
    out = moves.sum(2, keepdims=True)
    trans = np.where(out > 0, moves / np.where(out > 0, out, 1.0), 1.0 / moves.shape[2])
    mass = np.maximum(gamma.sum(1), 1e-10)[..., None]
    by_state = gamma.transpose(0, 2, 1)
    mu = by_state @ z / mass
    spread = by_state @ z**2 - mass * mu**2
    return start, trans, mu, np.maximum((VAR_PRIOR + np.maximum(spread, 0.0)) / mass, VAR_LEAST)
