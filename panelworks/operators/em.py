"""One expectation-maximisation step of Gaussian hidden-state models, as a plan.

The forward and backward passes are products of 3 x 3 matrices (transition times emission), which is an
associative operation, so they run as a scan: each chunk of ``CHUNK`` dates multiplies its own matrices,
the few chunk products of a model give the vectors that enter every chunk from both sides, and each chunk
then unrolls its own dates. Vectors and products are rescaled to sum to one as they go and the logarithms
of the factors add up to the likelihood. Everything after that is column arithmetic and one aggregation per
model. No task holds more than a chunk of dates, or one small vector per chunk.

Parameters are a model table with transitions: ``(panel_id, path_id, refit_pos, center, scale, states,
trans)``, states of (start, mu, var) in standardised units, ``trans`` an array of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FEATURES
from ..session import materialize
from .hmm import VAR_LEAST, VAR_PRIOR

CHUNK = 64  # dates multiplied together
STATES = 3
_MODEL = ["panel_id", "path_id", "refit_pos"]
_K = range(STATES)


def _vector(items: Sequence[Column]) -> Column:
    return F.array(*items)


def _total(items: Sequence[Column]) -> Column:
    return sum(items[1:], items[0])


def _rescaled(items: Sequence[Column], logs: Column) -> Column:
    """(v, l): the items over their sum, and ``logs`` plus its logarithm."""
    held = F.struct(_vector(items).alias("v"), logs.alias("l"))
    return _apply(held, lambda h: F.struct(F.transform(h["v"], lambda x: x / _sum(h["v"])).alias("v"), (h["l"] + F.log(_sum(h["v"]))).alias("l")))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, b: a + b)


def _apply(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _forward(v: Column, trans: Column, row: Column) -> list[Column]:
    """Row vector times the transitions, but for the first date, times the emissions."""
    moved = [_total([v[i] * trans[i][j] for i in _K]) for j in _K]
    return [F.when(row["first"], v[j]).otherwise(moved[j]) * row["b"][j] for j in _K]


def _backward(v: Column, trans: Column, row: Column) -> list[Column]:
    """The transitions into a date and its emissions times a column vector."""
    return [_total([trans[i][j] * row["b"][j] * v[j] for j in _K]) for i in _K]


def emissions(features: DataFrame, params: DataFrame, cols: tuple[str, ...] = FEATURES) -> DataFrame:
    """Dates up to each model's refit with standardised features ``z``, densities ``b`` over the largest of
    the three, and its logarithm ``peak``."""
    model = params.select(*_MODEL, "center", "scale", "states", "trans")
    rows = features.select("panel_id", "pos", *cols).join(model, "panel_id").where("pos <= refit_pos")
    z = F.array(*[(F.col(c) - F.col("center")[j]) / F.col("scale")[j] for j, c in enumerate(cols)])
    rows = rows.select(*_MODEL, "pos", z.alias("z"), "states", "trans")
    log_density = []
    for k in _K:
        state = F.col("states")[k]
        parts = [F.log(2 * math.pi * state["var"][j]) + F.pow(F.col("z")[j] - state["mu"][j], 2) / state["var"][j] for j in range(len(cols))]
        log_density.append(-0.5 * _total(parts))
    rows = rows.withColumns({f"_{k}": log_density[k] for k in _K}).withColumn("peak", F.greatest(*[f"_{k}" for k in _K]))
    return rows.select(*_MODEL, "pos", "z", F.array(*[F.exp(F.col(f"_{k}") - F.col("peak")) for k in _K]).alias("b"), "peak", "states", "trans")


def chunks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(model, chunk, start, trans, dates, product, logs): the dates of each chunk in order and the scaled
    product of their matrices, as three rows."""
    item = F.struct("pos", "z", "b", "peak", (F.col("pos") == 0).alias("first"))
    start = F.transform("states", lambda s: s["start"])
    grouped = rows.groupBy(*_MODEL, F.floor(F.col("pos") / chunk).alias("chunk")).agg(
        F.array_sort(F.collect_list(item)).alias("dates"), F.first(start).alias("start"), F.first("trans").alias("trans")
    )
    one = F.array(*[F.array(*[F.lit(float(i == j)) for j in _K]) for i in _K])
    held = F.struct(one.alias("m"), F.lit(0.0).alias("l"))

    def step(acc: Column, row: Column) -> Column:
        rows_ = F.array(*[_vector(_forward(acc["m"][i], F.col("trans"), row)) for i in _K])
        whole = lambda m: _total([_sum(m[i]) for i in _K])
        return _apply(rows_, lambda m: F.struct(F.transform(m, lambda r: F.transform(r, lambda x: x / whole(m))).alias("m"), (acc["l"] + F.log(whole(m))).alias("l")))

    return grouped.withColumn("product", F.aggregate("dates", held, step)["m"])


def _entries(parts: DataFrame) -> DataFrame:
    """(model, chunk, ahead, behind): the vector that enters each chunk from its past and from its future."""
    listed = parts.groupBy(*_MODEL).agg(F.array_sort(F.collect_list(F.struct("chunk", "product"))).alias("ps"), F.first("start").alias("start"))
    none = F.expr("array()").cast("array<array<double>>")

    def scan(times):
        def step(acc: Column, p: Column) -> Column:
            return F.struct(_rescaled(times(acc["v"], p["product"]), F.lit(0.0))["v"].alias("v"), F.array_append(acc["out"], acc["v"]).alias("out"))

        return step

    ahead = F.aggregate("ps", F.struct(F.col("start").alias("v"), none.alias("out")), scan(lambda v, m: [_total([v[i] * m[i][j] for i in _K]) for j in _K]))["out"]
    ones = F.array(*[F.lit(1.0 / STATES) for _ in _K])
    behind = F.aggregate(F.reverse("ps"), F.struct(ones.alias("v"), none.alias("out")), scan(lambda v, m: [_total([m[i][j] * v[j] for j in _K]) for i in _K]))["out"]
    zipped = F.arrays_zip(F.transform("ps", lambda p: p["chunk"]).alias("chunk"), ahead.alias("ahead"), F.reverse(behind).alias("behind"))
    return listed.select(*_MODEL, F.inline(zipped))


def smoothed(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(model, pos, z, first, gamma, moves, logs): posterior of each state and move per date, and the date's
    term of the log-likelihood."""
    parts = materialize(chunks(rows, chunk))
    held = parts.drop("product", "start").join(_entries(parts.select(*_MODEL, "chunk", "product", "start")), [*_MODEL, "chunk"])
    none = F.expr("array()").cast("array<struct<v:array<double>,l:double>>")

    def ahead(acc: Column, row: Column) -> Column:
        return _apply(_rescaled(_forward(acc["v"], F.col("trans"), row), F.lit(0.0)), lambda s: F.struct(s["v"].alias("v"), F.array_append(acc["out"], s).alias("out")))

    def behind(acc: Column, row: Column) -> Column:
        now = F.struct(acc["v"].alias("v"), F.lit(0.0).alias("l"))
        return F.struct(_rescaled(_backward(acc["v"], F.col("trans"), row), F.lit(0.0))["v"].alias("v"), F.array_append(acc["out"], now).alias("out"))

    alpha = F.aggregate("dates", F.struct(F.col("ahead").alias("v"), none.alias("out")), ahead)["out"]
    beta = F.reverse(F.aggregate(F.reverse("dates"), F.struct(F.col("behind").alias("v"), none.alias("out")), behind)["out"])
    before = F.concat(F.array(F.struct(F.col("ahead").alias("v"), F.lit(0.0).alias("l"))), F.col("alpha"))
    unrolled = held.withColumns({"alpha": alpha, "beta": beta})
    zipped = F.arrays_zip(F.col("dates").alias("d"), F.col("alpha").alias("a"), F.slice(before, 1, F.size("alpha")).alias("p"), F.col("beta").alias("e"))
    dates = unrolled.select(*_MODEL, "trans", F.inline(zipped))
    own = [F.col("a.v")[k] * F.col("e.v")[k] for k in _K]
    pair = [F.col("p.v")[i] * F.col("trans")[i][j] * F.col("d.b")[j] * F.col("e.v")[j] for i in _K for j in _K]
    dates = dates.withColumns({"own": _vector(own), "pair": _vector(pair)})
    return dates.select(
        *_MODEL, "d.pos", "d.z", "d.first",
        F.transform("own", lambda x: x / _sum(F.col("own"))).alias("gamma"),
        F.transform("pair", lambda x: x / _sum(F.col("pair"))).alias("moves"),
        (F.col("a.l") + F.col("d.peak")).alias("logs"),
    )


def em_step(features: DataFrame, params: DataFrame, cols: tuple[str, ...] = FEATURES, chunk: int = CHUNK) -> DataFrame:
    """``params`` after one step, with the log-likelihood ``loglik`` of the parameters given.

    Each model sees the dates up to its refit, the first at position 0. Variances have the training's prior
    and floor; transitions of a state that is never left are uniform.
    """
    dates = smoothed(emissions(features, params, cols), chunk)
    sums = {"loglik": F.sum("logs")}
    for k in _K:
        g = F.col("gamma")[k]
        sums |= {f"s{k}": F.sum(F.when(F.col("first"), g)), f"g{k}": F.sum(g)}
        sums |= {f"t{k}{j}": F.sum(F.when(~F.col("first"), F.col("moves")[STATES * k + j])) for j in _K}
        for j in range(len(cols)):
            sums |= {f"x{k}_{j}": F.sum(g * F.col("z")[j]), f"y{k}_{j}": F.sum(g * F.col("z")[j] * F.col("z")[j])}
    stats = dates.groupBy(*_MODEL).agg(*[c.alias(n) for n, c in sums.items()])

    def state(k: int) -> Column:
        mass = F.greatest(F.col(f"g{k}"), F.lit(1e-10))
        mu = [F.col(f"x{k}_{j}") / mass for j in range(len(cols))]
        spread = [F.greatest(F.col(f"y{k}_{j}") - mass * m * m, F.lit(0.0)) for j, m in enumerate(mu)]
        var = [F.greatest((VAR_PRIOR + s) / mass, F.lit(VAR_LEAST)) for s in spread]
        return F.struct(F.col(f"s{k}").alias("start"), F.array(*mu).alias("mu"), F.array(*var).alias("var"))

    def leaving(k: int) -> Column:
        out = [F.coalesce(F.col(f"t{k}{j}"), F.lit(0.0)) for j in _K]
        whole = _total(out)
        return F.array(*[F.when(whole > 0, o / whole).otherwise(1.0 / STATES) for o in out])

    new = stats.select(*_MODEL, "loglik", F.array(*[state(k) for k in _K]).alias("states"), F.array(*[leaving(k) for k in _K]).alias("trans"))
    return params.select(*_MODEL, "center", "scale").join(new, _MODEL)


def em_steps(features: DataFrame, params: DataFrame, steps: int, cols: tuple[str, ...] = FEATURES, chunk: int = CHUNK) -> DataFrame:
    """``steps`` steps, each written; ``loglik`` is that of the parameters before the last."""
    for _ in range(steps):
        params = materialize(em_step(features, params, cols, chunk))
    return params
