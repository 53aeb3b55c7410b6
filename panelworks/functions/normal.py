"""Normal distribution function and quantile as column expressions, which Spark SQL lacks.

Both are piecewise rational approximations, accurate to about 1e-15, the distribution function
absolutely and the quantile relatively. All of it is column arithmetic: no row leaves the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

# Published coefficients, highest power first.
# Hart's rational approximation of the upper tail over the density's exponential, below 5 sqrt(2).
_TAIL_TOP = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_BOTTOM = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Wichura's quantile: within 0.425 of the median, then by the root of the log of the tail, below and above 5.
_MIDDLE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
_NEAR = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def _of(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def phi(z: Column | str) -> Column:
    """Standard normal distribution function."""

    def upper(x: Column) -> Column:
        """Probability above x >= 0."""
        fall = F.exp(-x * x / 2)
        fraction = x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))
        return F.when(x < 5 * math.sqrt(2), fall * _polynomial(x, _TAIL_TOP) / _polynomial(x, _TAIL_BOTTOM)).otherwise(fall / fraction / math.sqrt(2 * math.pi))

    return _of(col(z).cast("double"), lambda v: F.when(v > 0, 1.0 - upper(v)).otherwise(upper(-v)))


def phi_inv(p: Column | str) -> Column:
    """Standard normal quantile; NULL outside (0, 1)."""

    def quantile(v: Column) -> Column:
        q = v - 0.5
        r = 0.180625 - q * q
        middle = q * _polynomial(r, _MIDDLE[0]) / _polynomial(r, _MIDDLE[1])
        tail = _of(F.sqrt(-F.log(F.least(v, 1.0 - v))), lambda t: F.when(t <= 5, _polynomial(t - 1.6, _NEAR[0]) / _polynomial(t - 1.6, _NEAR[1])).otherwise(_polynomial(t - 5, _FAR[0]) / _polynomial(t - 5, _FAR[1])))
        return F.when(F.abs(q) <= 0.425, middle).otherwise(F.signum(q) * tail)

    return _of(col(p).cast("double"), lambda v: F.when((v > 0) & (v < 1), quantile(v)))
