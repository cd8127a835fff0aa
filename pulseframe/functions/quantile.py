"""Standard normal quantile as a Spark expression (no Python worker).

Wichura (1988), Algorithm AS 241, PPND16: a ratio of two polynomials in each of three ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed values of AS 241, highest power first.
CENTRE_NUM = (
    2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
    13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080,
)
CENTRE_DEN = (
    5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867,
    5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0,
)
MIDDLE_NUM = (
    7.74545014278341407640e-4, 0.0227238449892691845833, 0.241780725177450611770,
    1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550,
    4.63033784615654529590, 1.42343711074968357734,
)
MIDDLE_DEN = (
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 0.0151986665636164571966,
    0.148103976427480074590, 0.689767334985100004550, 1.67638483018380384940,
    2.05319162663775882187, 1.0,
)
TAIL_NUM = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.00124266094738807843860,
    0.0265321895265761230930, 0.296560571828504891230, 1.78482653991729133580,
    5.46378491116411436990, 6.65790464350110377720,
)
TAIL_DEN = (
    2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
    7.86869131145613259100e-4, 0.0148753612908506148525, 0.136929880922735805310,
    0.599832206555887937690, 1.0,
)
CENTRE_HALF_WIDTH = 0.425
CENTRE_OFFSET = 0.180625
MIDDLE_LIMIT = 5.0
MIDDLE_SHIFT = 1.6


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda total, c: total * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p: Column) -> Column:
    """x with P(Z <= x) = p for 0 < p < 1; null outside."""
    q = p - F.lit(0.5)
    near = F.lit(CENTRE_OFFSET) - q * q
    centre = q * _polynomial(near, CENTRE_NUM) / _polynomial(near, CENTRE_DEN)
    distance = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    middle = distance - F.lit(MIDDLE_SHIFT)
    tail = distance - F.lit(MIDDLE_LIMIT)
    size = F.when(
        distance <= MIDDLE_LIMIT, _polynomial(middle, MIDDLE_NUM) / _polynomial(middle, MIDDLE_DEN)
    ).otherwise(_polynomial(tail, TAIL_NUM) / _polynomial(tail, TAIL_DEN))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= CENTRE_HALF_WIDTH, centre).otherwise(F.signum(q) * size))
