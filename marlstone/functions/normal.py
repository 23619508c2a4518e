"""The normal distribution as column expressions, and as the same SQL text.

Both are quotients of polynomials, evaluated inside the row by Horner's rule, so
that nothing leaves the JVM and any engine gives the same digits: the CDF in
Hart's form, its inverse in Wichura's (AS 241), both to about 1e-15.
"""

from __future__ import annotations

import sys
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

# Published coefficients, highest power first.
_HART = (
    (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376),
    (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752),
)
_MIDDLE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
_NEAR = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)
_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)
#: Where the CDF's middle form ends; how far probabilities are kept off 0 and 1.
_EDGE, _LEAST, _ROOT = 7.07106781186547, 1e-12, 2.5066282746310002


def once(value: Column, f) -> Column:
    """``f`` of a value that is taken once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _quotient(form: tuple[tuple[float, ...], ...], x: Column) -> Column:
    top, below = (reduce(lambda acc, c: acc * x + F.lit(c), row[1:], F.lit(row[0])) for row in form)
    return top / below


def normal_cdf(z: Column) -> Column:
    def of(z: Column) -> Column:
        a = F.abs(z)
        far = 1.0 / ((a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))) * _ROOT)
        tail = F.exp(-z * z / 2) * F.when(a < _EDGE, _quotient(_HART, a)).otherwise(far)
        return F.when(a > 38, 0.0).otherwise(tail)

    return once(z.cast("double"), lambda z: F.when(z > 0, 1.0 - of(z)).otherwise(of(z)))


def normal_quantile(p: Column) -> Column:
    """Inverse of the CDF; probabilities are kept off 0 and 1."""

    def of(p: Column) -> Column:
        q = p - 0.5
        outer = once(F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1.0 - p))), lambda r: F.when(r <= 5, _quotient(_NEAR, r - 1.6)).otherwise(_quotient(_FAR, r - 5.0)))
        middle = q * _quotient(_MIDDLE, 0.180625 - q * q)
        return F.when(F.abs(q) <= 0.425, middle).when(q < 0, -outer).otherwise(outer)

    p = p.cast("double")
    return once(F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(_LEAST)), F.lit(1 - _LEAST))), of)


def _quotient_sql(form: tuple[tuple[float, ...], ...], x: str) -> str:
    top, below = (reduce(lambda acc, c: f"({acc} * {x} + {c!r}::DOUBLE)", row[1:], f"{row[0]!r}::DOUBLE") for row in form)
    return f"({top} / {below})"


def normal_cdf_sql(z: str) -> str:
    tail = f"(CASE WHEN abs(z) > 38 THEN 0.0::DOUBLE ELSE exp(-z * z / 2) * (CASE WHEN abs(z) < {_EDGE} THEN {_quotient_sql(_HART, 'abs(z)')} ELSE 1.0 / ((abs(z) + 1.0 / (abs(z) + 2.0 / (abs(z) + 3.0 / (abs(z) + 4.0 / (abs(z) + 0.65))))) * {_ROOT}::DOUBLE) END) END)"
    return f"list_transform([({z})::DOUBLE], lambda z: CASE WHEN z > 0 THEN 1.0 - {tail} ELSE {tail} END)[1]"


def normal_quantile_sql(p: str) -> str:
    outer = f"list_transform([sqrt(-ln(CASE WHEN p < 0.5 THEN p ELSE 1.0 - p END))], lambda r: CASE WHEN r <= 5 THEN {_quotient_sql(_NEAR, '(r - 1.6::DOUBLE)')} ELSE {_quotient_sql(_FAR, '(r - 5.0::DOUBLE)')} END)[1]"
    of = f"CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * {_quotient_sql(_MIDDLE, '(0.180625::DOUBLE - (p - 0.5) * (p - 0.5))')} WHEN p < 0.5 THEN -{outer} ELSE {outer} END"
    return f"list_transform([least(greatest(({p})::DOUBLE, {_LEAST}::DOUBLE), {1 - _LEAST!r}::DOUBLE)], lambda p: {of})[1]"


def _general(x: pd.Series) -> pd.Series:
    return x.map(lambda v: f"{v:.4g}", na_action="ignore")


def general(x: Column) -> Column:
    """Four significant digits, without trailing zeros, which Spark SQL lacks."""
    return F.pandas_udf(_general, "string")(x)
