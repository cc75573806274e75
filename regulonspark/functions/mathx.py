"""Normal distribution functions as SQL expressions of built-in functions.

Each text function takes the SQL text of its argument and returns SQL text that
Spark and other engines evaluate alike, so that they stay inside generated
code and a query can be checked elsewhere with the very same formula. The functions
of frames below them add the same values as a column, step by step, so that
nothing is computed twice and plans stay small however they are nested.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 2.0**-52

# Algorithm AS 241 (PPND16), lowest power first.
_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
      4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
      2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
      1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
      1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
_E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
      2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
      7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)
# Hart's rational approximation of the normal tail, lowest power first.
_P = (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 0.0352624965998911)
_Q = (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184)
_SWITCH = 7.07106781186547
_ROOT_2PI = 2.506628274631


def _num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _poly(coefficients, x: str) -> str:
    out = _num(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * ({x}) + {_num(c)})"
    return out


def clamp(p: str) -> str:
    return f"least(greatest({p}, {_num(EPS)}), {_num(1 - EPS)})"


def _tail(r: str) -> str:
    """The upper quantile of p for r = sqrt(-ln p), p below 0.075."""
    near, far = f"({r} - 1.6)", f"({r} - 5.0)"
    return (f"CASE WHEN {r} <= 5 THEN {_poly(_C, near)} / {_poly(_D, near)} "
            f"ELSE {_poly(_E, far)} / {_poly(_F, far)} END")


def ppf(p: str) -> str:
    """Normal quantile; p is clamped to [eps, 1 - eps]."""
    p = f"({clamp(p)})"
    q, s = f"({p} - 0.5)", f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))"
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    return (f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {_poly(_A, s)} / {_poly(_B, s)} "
            f"WHEN {q} < 0 THEN -({_tail(r)}) ELSE {_tail(r)} END")


def _ratio(a: str) -> str:
    """sf(a) * exp(a * a / 2) for a >= 0."""
    cf = a
    for k in (0.65, 4, 3, 2, 1):
        cf = f"({a} + {_num(k)})" if k == 0.65 else f"({a} + {k} / {cf})"
    return (f"CASE WHEN {a} < {_num(_SWITCH)} THEN {_poly(_P, a)} / {_poly(_Q, a)} "
            f"ELSE 1 / ({cf} * {_num(_ROOT_2PI)}) END")


def sf(x: str) -> str:
    """Upper tail of the normal distribution."""
    a = f"abs({x})"
    tail = f"(CASE WHEN {a} > 38 THEN {_num(0.0)} ELSE exp(-0.5 * {a} * {a}) * ({_ratio(a)}) END)"
    return f"CASE WHEN ({x}) >= 0 THEN {tail} ELSE 1 - {tail} END"


def cdf(x: str) -> str:
    return sf(f"(-({x}))")


def logsf(x: str) -> str:
    """Logarithm of the upper tail, also far out."""
    a = f"abs({x})"
    log_tail = f"(-0.5 * {a} * {a} + ln({_ratio(a)}))"
    return f"CASE WHEN ({x}) >= 0 THEN {log_tail} ELSE ln(1 - exp({log_tail})) END"


def log_quantile(lp: str) -> str:
    """Upper quantile of exp(lp), lp <= ln 0.5."""
    p = f"exp({lp})"
    q, s = f"(0.5 - {p})", f"(0.180625 - (0.5 - {p}) * (0.5 - {p}))"
    r = f"sqrt(-({lp}))"
    return (f"CASE WHEN ({lp}) >= {_num(-2.590267165445827)} THEN {q} * {_poly(_A, s)} / {_poly(_B, s)} "
            f"ELSE {_tail(r)} END")


def sigmoid(x: str, slope: str = "20", inflection: str = "0.5") -> str:
    return f"1 / (1 + exp(-({slope}) * (({x}) - ({inflection}))))"


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def _far_quantile(r: Column) -> Column:
    """The upper quantile of p for r = sqrt(-ln p), p below 0.075."""
    near, far = r - 1.6, r - 5.0
    return F.when(r <= 5, _horner(_C, near) / _horner(_D, near)).otherwise(_horner(_E, far) / _horner(_F, far))


def _middle_quantile(q: Column, s: Column) -> Column:
    return q * _horner(_A, s) / _horner(_B, s)


def add_ppf(frame: DataFrame, p: str, out: str) -> DataFrame:
    """``frame`` with the normal quantile of column ``p``, clamped to [eps, 1 - eps], as column ``out``."""
    c = F.col("_p")
    f = frame.withColumn("_p", F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS)))
    f = f.withColumns({"_q": c - 0.5, "_s": 0.180625 - (c - 0.5) * (c - 0.5), "_r": F.sqrt(-F.log(F.least(c, 1 - c)))})
    q, s, r = F.col("_q"), F.col("_s"), F.col("_r")
    value = F.when(F.abs(q) <= 0.425, _middle_quantile(q, s)).otherwise(F.signum(q) * _far_quantile(r))
    return f.withColumn(out, value).drop("_p", "_q", "_s", "_r")


def add_logsf(frame: DataFrame, x: Column, out: str) -> DataFrame:
    """``frame`` with the logarithm of the normal's upper tail at ``x`` as column ``out``."""
    f = frame.withColumn("_x", x).withColumn("_a", F.abs("_x"))
    a = F.col("_a")
    cf = a + 0.65
    for k in (4, 3, 2, 1):
        cf = a + k / cf
    ratio = F.when(a < _SWITCH, _horner(_P, a) / _horner(_Q, a)).otherwise(1 / (cf * _ROOT_2PI))
    f = f.withColumn("_t", ratio).withColumn("_t", -0.5 * a * a + F.log("_t"))
    return f.withColumn(out, F.when(F.col("_x") >= 0, F.col("_t")).otherwise(F.log(1 - F.exp("_t")))).drop("_x", "_a", "_t")


def add_log_quantile(frame: DataFrame, lp: str, out: str) -> DataFrame:
    """``frame`` with the upper quantile of exp(``lp``), lp <= ln 0.5, as column ``out``."""
    q = 0.5 - F.exp(lp)
    f = frame.withColumns({"_q": q, "_s": 0.180625 - q * q, "_r": F.sqrt(-F.col(lp))})
    value = F.when(F.col(lp) >= -2.590267165445827, _middle_quantile(F.col("_q"), F.col("_s"))).otherwise(_far_quantile(F.col("_r")))
    return f.withColumn(out, value).drop("_q", "_s", "_r")


def upper_tails(x: np.ndarray) -> np.ndarray:
    """The formula of :func:`sf` over an array."""
    a, far = np.abs(x), np.abs(x) >= _SWITCH
    near = np.minimum(a, _SWITCH)
    ratio = _horners(_P, near) / _horners(_Q, near)
    if far.any():
        ratio[far] = 1 / (_fraction(a[far]) * _ROOT_2PI)
    tail = np.where(a > 38, 0.0, np.exp(-0.5 * a * a) * ratio)
    return np.where(x >= 0, tail, 1 - tail)


def _horners(coefficients, x: np.ndarray) -> np.ndarray:
    out = np.full_like(x, coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out *= x
        out += c
    return out


def _fraction(a: np.ndarray) -> np.ndarray:
    out = a + 0.65
    for k in (4, 3, 2, 1):
        out = a + k / out
    return out
