"""Normal and chi-square functions as Column expressions.

Spark has no erf, so the normal distribution uses the published
double-precision rational form of Hart, in West's arrangement, and the quantile
uses Acklam's rational form with one Newton step on top.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published approximations.
CDF_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376]
CDF_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
CDF_SPLIT = 7.07106781186547
CDF_TAIL_SCALE = 2.506628274631
PPF_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
PPF_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01, 1.0]
PPF_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
PPF_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00, 1.0]
PPF_LOW = 0.02425
SQRT_2PI = 2.5066282746310002


def _horner(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def bind(x: Column, fn) -> Column:
    """``fn`` of a value evaluated once.

    Repeating a long expression inside another multiplies the plan's size; a
    lambda variable keeps it linear. Meant for aggregated rows.
    """
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def norm_cdf(x: Column) -> Column:
    """P(Z <= x); null stays null."""
    return bind(x, _cdf)


def _cdf(x: Column) -> Column:
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    near = e * _horner(CDF_NUM, a) / _horner(CDF_DEN, a)
    frac = a + F.lit(0.65)
    for k in (4, 3, 2, 1):
        frac = a + F.lit(float(k)) / frac
    far = e / frac / F.lit(CDF_TAIL_SCALE)
    tail = F.when(a > 37, F.lit(0.0)).when(a < CDF_SPLIT, near).otherwise(far)
    return F.when(x.isNull(), F.lit(None)).when(x > 0, 1 - tail).otherwise(tail)


def norm_ppf(p: Column) -> Column:
    """Quantile of the standard normal for p strictly between 0 and 1, else null."""
    return bind(p, lambda v: bind(_ppf_start(v), lambda z: (
        z - (norm_cdf(z) - v) * F.lit(SQRT_2PI) * F.exp(z * z / 2))))


def _ppf_start(p: Column) -> Column:
    q = p - 0.5
    r = q * q
    mid = q * _horner(PPF_A, r) / _horner(PPF_B, r)
    lo = F.sqrt(-2 * F.ln(p))
    hi = F.sqrt(-2 * F.ln(1 - p))
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < PPF_LOW, _horner(PPF_C, lo) / _horner(PPF_D, lo))
        .when(p > 1 - PPF_LOW, -_horner(PPF_C, hi) / _horner(PPF_D, hi))
        .otherwise(mid)
    )


def z_value(p: float) -> float:
    """Quantile of a literal probability, worked out on the driver."""
    return NormalDist().inv_cdf(p)


def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail of a chi-square variate with 1 or 2 degrees of freedom."""
    if df == 1:
        tail = 2 * norm_cdf(-F.sqrt(F.greatest(x, F.lit(0.0))))
    elif df == 2:
        tail = F.exp(-x / 2)
    else:
        raise ValueError("only 1 and 2 degrees of freedom are supported")
    return F.when(x <= 0, F.lit(1.0)).otherwise(tail)


def bernoulli_ll(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k hits in n trials at rate p, with 0*log 0 taken as 0."""
    minus_inf = F.lit(float("-inf"))
    hits = F.when(k <= 0, F.lit(0.0)).when(p > 0, k * F.ln(p)).otherwise(minus_inf)
    rest = n - k
    misses = F.when(rest <= 0, F.lit(0.0)).when(p < 1, rest * F.ln(1 - p)).otherwise(minus_inf)
    return F.when(n == 0, F.lit(0.0)).otherwise(hits + misses)
