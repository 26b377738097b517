"""Return and risk measures as aggregate Column expressions.

Every measure is a plain Column, so one ``groupBy`` can hold as many as needed
and Spark computes them in a single pass with map-side partial aggregation.
Skew and kurtosis standardise with the n-1 deviation but average over n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.normal import norm_cdf, norm_ppf, z_value

EULER_GAMMA = 0.5772156649
TINY_SD = 1e-15
PERIODS = 252


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moments(r: str | Column, prefix: str = "") -> list[Column]:
    """n, mean, sd, skew and kurtosis columns; read later by the scalar forms below."""
    r = _col(r)
    n = F.count(r)
    shrink = (n - 1) / n
    return [
        n.alias(f"{prefix}n"),
        F.avg(r).alias(f"{prefix}mean"),
        F.stddev_samp(r).alias(f"{prefix}sd"),
        F.when(F.stddev_samp(r) >= TINY_SD, F.skewness(r) * F.pow(shrink, F.lit(1.5))).alias(f"{prefix}skew"),
        F.when(F.stddev_samp(r) >= TINY_SD, (F.kurtosis(r) + 3) * shrink * shrink).alias(f"{prefix}kurt"),
    ]


def period_sharpe(mean: Column, sd: Column) -> Column:
    """Mean over deviation per period; zero when the series does not move."""
    return F.when(sd < TINY_SD, F.lit(0.0)).otherwise(F.try_divide(mean, sd))


def sharpe(r: str | Column, periods: int = PERIODS) -> Column:
    r = _col(r)
    return period_sharpe(F.avg(r), F.stddev_samp(r)) * math.sqrt(periods)


def probabilistic_sharpe_of(n: Column, mean: Column, sd: Column, skew: Column, kurt: Column,
                            benchmark: Column | float = 0.0, periods: int = PERIODS) -> Column:
    """P(true ratio > benchmark) from a row of moments; null for n < 3 or no movement."""
    sr = period_sharpe(mean, sd)
    bench = (F.lit(benchmark) if isinstance(benchmark, (int, float)) else benchmark) / math.sqrt(periods)
    spread = F.try_divide(1 - skew * sr + (kurt - 1) / 4 * sr * sr, n - 1)
    z = (sr - bench) / F.sqrt(F.greatest(F.lit(1e-12), spread))
    return F.when((n >= 3) & (sd >= TINY_SD), norm_cdf(z))


def expected_max_sharpe(n_trials: Column, variance: Column, periods: int = PERIODS) -> Column:
    """Best annualised ratio expected from noise alone over ``n_trials`` tries."""
    first = norm_ppf(1 - 1 / n_trials)
    second = norm_ppf(1 - 1 / (n_trials * math.e))
    best = F.sqrt(variance) * ((1 - EULER_GAMMA) * first + EULER_GAMMA * second) * math.sqrt(periods)
    return F.when(n_trials < 2, F.lit(0.0)).otherwise(best)


def min_track_record_of(n: Column, mean: Column, sd: Column, skew: Column, kurt: Column,
                        benchmark: float = 0.0, confidence: float = 0.95, periods: int = PERIODS) -> Column:
    """Observations needed before the ratio differs from the benchmark."""
    gap = period_sharpe(mean, sd) - benchmark / math.sqrt(periods)
    sr = period_sharpe(mean, sd)
    still = sd < TINY_SD
    skew0 = F.when(still, F.lit(0.0)).otherwise(skew)
    kurt0 = F.when(still, F.lit(0.0)).otherwise(kurt)
    ratio = F.try_divide(F.lit(z_value(confidence)), gap)
    need = 1 + (1 - skew0 * sr + (kurt0 - 1) / 4 * sr * sr) * ratio * ratio
    return F.when(F.abs(gap) < 1e-12, F.lit(float("inf"))).otherwise(need)


def volatility(r: str | Column, periods: int = PERIODS) -> Column:
    return F.stddev_samp(_col(r)) * math.sqrt(periods)


def historical_var(r: str | Column, alpha: float = 0.95) -> Column:
    """Exact interpolated quantile of the loss."""
    return -F.percentile(_col(r), F.lit(1 - alpha))


def historical_var_approx(r: str | Column, alpha: float = 0.95, accuracy: int = 10000) -> Column:
    """Sketch form for very long ungrouped series; opt-in, it does not interpolate."""
    return -F.percentile_approx(_col(r), F.lit(1 - alpha), F.lit(accuracy))


def gaussian_var(r: str | Column, alpha: float = 0.95) -> Column:
    r = _col(r)
    return -(F.avg(r) - z_value(alpha) * F.stddev_samp(r))


def cornish_fisher_var_of(mean: Column, sd: Column, skew: Column, kurt: Column, alpha: float = 0.95) -> Column:
    """Quantile expansion at the left-tail point, from a row of moments."""
    z = z_value(1 - alpha)
    k = kurt - 3
    zc = z + (z**2 - 1) * skew / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * skew * skew / 36
    return F.when(sd < TINY_SD, F.lit(0.0)).otherwise(-(mean + zc * sd))


def cornish_fisher_var(r: str | Column, alpha: float = 0.95) -> Column:
    _, mean, sd, skew, kurt = moments(r)
    return cornish_fisher_var_of(mean, sd, skew, kurt, alpha)


def expected_shortfall(r: str | Column, cut: str | Column) -> Column:
    """Mean loss at or beyond ``cut`` (the signed quantile, constant in the group)."""
    r, cut = _col(r), _col(cut)
    return -F.coalesce(F.avg(F.when(r <= cut, r)), F.max(cut))
