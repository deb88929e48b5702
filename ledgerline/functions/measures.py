"""Return and risk measures as column expressions, for use in any ``agg``.

Undefined measures are NULL. Ratios are guarded, as a division by zero is an error in ANSI mode.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = 252
#: A deviation below this counts as none.
ZERO = 1e-12
CONFIDENCE = 0.95


def daily_rate(annual: Column) -> Column:
    return F.pow(1 + annual, F.lit(1 / DAYS)) - 1


def ratio(a: Column, b: Column, defined: Column | None = None) -> Column:
    return F.when(F.lit(True) if defined is None else defined, F.try_divide(a, b))


def cagr(ret: Column) -> Column:
    """Missing returns count as zero and as days."""
    growth, n = F.product(1 + F.coalesce(ret, F.lit(0.0))), F.count(F.lit(1))
    return F.when((n > 0) & (growth > 0), F.pow(growth, F.lit(float(DAYS)) / n) - 1)


def volatility(ret: Column) -> Column:
    s = F.stddev_samp(ret)
    return F.when(s < ZERO, 0.0).otherwise(s * sqrt(DAYS))


def sharpe(excess: Column) -> Column:
    s = F.stddev_samp(excess)
    return ratio(F.avg(excess) * DAYS, s * sqrt(DAYS), s >= ZERO)


def sortino(excess: Column) -> Column:
    """The downside deviation is over the full sample, which has to have two returns at least."""
    down = F.sqrt(F.avg(F.when(excess.isNotNull(), F.pow(F.least(excess, F.lit(0.0)), 2))))
    return ratio(F.avg(excess) * DAYS, down * sqrt(DAYS), (F.count(excess) >= 2) & (down >= ZERO))


def beta(excess: Column, other: Column) -> Column:
    """``other`` has to be NULL wherever ``excess`` is."""
    return F.when(F.stddev_samp(other) >= ZERO, F.regr_slope(excess, other))


def alpha(excess: Column, other: Column) -> Column:
    return F.when(F.stddev_samp(other) >= ZERO, F.regr_intercept(excess, other) * DAYS)


def correlation(a: Column, b: Column) -> Column:
    """From the covariance: the built-in one fails on constant series."""
    sa, sb = F.stddev_samp(a), F.stddev_samp(b)
    return ratio(F.covar_samp(a, b), sa * sb, (sa >= ZERO) & (sb >= ZERO))


def tracking_error(active: Column) -> Column:
    return F.stddev_samp(active) * sqrt(DAYS)


def information_ratio(active: Column) -> Column:
    s = F.stddev_samp(active)
    return ratio(F.avg(active) * DAYS, s * sqrt(DAYS), s >= ZERO)


def tail_quantile(ret: Column, confidence: float = CONFIDENCE) -> Column:
    return F.percentile(ret, F.lit(1.0 - confidence))
