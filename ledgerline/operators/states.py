"""Measures of series that grow, without reading them again.

A state is one row for a stretch of a series: its growth, how high and low its curve gets, its worst fall, and counts,
means and squared or crossed deviations of its returns, alone and beside the benchmark's. The states of two stretches that follow
each other merge to the state of both, so a day's batch is turned into states by itself and merged into what is stored. Measures
are read off the state. Value at risk and expected shortfall are not among them: they need the returns (``operators.quantiles``).

Returns are above -1 or -1, as prices are; the worst fall of a stretch with another is NULL. NULL keys are a series of their own.
The rate that downside deviations are counted against is fixed when a state is made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import measures as M
from ledgerline.operators import series
from ledgerline.operators.scans import joined

MEASURES = tuple(m for m in series.MEASURES if m not in ("var_95", "cvar_95"))


def moments_of(x: Column, y: Column | None = None) -> Column:
    """Count, means and deviations of x, or of x and y where neither is NULL."""
    if y is None:
        n = F.count(x).cast("double")
        return F.struct(n.alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("x"), F.coalesce(F.var_pop(x) * n, F.lit(0.0)).alias("xx"))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n, zero = F.count(x).cast("double"), F.lit(0.0)
    return F.struct(
        n.alias("n"), F.coalesce(F.avg(x), zero).alias("x"), F.coalesce(F.avg(y), zero).alias("y"), F.coalesce(F.var_pop(x) * n, zero).alias("xx"),
        F.coalesce(F.var_pop(y) * n, zero).alias("yy"), F.coalesce(F.covar_pop(x, y) * n, zero).alias("xy"),
    )


def merged_moments(a: Column, b: Column, fields: Sequence[str]) -> Column:
    """``fields``: x and xx, or x, y, xx, yy and xy."""
    n = a["n"] + b["n"]
    delta = {f: b[f] - a[f] for f in fields if len(f) == 1}
    means = [(a[f] + d * b["n"] / n).alias(f) for f, d in delta.items()]
    squares = [(a[f] + b[f] + delta[f[0]] * delta[f[1]] * a["n"] * b["n"] / n).alias(f) for f in fields if len(f) == 2]
    return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(F.struct(n.alias("n"), *means, *squares))


ONE, TWO = ("x", "xx"), ("x", "y", "xx", "yy", "xy")


def of_returns(returns: DataFrame, keys: Sequence[str], rf: Column) -> DataFrame:
    """keys and ``state`` of ``returns`` (keys, date, ret, other). One shuffle by the keys; a stretch is as long as one task bears."""
    rows = series.with_drawdown(returns, list(keys))
    ret, other = F.col("ret"), F.col("other")
    down = F.sum(F.pow(F.least(ret - M.daily_rate(rf), F.lit(0.0)), 2))
    state = F.struct(
        F.count(F.lit(1)).alias("rows"), F.product(1 + F.coalesce(ret, F.lit(0.0))).alias("growth"), F.max("curve").alias("high"), F.min("curve").alias("low"),
        F.when(F.min(F.coalesce(ret, F.lit(0.0))) >= -1, F.min("drawdown")).alias("fall"), F.coalesce(down, F.lit(0.0)).alias("down"), moments_of(ret).alias("own"),
        moments_of(ret, other).alias("pair"), moments_of(ret - other).alias("active"),
    )
    return rows.groupBy(*keys).agg(state.alias("state"))


def followed(a: Column, b: Column) -> Column:
    """The state of a stretch and the next one."""
    across = F.round(F.try_divide(a["growth"] * b["low"], a["high"]) - 1, 12)
    fall = F.when(a["fall"].isNotNull() & b["fall"].isNotNull(), F.least(a["fall"], b["fall"], across))
    return F.struct(
        (a["rows"] + b["rows"]).alias("rows"), (a["growth"] * b["growth"]).alias("growth"), F.greatest(a["high"], a["growth"] * b["high"]).alias("high"),
        F.least(a["low"], a["growth"] * b["low"]).alias("low"), fall.alias("fall"), (a["down"] + b["down"]).alias("down"), merged_moments(a["own"], b["own"], ONE).alias("own"),
        merged_moments(a["pair"], b["pair"], TWO).alias("pair"), merged_moments(a["active"], b["active"], ONE).alias("active"),
    )


def merged(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``stored`` states followed by those of a later ``batch``; series of one side only stay as they are. ``keys`` are one row each."""
    later = batch.withColumnRenamed("state", "later_")
    old = joined(stored, later, keys, "left")
    old = old.select(*keys, F.when(F.col("later_").isNull(), F.col("state")).otherwise(followed(F.col("state"), F.col("later_"))).alias("state"))
    return old.unionByName(joined(batch, stored.select(*keys), keys, "left_anti"))


def measures(states: DataFrame, keys: Sequence[str], rf: Column) -> DataFrame:
    """keys and MEASURES, as ``series.measure_table`` has them. ``rf`` is the rate that the states were made with."""
    s, daily = F.col("state"), M.daily_rate(rf)
    own, pair, active = s["own"], s["pair"], s["active"]

    def sd(of: Column, field: str = "xx") -> Column:
        return F.when(of["n"] > 1, F.sqrt(F.greatest(of[field], F.lit(0.0)) / (of["n"] - 1)))

    root = M.DAYS**0.5
    excess, down = (own["x"] - daily) * M.DAYS, F.sqrt(F.try_divide(s["down"], own["n"]))
    beta = M.ratio(pair["xy"], pair["yy"], sd(pair, "yy") >= M.ZERO)
    correlation = M.ratio(pair["xy"] / (pair["n"] - 1), sd(pair) * sd(pair, "yy"), (sd(pair) >= M.ZERO) & (sd(pair, "yy") >= M.ZERO))
    cagr = F.when(s["growth"] > 0, F.pow(s["growth"], F.lit(float(M.DAYS)) / s["rows"]) - 1)
    values = {
        "cagr": cagr, "volatility": F.when(sd(own) < M.ZERO, 0.0).otherwise(sd(own) * root), "sharpe": M.ratio(excess, sd(own) * root, sd(own) >= M.ZERO),
        "sortino": M.ratio(excess, down * root, (own["n"] >= 2) & (down >= M.ZERO)), "max_drawdown": s["fall"],
        "calmar": F.when(s["fall"] < 0, F.try_divide(cagr, F.abs(s["fall"]))), "beta": beta, "alpha": (pair["x"] - daily - beta * (pair["y"] - daily)) * M.DAYS,
        "tracking_error": sd(active) * root, "information_ratio": M.ratio(active["x"] * M.DAYS, sd(active) * root, sd(active) >= M.ZERO),
        "correlation": correlation, "r_squared": F.pow(correlation, 2),
    }
    return states.select(*keys, *(values[m].alias(m) for m in MEASURES))
