"""Return series: growth curves, drawdowns and their episodes, rolling and monthly views, and the
table of fourteen measures. Input: key columns, date, ret and (for relative measures) other, the
benchmark's return on the same row. One shuffle by the keys serves windows and aggregates alike.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import measures as M
from ledgerline.operators import moments

ROLLING_DAYS, TOP = 252, 3
MEASURES = (
    "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "beta", "alpha", "tracking_error",
    "information_ratio", "var_95", "cvar_95", "correlation", "r_squared",
)


def daily_returns(prices: DataFrame, keys: list[str]) -> DataFrame:
    """ret is NULL on a series' first date."""
    w = Window.partitionBy(*keys).orderBy("date")
    return prices.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)


def with_drawdown(returns: DataFrame, keys: list[str]) -> DataFrame:
    """The growth curve and its fall from the running peak, which starts at the first point of the
    curve. The fall is rounded to 12 digits, so that a curve that is back at its peak but for the last
    bits of its product counts as recovered, and equal troughs as equal."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("curve", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w))
    return out.withColumn("drawdown", F.round(F.try_divide(F.col("curve"), F.max("curve").over(w)) - 1, 12))


def episodes(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Each stretch under water: keys, peak, trough, recovery, depth, days_to_recover."""
    w = Window.partitionBy(*keys).orderBy("date")
    rows = with_drawdown(returns, keys).withColumn("under", F.col("drawdown") < 0)
    change = F.when(F.col("under") & ~F.coalesce(F.lag("under").over(w), F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("before", F.coalesce(F.lag("date").over(w), F.col("date"))).withColumn("after", F.lead("date").over(w)).withColumn("starts", change)
    rows = rows.withColumn("episode", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("under")
    return rows.groupBy(*keys, "episode").agg(
        F.min("before").alias("peak"), F.min(F.struct("drawdown", "date")).alias("low"), F.max(F.struct("date", "after")).alias("end"), F.count(F.lit(1)).alias("days"),
    ).select(
        *keys, "peak", F.col("low.date").alias("trough"), F.col("end.after").alias("recovery"), F.col("low.drawdown").alias("depth"),
        F.when(F.col("end.after").isNotNull(), F.col("days")).alias("days_to_recover"),
    )


def top_episodes(returns: DataFrame, keys: list[str], n: int = TOP) -> DataFrame:
    """The deepest episodes of each series; equal depths in the order of their peaks."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("depth", "peak"))
    return episodes(returns, keys).withColumn("rank", rank).where(F.col("rank") <= n)


def rolling_sharpe(returns: DataFrame, keys: list[str], rf: Column, days: int = ROLLING_DAYS) -> DataFrame:
    """NULL until the window holds ``days`` returns, and where its deviation is zero."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("date"))
    rows = moments.trailing(returns.withColumn("place", place), keys, F.col("ret") - M.daily_rate(rf), days)
    value = F.try_divide(F.col("state.mean"), moments.deviation(F.col("state"))) * sqrt(M.DAYS)
    return rows.withColumn("rolling_sharpe", F.when(F.col("state.n") == days, value)).drop("place", "state")


def monthly_returns(returns: DataFrame, keys: list[str]) -> DataFrame:
    return returns.where("ret IS NOT NULL").groupBy(*keys, F.year("date").alias("year"), F.month("date").alias("month")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))


def monthly_grid(returns: DataFrame, keys: list[str]) -> DataFrame:
    """One row per year, columns m1 to m12; months without returns are NULL."""
    wide = monthly_returns(returns, keys).groupBy(*keys, "year").pivot("month", list(range(1, 13))).agg(F.first("ret"))
    return wide.select(*keys, "year", *(F.col(str(m)).alias(f"m{m}") for m in range(1, 13)))


def measure_table(returns: DataFrame, keys: list[str], rf: Column) -> DataFrame:
    """One row per series with all fourteen measures; rf may be a column of ``returns``."""
    rows = with_drawdown(returns, keys)
    rows = rows.withColumn("tail", M.tail_quantile(F.col("ret")).over(Window.partitionBy(*keys)))
    ret, other, daily = F.col("ret"), F.col("other"), M.daily_rate(rf)
    both = ret.isNotNull() & other.isNotNull()
    rows = rows.withColumns({
        "excess": ret - daily, "pair": F.when(both, ret - daily), "pair_other": F.when(both, other - daily),
        "active": F.when(both, ret - other), "own": F.when(both, ret), "bench": F.when(both, other),
    })
    c = F.col
    out = rows.groupBy(*keys).agg(
        M.cagr(ret).alias("cagr"), M.volatility(ret).alias("volatility"), M.sharpe(c("excess")).alias("sharpe"), M.sortino(c("excess")).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"), M.beta(c("pair"), c("pair_other")).alias("beta"), M.alpha(c("pair"), c("pair_other")).alias("alpha"),
        M.tracking_error(c("active")).alias("tracking_error"), M.information_ratio(c("active")).alias("information_ratio"),
        (-F.max("tail")).alias("var_95"), (-F.avg(F.when(ret <= c("tail"), ret))).alias("cvar_95"),
        M.correlation(c("own"), c("bench")).alias("correlation"), F.pow(M.correlation(c("pair"), c("pair_other")), 2).alias("r_squared"),
    )
    return out.withColumn("calmar", F.when(c("max_drawdown") < 0, F.try_divide(c("cagr"), F.abs("max_drawdown")))).select(*keys, *MEASURES)


def both_series(daily: DataFrame, keys: list[str]) -> DataFrame:
    """A run's portfolio and benchmark as two labelled series; the benchmark is its own reference."""
    pairs = F.array(*(F.struct(F.lit(s).alias("series"), F.col(c).alias("ret"), F.col("benchmark_return").alias("other")) for s, c in (("portfolio", "portfolio_return"), ("benchmark", "benchmark_return"))))
    return daily.select(*keys, "date", *(c for c in ("risk_free_rate",) if c in daily.columns), F.explode(pairs).alias("s")).select("*", "s.*").drop("s")


def long_measures(table: DataFrame, keys: list[str]) -> DataFrame:
    """key columns, measure, value: one row per measure."""
    return table.unpivot(keys, list(MEASURES), "measure", "value")


def measures_by_series(table: DataFrame, keys: list[str], series: tuple[str, ...] = ("portfolio", "benchmark")) -> DataFrame:
    """One row per measure of each run, a column per series. ``table``: keys, series and the measures."""
    long = long_measures(table, [*keys, "series"])
    return long.groupBy(*keys, "measure").pivot("series", list(series)).agg(F.first("value"))
