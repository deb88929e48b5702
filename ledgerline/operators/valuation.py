"""Daily values of many portfolio runs net of costs, without a day loop.

Target weights depend on prices only, so value is a product over rebalance periods. In the period
after rebalance r, growth is G(t) = sum of w(r) * P(t) / P(r); at the next rebalance the drifted
weights are w(r) * P(t) / P(r) / G(t), turnover T is half the sum of absolute changes, and the
period multiplies the value by G * (1 - c * T). The running product over rebalance rows, joined
back to the days, gives every day's value. A day is valued before its trade; entry has turnover 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import calendar, weights
from ledgerline.sources.staging import written

BPS = 10_000.0


#: What a run's weights and growth depend on; cost, capital and rate come in last.
STRATEGY = ("panel_id", "weighting", "rebalance", "lookback_days", "tickers", "custom_weights")


def with_strategy(specs: DataFrame) -> DataFrame:
    """``specs`` with strategy_id, alike for runs that differ in costs, capital, rate or dates only."""
    used = {"lookback_days": "inverse_vol", "tickers": "custom", "custom_weights": "custom"}
    parts = [F.when(F.col("weighting") == used[c], F.col(c)).alias(c) if c in used else F.col(c) for c in STRATEGY]
    return specs.withColumn("strategy_id", F.md5(F.to_json(F.struct(*parts))))


def strategies(specs: DataFrame) -> DataFrame:
    """The different strategies of ``specs``, with their id as run_id."""
    return with_strategy(specs).select(F.col("strategy_id").alias("run_id"), *STRATEGY).dropDuplicates(["run_id"])


def run_dates(specs: DataFrame, panel: DataFrame) -> DataFrame:
    """The invested dates of each run: inverse volatility starts after its lookback, others at once."""
    w = Window.partitionBy("panel_id").orderBy("date")
    dates = panel.select("panel_id", "date").distinct().withColumn("place", F.row_number().over(w) - 1)
    warm_up = F.when(F.col("weighting") == "inverse_vol", F.col("lookback_days")).otherwise(0)
    return specs.join(dates, "panel_id").where(F.col("place") >= warm_up).drop("place")


def run_violations(specs: DataFrame, panel: DataFrame) -> DataFrame:
    """run_id, rule and what it concerns: custom runs of which a ticker was dropped, and inverse
    volatility runs whose panel is not longer than lookback + 1 dates."""
    dropped = specs.where("weighting = 'custom'").select("run_id", "panel_id", F.explode("tickers").alias("ticker"))
    dropped = dropped.join(panel.select("panel_id", "ticker").distinct(), ["panel_id", "ticker"], "left_anti")
    dates = panel.groupBy("panel_id").agg(F.count_distinct("date").alias("n"))
    short = specs.where("weighting = 'inverse_vol'").join(dates, "panel_id", "left").where(F.coalesce("n", F.lit(0)) <= F.col("lookback_days") + 1)
    return dropped.select("run_id", F.lit("a ticker of a custom run was dropped").alias("rule"), F.col("ticker").alias("subject")).unionByName(
        short.select("run_id", F.lit("history too short for the lookback").alias("rule"), F.coalesce("n", F.lit(0)).cast("string").alias("subject"))
    )


def trades(specs: DataFrame, dates: DataFrame) -> DataFrame:
    """run_id, panel_id, rebalance_date, weighting, lookback_days: entry and every scheduled date."""
    scheduled = calendar.rebalance_dates(dates.select("run_id", F.col("rebalance").alias("frequency"), "date"), ["run_id"]).select("run_id", "rebalance_date")
    entry = dates.groupBy("run_id").agg(F.min("date").alias("rebalance_date"))
    return entry.unionByName(scheduled).join(specs.select("run_id", "panel_id", "weighting", "lookback_days"), "run_id")


def planned(plans: DataFrame, panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trades of strategies (``plans``), and what each ticker is to weigh and how many units one unit of value buys."""
    all_trades = written(trades(plans, run_dates(plans, panel)), "trades")
    price = panel.select("panel_id", "ticker", F.col("date").alias("rebalance_date"), F.col("close").alias("trade_price"))
    targets = weights.target_weights(all_trades, plans, panel).join(price, ["panel_id", "ticker", "rebalance_date"])
    return all_trades, written(targets.withColumn("units", F.try_divide("weight", "trade_price")), "targets")


def strategy_steps(plans: DataFrame, panel: DataFrame, all_trades: DataFrame, targets: DataFrame) -> DataFrame:
    """strategy_id, panel_id, date, is_trade, rebalance_date (of the trade in force), growth since it and turnover."""
    dates = run_dates(plans, panel).select("run_id", "panel_id", "rebalance", "date")
    price = panel.select("panel_id", "ticker", "date", "close")

    # The trade in force on each day, valued before a trade of the day itself.
    w = Window.partitionBy("run_id").orderBy("date")
    days = dates.select("run_id", "panel_id", "date").join(all_trades.select("run_id", F.col("rebalance_date").alias("date"), F.lit(True).alias("is_trade")), ["run_id", "date"], "left")
    in_force = F.last(F.when(F.col("is_trade"), F.col("date")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    days = days.withColumn("rebalance_date", in_force)

    def held(on: DataFrame) -> DataFrame:
        """What each ticker is worth on the days ``on``, for one unit of value at the trade in force."""
        rows = on.where("rebalance_date IS NOT NULL").join(targets.select("run_id", "rebalance_date", "ticker", "units"), ["run_id", "rebalance_date"])
        return rows.join(price, ["panel_id", "ticker", "date"]).withColumn("part", F.col("units") * F.col("close"))

    growth = held(days).groupBy("run_id", "date").agg(F.sum("part").alias("growth"))

    # Turnover on the few days of trades: what each ticker drifted to against its new target.
    new = targets.select("run_id", F.col("rebalance_date").alias("date"), "ticker", F.col("weight").alias("target"))
    drifted = held(days.where("is_trade")).withColumn("whole", F.sum("part").over(Window.partitionBy("run_id", "date"))).join(new, ["run_id", "date", "ticker"])
    moved = F.abs(F.col("target") - F.try_divide(F.col("part"), F.col("whole")))
    turnover = drifted.groupBy("run_id", "date").agg((0.5 * F.sum(moved)).alias("turnover"))
    facts = growth.join(turnover, ["run_id", "date"], "left")
    out = days.join(facts, ["run_id", "date"], "left")
    return out.select(F.col("run_id").alias("strategy_id"), "panel_id", "date", "is_trade", "rebalance_date", "growth", "turnover")


def nav_daily(specs: DataFrame, panel: DataFrame, benchmark: DataFrame) -> DataFrame:
    """run_id, date, portfolio_value, portfolio_return, benchmark_value, benchmark_return, turnover,
    costs_paid. ``panel`` and ``benchmark`` (panel_id, ticker, date, close) are clean and aligned;
    runs with problems have to be left out of ``specs`` (operators/guard.py does it)."""
    return nav_of(specs, panel, benchmark, *planned(strategies(specs), panel))


def nav_of(specs: DataFrame, panel: DataFrame, benchmark: DataFrame, all_trades: DataFrame, targets: DataFrame) -> DataFrame:
    """``nav_daily`` from trades and targets that are there already."""
    steps = strategy_steps(strategies(specs), panel, all_trades, targets).join(benchmark.select("panel_id", "date", F.col("close").alias("level")), ["panel_id", "date"])
    rate = with_strategy(specs).select("run_id", "strategy_id", "initial_capital", (F.col("transaction_cost_bps") / BPS).alias("rate"))
    rows = rate.join(steps.drop("panel_id"), "strategy_id")
    w = Window.partitionBy("run_id").orderBy("date")
    first = F.col("rebalance_date").isNull()
    rows = rows.withColumn("turnover", F.when(first, 1.0).when(F.col("is_trade"), F.col("turnover")).otherwise(0.0))
    keep = 1 - F.col("rate") * F.col("turnover")
    factor = F.when(first, F.col("initial_capital") * keep).when(F.col("is_trade"), F.col("growth") * keep).otherwise(1.0)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # product() passes over NULL, but what follows a refused date has no value
    rows = rows.withColumn("base", F.when(F.min(factor.isNotNull()).over(upto), F.product(factor).over(upto)))
    value = F.when(first | F.col("is_trade"), F.col("base")).otherwise(F.col("base") * F.col("growth"))
    rows = rows.withColumn("portfolio_value", value)
    before = F.when(first, F.col("initial_capital")).otherwise(F.lag("base").over(w))
    cost = before * F.when(first, 1.0).otherwise(F.col("growth")) * F.col("turnover") * F.col("rate")
    rows = rows.withColumn("costs_paid", F.when(F.col("turnover") > 0, cost).otherwise(0.0))
    rows = rows.withColumn("portfolio_return", F.coalesce(F.try_divide(F.col("portfolio_value"), F.lag("portfolio_value").over(w)) - 1, F.lit(0.0)))
    out = rows.withColumn("benchmark_value", F.col("initial_capital") * F.col("level") / F.first("level").over(upto))
    out = out.withColumn("benchmark_return", F.coalesce(F.try_divide(F.col("level"), F.lag("level").over(w)) - 1, F.lit(0.0)))
    return out.select("run_id", "date", "portfolio_value", "portfolio_return", "benchmark_value", "benchmark_return", "turnover", "costs_paid")


def run_window(daily: DataFrame, specs: DataFrame) -> DataFrame:
    """First and last invested date, trading days, and whether the run starts later than configured."""
    facts = daily.groupBy("run_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("days"))
    return facts.join(specs.select("run_id", "start"), "run_id").select("run_id", "first_date", "last_date", "days", (F.col("first_date") > F.col("start")).alias("starts_late"))


def cost_summary(daily: DataFrame, specs: DataFrame) -> DataFrame:
    """Total and entry cost, share of capital, rebalances after entry and their mean turnover."""
    entry = F.min("date").over(Window.partitionBy("run_id"))
    rows = daily.withColumn("after", (F.col("date") > entry) & (F.col("turnover") > 0))
    facts = rows.groupBy("run_id").agg(
        F.sum("costs_paid").alias("total_cost"), F.min_by("costs_paid", "date").alias("entry_cost"), (F.count_if(F.col("turnover") > 0) - 1).alias("rebalances"),
        F.coalesce(F.avg(F.when(F.col("after"), F.col("turnover"))), F.lit(0.0)).alias("mean_turnover"),
    )
    return facts.join(specs.select("run_id", "initial_capital"), "run_id").withColumn("cost_share", F.try_divide("total_cost", "initial_capital")).drop("initial_capital")


def headline(daily: DataFrame, measures: DataFrame) -> DataFrame:
    """Final values, total returns, and whether the run beat its benchmark. ``measures``: run_id, series, sharpe."""
    total = lambda c: F.try_divide(F.max_by(c, "date"), F.min_by(c, "date")) - 1
    facts = daily.groupBy("run_id").agg(
        F.max_by("portfolio_value", "date").alias("final_value"), F.max_by("benchmark_value", "date").alias("benchmark_final"),
        total("portfolio_value").alias("total_return"), total("benchmark_value").alias("benchmark_return"),
    )
    sharpe = measures.groupBy("run_id").agg(*(F.max(F.when(F.col("series") == s, F.col("sharpe"))).alias(s) for s in ("portfolio", "benchmark")))
    out = facts.join(sharpe, "run_id")
    beat = lambda a, b: F.coalesce(F.col(a) > F.col(b), F.lit(False))
    out = out.withColumn("beat_return", beat("total_return", "benchmark_return")).withColumn("beat_sharpe", beat("portfolio", "benchmark"))
    return out.withColumn("beat_both", F.col("beat_return") & F.col("beat_sharpe")).drop("portfolio", "benchmark")
