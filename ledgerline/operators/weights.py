"""Target weights on rebalance dates, from prices up to and including the date only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import moments
from ledgerline.operators.series import daily_returns


def equal_weights(trades: DataFrame, panel: DataFrame) -> DataFrame:
    """``trades``: run_id, panel_id, rebalance_date. Every ticker of the panel gets the same."""
    tickers = panel.select("panel_id", "ticker").distinct()
    n = tickers.groupBy("panel_id").agg(F.count(F.lit(1)).alias("n"))
    return trades.join(tickers.join(n, "panel_id"), "panel_id").select("run_id", "panel_id", "rebalance_date", "ticker", (1 / F.col("n")).alias("weight"))


def custom_weights(trades: DataFrame, specs: DataFrame) -> DataFrame:
    """Weights as supplied, by place in ``tickers``, divided by their sum."""
    total = F.aggregate("custom_weights", F.lit(0.0), lambda a, x: a + x)
    pairs = specs.select("run_id", F.explode(F.arrays_zip("tickers", "custom_weights")).alias("p"), total.alias("total"))
    pairs = pairs.select("run_id", F.col("p.tickers").alias("ticker"), F.try_divide(F.col("p.custom_weights"), F.col("total")).alias("weight"))
    return trades.select("run_id", "panel_id", "rebalance_date").join(pairs, "run_id").select("run_id", "panel_id", "rebalance_date", "ticker", "weight")


def trailing_volatility(asked: DataFrame, panel: DataFrame) -> DataFrame:
    """``asked`` (panel_id, rebalance_date, lookback_days) with ticker and sigma, the sample deviation of the ticker's
    last ``lookback_days`` returns up to the date; any number of lookbacks goes through one plan (operators/moments.py)."""
    series = ["panel_id", "ticker"]
    w = Window.partitionBy(*series).orderBy("date")
    asked = asked.distinct()
    rets = daily_returns(panel.join(asked.select("panel_id").distinct(), "panel_id", "left_semi"), series).select(*series, "date", "ret", F.row_number().over(w).alias("place"))
    at = asked.join(rets.select(*series, F.col("date").alias("rebalance_date"), "place"), ["panel_id", "rebalance_date"])
    states = moments.trailing_at(at.withColumnRenamed("lookback_days", "length"), rets.drop("date"), series, F.col("ret"))
    return states.select("panel_id", "rebalance_date", F.col("length").alias("lookback_days"), "ticker", moments.deviation(F.col("state")).alias("sigma"))


def refused_dates(trades: DataFrame, panel: DataFrame) -> DataFrame:
    """run_id and rebalance_date of inverse volatility trades at which no ticker has a positive deviation."""
    asked = trades.where("weighting = 'inverse_vol'").select("run_id", "panel_id", "rebalance_date", "lookback_days")
    key = ["panel_id", "rebalance_date", "lookback_days"]
    usable = trailing_volatility(asked.select(*key), panel).where("sigma > 0").select(*key).distinct()
    return asked.join(usable, key, "left_anti").select("run_id", "rebalance_date")


def inverse_volatility_weights(trades: DataFrame, panel: DataFrame) -> DataFrame:
    """``trades`` has lookback_days too. Tickers without a positive deviation get zero; a date where
    none has one gets no weights."""
    key = ["panel_id", "rebalance_date", "lookback_days"]
    sigma = trailing_volatility(trades.select(*key), panel).withColumn("inverse", F.when(F.col("sigma") > 0, F.try_divide(F.lit(1.0), F.col("sigma"))))
    total = F.sum("inverse").over(Window.partitionBy(*key))
    shares = sigma.withColumn("total", total).where("total IS NOT NULL").select(*key, "ticker", F.coalesce(F.try_divide(F.col("inverse"), F.col("total")), F.lit(0.0)).alias("weight"))
    return trades.join(shares, key).select("run_id", "panel_id", "rebalance_date", "ticker", "weight")


def target_weights(trades: DataFrame, specs: DataFrame, panel: DataFrame) -> DataFrame:
    """Weights of every run by its scheme. ``trades``: run_id, panel_id, rebalance_date, weighting, lookback_days."""
    of = lambda scheme: trades.where(F.col("weighting") == scheme)
    cols = ["run_id", "panel_id", "rebalance_date"]
    equal = equal_weights(of("equal").select(*cols), panel)
    custom = custom_weights(of("custom"), specs)
    inverse = inverse_volatility_weights(of("inverse_vol").select(*cols, "lookback_days"), panel)
    rows = equal.unionByName(custom).unionByName(inverse)
    # Every ticker of the panel has a row: a zero weight counts in the turnover. A refused date has no weights
    # at all; they stay NULL there, and so does what is valued by them.
    tickers = panel.select("panel_id", "ticker").distinct()
    full = trades.select(*cols, "weighting").join(tickers, "panel_id").join(rows, [*cols, "ticker"], "left")
    return full.withColumn("weight", F.when(F.col("weighting") == "inverse_vol", F.col("weight")).otherwise(F.coalesce("weight", F.lit(0.0)))).drop("weighting")
