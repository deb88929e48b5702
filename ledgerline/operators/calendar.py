"""Rebalance calendars from observed dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rebalance_dates(dates: DataFrame, keys: list[str]) -> DataFrame:
    """The last observed date of each month, quarter or year, but neither the first nor the last
    date of all. ``dates``: keys, frequency (monthly, quarterly, annual or none), date."""
    period = F.when(F.col("frequency") == "monthly", F.trunc("date", "month")).when(F.col("frequency") == "quarterly", F.trunc("date", "quarter")).when(F.col("frequency") == "annual", F.trunc("date", "year"))
    by_period = dates.groupBy(*keys, "frequency", period.alias("period")).agg(F.max("date").alias("rebalance_date"), F.min("date").alias("first"))
    ends = by_period.groupBy(*keys, "frequency").agg(F.min("first").alias("first_date"), F.max("rebalance_date").alias("last_date"))
    inside = (F.col("rebalance_date") > F.col("first_date")) & (F.col("rebalance_date") < F.col("last_date"))
    out = by_period.where("period IS NOT NULL").drop("first").join(ends, [*keys, "frequency"]).where(inside)
    return out.select(*keys, "frequency", "rebalance_date")
