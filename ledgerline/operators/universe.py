"""What each run is valued on: its own tickers and benchmark, from its start to its end, and nothing else.

Cleaning depends on all of these (a ticker outside the run may not drop a date, a date outside may not thin a ticker),
so prices are cut before it. Runs that name the same tickers in any order, the same benchmark and the same days of one
panel share a window: it is cut, cleaned, aligned and traded once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.prices import in_windows

WINDOW = ("panel_id", "tickers", "benchmark", "start", "end")


def with_window(definitions: DataFrame) -> DataFrame:
    """Normalised definitions with window_id, alike for runs on the same prices; NULL where tickers, benchmark or days are none."""
    names = F.col("tickers")
    whole = F.col("panel_id").isNotNull() & (F.size(names) > 0) & ~F.exists(names, lambda t: t.isNull()) & F.col("benchmark").isNotNull() & (F.col("start") <= F.col("end"))
    parts = F.struct("panel_id", F.array_sort(F.array_distinct(names)).alias("tickers"), "benchmark", "start", "end")
    return definitions.withColumn("window_id", F.when(whole, F.md5(F.to_json(parts))))


def members(definitions: DataFrame) -> DataFrame:
    """window_id, panel_id, is_benchmark, ticker, start, end: what is read for each different window."""
    names = F.concat(
        F.transform(F.array_distinct("tickers"), lambda t: F.struct(F.lit(False).alias("is_benchmark"), t.alias("ticker"))),
        F.array(F.struct(F.lit(True).alias("is_benchmark"), F.col("benchmark").alias("ticker"))),
    )
    different = definitions.where("window_id IS NOT NULL").dropDuplicates(["window_id"])
    return different.select("window_id", "panel_id", "start", "end", F.inline(names))


def dealt(prices: DataFrame, benchmark: DataFrame, asked: DataFrame) -> DataFrame:
    """The prices of every window's members (``asked``, a written table): panel_id (a struct of the window's id as panel_id
    and is_benchmark), ticker, date, close. Both tables are dealt in one join."""
    rows = prices.select("panel_id", F.lit(False).alias("is_benchmark"), "ticker", "date", "close")
    rows = rows.unionByName(benchmark.select("panel_id", F.lit(True).alias("is_benchmark"), "ticker", "date", "close"))
    found = in_windows(rows, asked, ["panel_id", "is_benchmark", "ticker"])
    return found.select(F.struct(F.col("window_id").alias("panel_id"), "is_benchmark").alias("panel_id"), "ticker", "date", "close")
