"""Daily closes from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_closes(ticks: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The last tick of each ticker and day, once ``lateness`` has passed after the day's end.
    ``ticks``: ticker, ts, close, seq, as a stream."""
    day = F.window("ts", "1 day")
    closes = ticks.withWatermark("ts", lateness).groupBy("ticker", day).agg(F.max_by("close", "seq").alias("close"))
    return closes.select("ticker", F.to_date("window.start").alias("date"), "close")
