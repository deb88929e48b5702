"""Price series derived from the order tables: an instrument's close on a day is an index of the
average discount of what was shipped that day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def close_index():
    return (F.lit(100) * (1 + F.avg("l_discount"))).alias("close")


def prices_by(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """ticker (the part's ``column``), date, close."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), "l_discount")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col(column).alias("ticker"))
    # The aggregate has one row per ticker and day, so what is shuffled in full is narrow lines by part, once;
    # where the part table is small Spark broadcasts it and not even that.
    return lines.join(parts, "l_partkey").groupBy("ticker", "date").agg(close_index())


def benchmark_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all lines: ticker ALL."""
    lines = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_discount")
    return lines.groupBy("date").agg(close_index()).select(F.lit("ALL").alias("ticker"), "date", "close")


def event_ticks(spark: SparkSession, sf_dir: str, column: str = "event_type") -> DataFrame:
    """Ticks in the raw layout: ticker is the event's ``column``, seq its place in time."""
    return table(spark, sf_dir, "events").select(
        F.col(column).cast("string").alias("ticker"), "ts", F.col("value").alias("close"), F.struct("ts", "event_id").alias("seq")
    )
