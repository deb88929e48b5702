"""A bucketed table saves the shuffle, and holds the same rows."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerline.operators import series
from ledgerline.sources import bucketed


def summary(rows):
    rows = series.with_drawdown(series.daily_returns(rows, ["ticker"]), ["ticker"])
    return rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("days"), F.min("drawdown").alias("fall"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_shuffle_over_buckets(spark, tmp_path):
    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(i), 100.0 + (i * 7 + k) % 13) for k, t in enumerate(["A", "B", "C", None]) for i in range(50)]
    prices = spark.createDataFrame(rows, "ticker string, date date, close double")
    table = bucketed.stored(prices, "bucketed_test", str(tmp_path / "b"), 5)
    try:
        assert "Exchange" not in plan(summary(table)) and "Exchange" in plan(summary(prices))
        assert sorted(map(str, summary(table).collect())) == sorted(map(str, summary(prices).collect()))
        assert len(list((tmp_path / "b").glob("*.parquet"))) <= 5
        with pytest.raises(AnalysisException):
            bucketed.stored(prices, "bucketed_test", str(tmp_path / "c"), 5)
        assert bucketed.staged(prices.where("false")).count() == 0
        own = lambda: [t.name for t in spark.catalog.listTables() if t.name.startswith(bucketed.prefix(spark))]
        assert own()
        bucketed.forget(spark)
        assert not own() and spark.table("bucketed_test").count() == 200
    finally:
        spark.sql("DROP TABLE IF EXISTS bucketed_test")
