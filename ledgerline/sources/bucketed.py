"""Prices stored in buckets of tickers: every window and aggregate by ticker reads them without a shuffle.

The one shuffle is paid when the table is written, with one file a bucket. Readers have to come through the catalog (``spark.table``),
as it alone knows the buckets; a plain read of the folder gives the same rows and shuffles again. One ticker is one bucket, so a
series has to be of days; ticks belong to ``operators.scans``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerline.sources.staging import fresh_path

#: Buckets of a table, which are the tasks that read it.
BUCKETS = 64


def stored(prices: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Write ``prices`` (ticker, date, ...) as table ``name`` in the folder ``path`` and read it back. Any table of that name is an error.
    A NULL ticker is a series like any other."""
    # The hash that buckets are numbered by is the shuffle's own, so that each task writes one bucket.
    writer = prices.repartition(buckets, "ticker").sortWithinPartitions("ticker", "date").write.bucketBy(buckets, "ticker").sortBy("ticker", "date")
    writer.option("path", path).format("parquet").saveAsTable(name)
    return prices.sparkSession.table(name)


def prefix(spark: SparkSession) -> str:
    """What the names of this application's own tables begin with."""
    return "ledgerline_" + "".join(c if c.isalnum() else "_" for c in spark.sparkContext.applicationId.lower()) + "_"


def staged(prices: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``stored`` in a new table of the shared folder, for steps of one job. ``forget`` takes its name from the catalog again."""
    return stored(prices, prefix(prices.sparkSession) + uuid.uuid4().hex, fresh_path(prices.sparkSession, "bucketed"), buckets)


def forget(spark: SparkSession) -> None:
    """Drop the tables that ``staged`` made for this application and whose folders ``staging.clean_up`` deletes; other tables stay."""
    for name in (t.name for t in spark.catalog.listTables() if t.name.startswith(prefix(spark)) and not t.isTemporary):
        spark.sql(f"DROP TABLE {name}")

