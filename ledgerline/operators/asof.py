"""As-of join: for each asked row the last quote at or before its moment.

Both sides go into one sequence by key and moment that is split by ranges (as in ``operators.scans``), so a hot key, or a moment with
very many asked rows, is many tasks. In a range the last quote is carried forward; what ranges begin with comes from a row a range.
Nothing has a row for every key and day, and no row meets quotes other than its own.

Of several quotes at one moment the last in the order of ``tie`` counts; quotes equal in that too are any one. Quotes without a moment
or a key are none. An asked row before the first quote, or without a moment or a key, stays and has NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.scans import BEFORE, UPTO, joined
from ledgerline.sources.staging import written


def asof(asked: DataFrame, quotes: DataFrame, keys: Sequence[str], at: str, tie: Sequence[str] = (), chunks: int | None = None) -> DataFrame:
    """``asked`` (keys, at, ...) with ``quote``, a struct of the columns of ``quotes`` (keys, at, tie, ...) but the keys; a column of that name
    is replaced. ``tie``: columns of ``quotes``. ``chunks``: how many ranges there are, by default the session's number of shuffle partitions."""
    n = chunks or int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in asked.columns if c != "quote"]
    key = {f"key{i}_": k for i, k in enumerate(keys)}
    ties = {f"tie{i}_": t for i, t in enumerate(tie)}
    some_key = F.lit(True)
    for k in keys:
        some_key = some_key & F.col(k).isNotNull()
    given = quotes.where(some_key & F.col(at).isNotNull())
    given = given.select(*(F.col(k).alias(c) for c, k in key.items()), F.col(at).alias("at_"), F.lit(0).alias("side_"), *(F.col(t).alias(c) for c, t in ties.items()), F.struct(*(c for c in quotes.columns if c not in keys)).alias("quote_"))
    wanted = asked.select(*(F.col(k).alias(c) for c, k in key.items()), F.col(at).alias("at_"), F.lit(1).alias("side_"), F.struct(*names).alias("row_"), F.monotonically_increasing_id().alias("spread_"))
    order = ["at_", "side_", *ties, "spread_"]
    both = given.unionByName(wanted, allowMissingColumns=True).repartitionByRange(n, *key, *order).withColumn("chunk_", F.spark_partition_id())
    both = written(both, "asof")
    own = [*key, "chunk_"]
    last = both.where("side_ = 0").groupBy(*own).agg(F.max_by("quote_", F.struct(*order[:-1])).alias("quote_"))
    chunks_of = joined(both.select(*own).distinct(), last, own, "left")
    earlier = Window.partitionBy(*key).orderBy("chunk_").rowsBetween(*BEFORE)
    carried = chunks_of.select(*own, F.last("quote_", ignorenulls=True).over(earlier).alias("carried_"))
    upto = Window.partitionBy(*own).orderBy(*order).rowsBetween(*UPTO)
    rows = joined(both.withColumn("quote_", F.last("quote_", ignorenulls=True).over(upto)).where("side_ = 1"), carried, own)
    return rows.select("row_.*", F.coalesce("quote_", "carried_").alias("quote"))
