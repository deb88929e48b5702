"""Running values of series that are too long for one task: ticks rather than days.

Rows are split by ranges of (keys, order) into chunks, so one series is spread over as many tasks as there are chunks, whatever
its length. Each chunk is summed up by itself, the summaries of a series (a row for each chunk) are run through in order, and what
comes before a chunk is added to its rows. Results are those of the plain windows in ``operators.series`` but for the last bits
of products; for series of days, of which one is a task, those are the shorter way.

``order`` are columns that order a series; rows that are equal in all of them are in any order and in one chunk. NULL keys are a
series of their own. A missing return counts as zero. Columns named place, chunk, curve and drawdown are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import measures as M
from ledgerline.operators import moments
from ledgerline.sources.staging import written

BEFORE = Window.unboundedPreceding, -1
UPTO = Window.unboundedPreceding, 0


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join by keys in which NULL equals NULL; the keys are the left's."""
    other = right.withColumnsRenamed({k: f"{k}_of_" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_of_"))
    return left.join(other, same, how).drop(*(f"{k}_of_" for k in keys))


def with_drawdown(returns: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None = None) -> DataFrame:
    """``returns`` (keys, order, ret, ...) with place (from 1), chunk, curve and drawdown as in ``series.with_drawdown``. ``chunks``:
    how many ranges there are, by default the session's number of shuffle partitions. Rows are written once."""
    n = chunks or int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = returns.repartitionByRange(n, *keys, *order).withColumn("chunk", F.spark_partition_id())
    own = [*keys, "chunk"]
    w = Window.partitionBy(*own).orderBy(*order).rowsBetween(*UPTO)
    local = parts.withColumn("place", F.row_number().over(w).cast("long")).withColumn("curve", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w))
    local = written(local.withColumns({"high_": F.max("curve").over(w), "low_": F.min("curve").over(w)}), "chunks")
    ends = local.groupBy(*own).agg(F.count(F.lit(1)).alias("n_"), F.max_by("curve", "place").alias("growth_"), F.max("high_").alias("high_"), F.min("low_").alias("low_"))
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(*BEFORE)
    ends = ends.withColumns({"rows_before": F.coalesce(F.sum("n_").over(earlier), F.lit(0)), "growth_before": F.coalesce(F.product("growth_").over(earlier), F.lit(1.0))})
    ends = ends.withColumn("peak_before", F.max(reach()).over(earlier))
    out = joined(local, ends.select(*own, "rows_before", "growth_before", "peak_before"), own)
    peak = F.greatest("peak_before", reach())
    out = out.withColumns({"place": F.col("place") + F.col("rows_before"), "curve": F.col("growth_before") * F.col("curve"), "peak_": peak})
    out = out.withColumn("drawdown", F.round(F.try_divide(F.col("curve"), F.col("peak_")) - 1, 12))
    return out.drop("high_", "low_", "rows_before", "growth_before", "peak_before", "peak_")


def reach() -> Column:
    """The highest point of a local curve once it begins at growth_before: its lowest, should that be negative."""
    return F.greatest(F.col("growth_before") * F.col("high_"), F.col("growth_before") * F.col("low_"))


def episodes(rows: DataFrame, keys: Sequence[str], label: str = "date") -> DataFrame:
    """Each stretch under water of ``with_drawdown``'s rows: keys, peak, trough, recovery, depth, days_to_recover as in
    ``series.episodes``, told by the column ``label``. An episode is named by the last place before it that is not under water,
    so its rows are counted on the map side and one that lasts for most of a series is no hot key."""
    own = [*keys, "chunk"]
    rows = rows.select(*own, "place", F.col(label).alias("label"), "drawdown", F.coalesce(F.col("drawdown") < 0, F.lit(False)).alias("under"))
    dry = F.when(~F.col("under"), F.struct("place", "label"))
    last = rows.groupBy(*own).agg(F.max(dry).alias("dry_"))
    last = last.select(*own, F.max("dry_").over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(*BEFORE)).alias("carried"))
    before = F.max(dry).over(Window.partitionBy(*own).orderBy("place").rowsBetween(*BEFORE))
    rows = joined(rows.withColumn("before", before), last, own).withColumn("start", F.coalesce("before", "carried"))
    found = rows.groupBy(*keys, "start").agg(
        F.count_if("under").alias("days"), F.min(F.when(F.col("under"), F.struct("drawdown", "place", "label"))).alias("low"), F.min(dry).alias("end"),
    ).where("days > 0")
    return found.select(
        *keys, F.col("start.label").alias("peak"), F.col("low.label").alias("trough"), F.col("end.label").alias("recovery"), F.col("low.drawdown").alias("depth"),
        F.when(F.col("end").isNotNull(), F.col("days")).alias("days_to_recover"),
    )


def trailing(rows: DataFrame, keys: Sequence[str], value: Column, length: int) -> DataFrame:
    """As ``moments.trailing``, by blocks of ``length`` places and a join of each window's two ends instead of a window over the series."""
    states = written(moments.block_states(rows, keys, value, F.lit(length)), "blocks")
    begins = states.select(*keys, (F.col("place") + length - 1).alias("place"), F.col("behind").alias("begin_"))
    out = joined(states.drop("behind"), begins, [*keys, "place"], "left")
    whole = (F.col("place") % length == 0) | (F.col("place") < length)
    return out.withColumn("state", F.when(whole, F.col("ahead")).otherwise(moments.merged(F.col("begin_"), F.col("ahead")))).drop("ahead", "begin_")


def rolling_sharpe(rows: DataFrame, keys: Sequence[str], rf: Column, days: int) -> DataFrame:
    """``rows`` (with place) with rolling_sharpe, as in ``series.rolling_sharpe``."""
    out = trailing(rows, keys, F.col("ret") - M.daily_rate(rf), days)
    value = F.try_divide(F.col("state.mean"), moments.deviation(F.col("state"))) * M.DAYS**0.5
    return out.withColumn("rolling_sharpe", F.when(F.col("state.n") == days, value)).drop("state")
