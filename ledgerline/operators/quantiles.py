"""Exact quantiles of groups that are too large to sort in one task.

The values of a group are counted by cells between its least and its greatest value, on the map side first. The cell that holds the
wanted rank becomes the group's new range, with the least and greatest value that it really has, and only its rows go on; the
greatest value is a cell of its own, so a range shrinks in every round, and a value that fills its cell alone, however often
it occurs, is the answer. A range of FEW values is sorted. One or two rounds do for most data, as a round has CELLS cells; doubles of all
sizes at once take some fifty. No group's values meet in one place.

NULL and NaN are no values; infinite ones are. A group without values has no row. The quantile is interpolated between two ranks
as ``percentile`` does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.scans import joined
from ledgerline.sources.staging import written

#: Cells of a range in one round.
CELLS = 4096
#: Values of a range that are sorted instead of counted.
FEW = 10_000
#: Wanted ranks that are broadcast to the rows; more of them are joined by a shuffle, in which each group then is small.
BROADCAST_RANKS = 100_000


def cell(value: Column, low: Column, high: Column) -> Column:
    """The cell of a value of the range, never falling in ``value``: -1 the least value, CELLS the greatest. Halves, as a range may be too wide for a double."""
    part = F.try_divide(value / 2 - low / 2, high / 2 - low / 2)
    inner = F.floor(F.nanvl(F.coalesce(part, F.lit(0.0)), F.lit(0.0)) * CELLS).cast("int")
    return F.when(value == low, -1).when(value == high, CELLS).otherwise(F.least(F.greatest(inner, F.lit(0)), F.lit(CELLS - 1)))


def values_at(rows: DataFrame, keys: Sequence[str], ranks: DataFrame, value: str) -> DataFrame:
    """``ranks`` (keys, rank from 0, n, low and high: number, least and greatest of the values) with the ``value`` of that rank among the group's ``rows``."""
    rows = rows.select(*keys, F.col(value).alias("value_"))
    asked = ranks.select(*keys, "rank", F.col("rank").alias("wanted_"), F.col("n").alias("n_"), F.col("low").alias("low_"), F.col("high").alias("high_"))
    asked, found = written(asked, "ranks"), None
    own = [*keys, "rank"]
    by_value = Window.partitionBy(*own).orderBy("value_")

    def inside(of: DataFrame, n: int) -> DataFrame:
        return joined(rows, F.broadcast(of) if n <= BROADCAST_RANKS else of, keys).where(F.col("value_").between(F.col("low_"), F.col("high_")))

    while True:
        few, many = asked.where("low_ < high_").where(F.col("n_") <= FEW), asked.where("low_ < high_").where(F.col("n_") > FEW)
        n_few, n_many = asked.agg(F.count_if((F.col("low_") < F.col("high_")) & (F.col("n_") <= FEW)), F.count_if((F.col("low_") < F.col("high_")) & (F.col("n_") > FEW))).first()
        done = asked.where("low_ = high_").select(*own, F.col("low_").alias(value))
        if n_few:
            sorted_ = inside(few, n_few).withColumn("place_", F.row_number().over(by_value) - 1).where("place_ = wanted_")
            done = done.unionByName(sorted_.select(*own, F.col("value_").alias(value)))
        found = done if found is None else found.unionByName(done)
        if n_many == 0:
            return found
        counts = inside(many, n_many).groupBy(*own, "wanted_", cell(F.col("value_"), F.col("low_"), F.col("high_")).alias("cell_")).agg(
            F.count(F.lit(1)).alias("n_"), F.min("value_").alias("low_"), F.max("value_").alias("high_")
        )
        before = F.sum("n_").over(Window.partitionBy(*own).orderBy("cell_")) - F.col("n_")
        counts = counts.withColumn("before_", before).where((F.col("wanted_") >= F.col("before_")) & (F.col("wanted_") < F.col("before_") + F.col("n_")))
        asked = written(counts.select(*own, (F.col("wanted_") - F.col("before_")).alias("wanted_"), "n_", "low_", "high_"), "ranks")


def exact(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """keys, share, n (values of the group) and quantile. ``rows`` are read once a round and once for their bounds: write them before if they are dear."""
    rows = rows.select(*keys, F.col(value).cast("double").alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("value", F.col("value") + 0.0)
    bounds = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    at = (F.col("n") - 1) * F.col("share")
    places = written(bounds.withColumn("share", F.explode(F.array(*map(F.lit, sorted(set(shares)))))).withColumns({"at": at, "below": F.floor(at), "above": F.ceil(at)}), "places")
    ranks = places.select(*keys, F.explode(F.array("below", "above")).alias("rank"), "n", "low", "high").distinct()
    known = written(values_at(rows, keys, ranks, "value"), "found")
    out = joined(places, known.withColumnsRenamed({"rank": "below", "value": "a"}), [*keys, "below"])
    out = joined(out, known.withColumnsRenamed({"rank": "above", "value": "b"}), [*keys, "above"])
    between = (F.col("above") - F.col("at")) * F.col("a") + (F.col("at") - F.col("below")) * F.col("b")
    return out.select(*keys, "share", "n", F.when((F.col("below") == F.col("above")) | (F.col("a") == F.col("b")), F.col("a")).otherwise(between).alias("quantile"))


def tail_measures(returns: DataFrame, keys: Sequence[str], confidences: Sequence[float]) -> DataFrame:
    """keys, confidence, value_at_risk and expected_shortfall (positive losses) of the column ret: the fall that a share of
    1 - confidence of the returns is beyond, and the mean of those. ``returns`` are read several times, as in ``exact``."""
    shares = {1.0 - c: c for c in confidences}
    tails = written(exact(returns, keys, "ret", list(shares)), "tails").select(*keys, "share", "quantile")
    beyond = joined(returns.select(*keys, "ret"), tails, keys).where(F.col("ret") <= F.col("quantile"))
    out = beyond.groupBy(*keys, "share").agg(F.max("quantile").alias("tail"), F.avg("ret").alias("mean"))
    confidence = F.element_at(F.create_map(*(F.lit(x) for pair in shares.items() for x in pair)), F.col("share"))
    return out.select(*keys, confidence.alias("confidence"), (-F.col("tail")).alias("value_at_risk"), (-F.col("mean")).alias("expected_shortfall"))
