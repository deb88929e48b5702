"""Mean and sample deviation of trailing windows, at a cost that does not depend on their length.

A series is cut into blocks as long as the window. A window then is the end of one block and the beginning of the next
(or one whole block), so two running states meet: of each block from its first row on, and of each block from its last row back. A
state is a count, a mean and a sum of squared deviations about that mean, so nothing is ever taken off a longer sum: a
window of equal values has a deviation of exactly zero, and a wild value outside a window leaves no trace in it.

Rows are numbered by ``place`` from 1. NULL values are rows of the window and not of its count; windows that begin before
the first place hold what there is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_states(rows: DataFrame, keys: Sequence[str], value: Column, length: Column) -> DataFrame:
    """``rows`` (keys, place, ...) with ``ahead``, the state of its block up to the row, and ``behind``, that of its block from the row on."""
    rows = rows.withColumn("block_", F.floor((F.col("place") - 1) / length)).withColumn("value_", value.cast("double"))
    w = Window.partitionBy(*keys, "block_")
    every = Window.unboundedPreceding, 0

    def state(over) -> Column:
        n = F.count("value_").over(over)
        squares = F.coalesce(F.var_pop("value_").over(over), F.lit(0.0)) * n
        return F.struct(n.cast("double").alias("n"), F.coalesce(F.avg("value_").over(over), F.lit(0.0)).alias("mean"), squares.alias("squares"))

    rows = rows.withColumn("ahead", state(w.orderBy("place").rowsBetween(*every)))
    return rows.withColumn("behind", state(w.orderBy(F.desc("place")).rowsBetween(*every))).drop("block_", "value_")


def merged(a: Column, b: Column) -> Column:
    """The state of two states' rows together; a NULL state is none."""
    n, delta = a["n"] + b["n"], b["mean"] - a["mean"]
    both = F.struct(
        n.alias("n"), (a["mean"] + delta * b["n"] / n).alias("mean"), (a["squares"] + b["squares"] + delta * delta * a["n"] * b["n"] / n).alias("squares"),
    )
    return F.when(a.isNull() | (a["n"] == 0), b).when(b.isNull() | (b["n"] == 0), a).otherwise(both)


def deviation(state: Column) -> Column:
    """The sample deviation; NULL for fewer than two values."""
    return F.when(state["n"] > 1, F.sqrt(state["squares"] / (state["n"] - 1)))


def trailing(rows: DataFrame, keys: Sequence[str], value: Column, length: int) -> DataFrame:
    """Every row (keys, place, ...) with ``state`` of the window of ``length`` rows that ends in it."""
    states = block_states(rows, keys, value, F.lit(length))
    begin = F.lag("behind", length - 1).over(Window.partitionBy(*keys).orderBy("place"))
    whole = (F.col("place") % length == 0) | (F.col("place") < length)
    return states.withColumn("state", F.when(whole, F.col("ahead")).otherwise(merged(begin, F.col("ahead")))).drop("ahead", "behind")


def trailing_at(asked: DataFrame, rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """``asked`` (keys, length, place) with ``state`` of the window of ``length`` rows that ends in the place. The states of each
    different length are made once a series and read at two places a window."""
    asked = asked.where("length > 0")
    lengths = asked.select(*keys, "length").distinct()
    states = block_states(rows.join(lengths, list(keys)), [*keys, "length"], value, F.col("length")).select(*keys, "length", "place", "ahead", "behind")
    whole = (F.col("place") % F.col("length") == 0) | (F.col("place") < F.col("length"))
    ends = asked.withColumn("begin_", F.when(~whole, F.col("place") - F.col("length") + 1)).join(states.drop("behind"), [*keys, "length", "place"])
    begins = states.select(*keys, "length", F.col("place").alias("begin_"), "behind")
    out = ends.join(begins, [*keys, "length", "begin_"], "left")
    return out.withColumn("state", merged(F.col("behind"), F.col("ahead"))).drop("ahead", "behind", "begin_")
