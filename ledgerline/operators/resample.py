"""Stationary block bootstrap as a join of draws with returns.

Draws come from counters: md5 of seed, path, step and a tag, so they do not depend on partitions
or retries. A path starts a new block with probability 1 / block_length at each step and else
goes on by one day, wrapping at the end. One draw serves a run's portfolio and benchmark alike,
and runs with the same number of returns share a draw table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.measures import DAYS

N_PATHS, BLOCK, YEARS, STRIDE = 10_000, 21, (1, 3, 5), 5


def uniform(seed: int, tag: str) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("path"), F.col("step"), F.lit(tag)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def draws(lengths: DataFrame, n_paths: int, n_steps: int, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """n_obs, path, step, idx for every n_obs of ``lengths``."""
    spark = lengths.sparkSession
    steps = spark.range(n_paths).withColumnRenamed("id", "path").select("path", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))).alias("step"))
    steps = steps.withColumn("new", (F.col("step") == 0) | (uniform(seed, "new") < 1.0 / block)).withColumn("u", uniform(seed, "start"))
    w = Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    began = lambda x: F.last(F.when(F.col("new"), x), ignorenulls=True).over(w)
    steps = steps.select("path", "step", began(F.col("step")).alias("from_step"), began(F.col("u")).alias("u"))
    start = F.floor(F.col("u") * F.col("n_obs"))
    idx = (start + F.col("step") - F.col("from_step")) % F.col("n_obs")
    return steps.crossJoin(F.broadcast(lengths.select("n_obs").distinct())).select("n_obs", "path", "step", idx.alias("idx"))


def numbered(returns: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Returns that both series have, numbered from 0, with their number n_obs; series shorter than a block go."""
    rows = returns.where("ret IS NOT NULL AND other IS NOT NULL")
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("idx", (F.row_number().over(w.orderBy("date")) - 1).cast("bigint")).withColumn("n_obs", F.count(F.lit(1)).over(w))
    return rows.where(F.col("n_obs") >= block)


def paths(returns: DataFrame, keys: list[str], capital: float, n_paths: int = N_PATHS, years: tuple[int, ...] = YEARS, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """keys, path, step, value, other_value at the fan's steps and the horizons' ends."""
    rows = numbered(returns, keys, block)
    n_steps = max(years) * DAYS
    table = draws(rows.select("n_obs").distinct(), n_paths, n_steps, block, seed)
    joined = table.join(rows.select(*keys, "n_obs", "idx", "ret", "other"), ["n_obs", "idx"])
    w = Window.partitionBy(*keys, "path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    grown = lambda c: F.lit(capital) * F.product(1 + F.col(c)).over(w)
    out = joined.select(*keys, "path", "step", grown("ret").alias("value"), grown("other").alias("other_value"))
    return out.where((F.col("step") % STRIDE == 0) | F.col("step").isin(*(y * DAYS - 1 for y in years)))


def horizons(rows: DataFrame, keys: list[str], capital: float, years: tuple[int, ...] = YEARS) -> DataFrame:
    """Per horizon: median and tenth and ninetieth percentile, chances of ending below the capital
    and above the benchmark path by path, and the benchmark's median."""
    ends = rows.where(F.col("step").isin(*(y * DAYS - 1 for y in years))).withColumn("years", ((F.col("step") + 1) / DAYS).cast("int"))
    p = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = ends.groupBy(*keys, "years").agg(
        p.alias("p"), F.avg((F.col("value") < capital).cast("double")).alias("p_below"), F.avg((F.col("value") > F.col("other_value")).cast("double")).alias("p_beats"),
        F.percentile("other_value", F.lit(0.5)).alias("benchmark_median"),
    )
    return out.select(*keys, "years", F.col("p")[1].alias("median"), F.col("p")[0].alias("p10"), F.col("p")[2].alias("p90"), "p_below", "p_beats", "benchmark_median")


def fan(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bands at every fifth step."""
    p = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = rows.where(F.col("step") % STRIDE == 0).groupBy(*keys, "step").agg(p.alias("p"), F.percentile("other_value", F.lit(0.5)).alias("benchmark_p50"))
    return out.select(*keys, "step", F.col("p")[0].alias("p10"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p90"), "benchmark_p50")
