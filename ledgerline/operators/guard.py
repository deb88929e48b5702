"""One guarded way from run definitions and raw prices to valued runs: validate, cut, clean, align, check.

Each run is valued on its own tickers and benchmark from its start to its end (operators/universe.py). What is wrong
with a run comes back as rows (run_id, rule, subject); a run with any such row is left out of ``runs``, and the others go
on. Nothing that a rule names is ever valued. A definition without an id, or with another's, is never valued either: its
values could not be told apart. Series with infinite prices or several rows of a day are refused, not mended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import clean, datesets, specs, universe, valuation
from ledgerline.sources.staging import written


@dataclass(frozen=True)
class Checked:
    """``runs`` without problems, the aligned ``panel`` and ``benchmark`` of each window, the trades and target weights of all
    valid strategies, and all ``problems``. In all of them panel_id is the window's id; ``runs`` have their own as source_panel."""

    runs: DataFrame
    panel: DataFrame
    benchmark: DataFrame
    trades: DataFrame
    targets: DataFrame
    problems: DataFrame

    def nav_daily(self) -> DataFrame:
        return valuation.nav_of(self.runs, self.panel, self.benchmark, self.trades, self.targets)


def problem(rows: DataFrame, rule: Column | str, subject: Column) -> DataFrame:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return rows.select("run_id", rule.alias("rule"), subject.cast("string").alias("subject"))


def series_facts(days: DataFrame, rows: DataFrame) -> DataFrame:
    """window_id, is_benchmark, ticker, first_date, kept, and whether the series has infinite prices or repeated days."""
    odd = days.groupBy(*clean.SERIES).agg(F.max("infinite").alias("infinite"), (F.max("n_rows") > 1).alias("repeated"))
    facts = odd.join(clean.shares_of(days, rows), [*clean.SERIES])
    return facts.select(F.col("panel_id.panel_id").alias("window_id"), "panel_id.is_benchmark", "ticker", "first_date", "kept", "infinite", "repeated")


def series_problems(definitions: DataFrame, series: DataFrame) -> DataFrame:
    """Tickers and benchmarks without prices, that start more than START_SLACK days after the run, that have infinite prices or
    several rows of a day, and benchmarks that cleaning drops."""
    wanted = definitions.select("run_id", "window_id").join(universe.members(definitions).select("window_id", "start", "is_benchmark", "ticker"), "window_id")
    rows = wanted.join(series, ["window_id", "is_benchmark", "ticker"], "left")
    what, late = F.when(F.col("is_benchmark"), "benchmark").otherwise("ticker"), F.col("first_date") > F.date_add("start", clean.START_SLACK)
    rules = [
        F.when(F.col("first_date").isNull(), F.concat(what, F.lit(" without prices"))).when(late, F.concat(what, F.lit(" starts late"))),
        F.when(F.col("is_benchmark") & ~F.col("kept"), "benchmark dropped"),
        F.when(F.col("infinite"), F.concat(what, F.lit(" with infinite prices"))), F.when(F.col("repeated"), F.concat(what, F.lit(" with repeated days"))),
    ]
    return problem(rows.withColumn("rule", F.explode(F.array_compact(F.array(*rules)))), F.col("rule"), F.col("ticker"))


def left_over(series: DataFrame, complete: DataFrame, shared: DataFrame) -> DataFrame:
    """window_id and rule of windows of which cleaning or aligning leaves too little. ``shared`` are sets of dates."""
    kept = series.where("NOT is_benchmark").groupBy("window_id").agg(F.count_if("kept").alias("kept"))
    own = complete.where("NOT panel_id.is_benchmark").select(F.col("panel_id.panel_id").alias("window_id"))
    count = own.groupBy("window_id").agg(F.count(F.lit(1)).alias("complete"))
    facts = kept.join(count, "window_id", "left").join(datesets.sizes(shared, ["window_id"], "shared"), "window_id", "left").na.fill(0)
    rule = F.when(F.col("kept") == 0, "no ticker left").when(F.col("complete") == 0, "no date left").when(F.col("shared") < 2, "fewer than two shared dates")
    return facts.select("window_id", rule.alias("rule")).where("rule IS NOT NULL")


def unstacked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The panel and the benchmark of rows whose panel_id tells them apart."""
    of = lambda k: rows.where(F.col("panel_id.is_benchmark") == k).withColumn("panel_id", F.col("panel_id.panel_id"))
    return of(False), of(True)


def checked(definitions: DataFrame, prices: DataFrame, benchmark: DataFrame) -> Checked:
    """``definitions`` are normalised; ``prices`` and ``benchmark`` (panel_id, ticker, date, close) are raw. The
    benchmark of a run is the series of its panel in ``benchmark`` that has its name."""
    definitions = universe.with_window(definitions)
    days, dates, spans = clean.spanned(universe.dealt(prices, benchmark, written(universe.members(definitions), "members")))
    complete = written(clean.complete_dates(spans, dates), "complete")
    by_side = complete.select(F.col("panel_id.panel_id").alias("window_id"), "panel_id", "date", "place")
    sets = datesets.of(by_side.withColumn("is_benchmark", F.col("panel_id.is_benchmark")), ["window_id", "is_benchmark"])
    shared = written(datesets.common(sets, ["window_id"], 2), "shared")
    both = datesets.at_dates(by_side, shared, ["window_id"])
    panel, other = unstacked(written(clean.carried(spans, both), "aligned"))
    series = series_facts(days, spans)

    valid = specs.sound(definitions).withColumnsRenamed({"panel_id": "source_panel", "window_id": "panel_id"})
    trades, targets = valuation.planned(valuation.strategies(valid), panel)
    refused = targets.where("weight IS NULL").select(F.col("run_id").alias("strategy_id"), "rebalance_date").distinct()
    refused = valuation.with_strategy(valid).select("run_id", "strategy_id").join(refused, "strategy_id")
    named = definitions.where("window_id IS NOT NULL")
    by_window = left_over(series, complete, shared).unionByName(clean.panel_violations(panel, other).withColumnRenamed("panel_id", "window_id"))
    no_panel = named.join(series.where("NOT is_benchmark"), "window_id", "left_anti")
    problems = (
        problem(specs.violations(definitions), F.col("rule"), F.lit(None))
        .unionByName(problem(no_panel, "panel without prices", F.col("panel_id")))
        .unionByName(series_problems(named, series))
        .unionByName(problem(named.select("run_id", "panel_id", "window_id").join(by_window, "window_id"), F.col("rule"), F.col("panel_id")))
        .unionByName(valuation.run_violations(valid, panel))
        .unionByName(problem(refused, "no ticker with a usable deviation", F.col("rebalance_date")))
    )
    problems = written(problems.distinct(), "problems")
    # every valid run has an id, so none slips through the anti join
    runs = written(valid.join(problems.select("run_id").distinct(), "run_id", "left_anti"), "runs")
    return Checked(runs, panel, other, trades, targets, problems)
