"""The registered queries: the library's operators over price series derived from the driver tables."""

from __future__ import annotations

import datetime as dt
from functools import partial
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.functions import measures as M
from ledgerline.operators import asof, calendar, clean, guard, quantiles, resample, scans, series, specs, states, valuation, weights
from ledgerline.sources import prices as P
from ledgerline.sources import bucketed, files, store
from ledgerline.sources import tables as T
from ledgerline.sources.staging import fresh_path, written

RF, CAPITAL, PATHS = 0.02, 100_000.0, resample.N_PATHS
TICKERS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
CUSTOM = (0.10, 0.15, 0.20, 0.25, 0.20, 0.10)
WINDOW = (dt.date(1996, 1, 1), dt.date(1997, 12, 31))


def rounded(df: DataFrame, digits: int | dict[str, int] = 8) -> DataFrame:
    """Doubles rounded, as sums differ in their last bits with the order of the rows."""
    of = (lambda c: digits) if isinstance(digits, int) else (lambda c: digits.get(c, 8))
    return df.select(*(F.round(c, of(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def type_prices(spark: SparkSession, sf: str) -> DataFrame:
    return T.prices_by(spark, sf, "p_type")


def panel_of(prices: DataFrame, name: str) -> DataFrame:
    return prices.select(F.lit(name).alias("panel_id"), "ticker", "date", "close")


def checked_runs(spark: SparkSession, sf: str) -> guard.Checked:
    """The sweep over part types, validated, cleaned, aligned and checked."""
    panel = panel_of(type_prices(spark, sf), "TYPE")
    return guard.checked(sweep(spark), panel, panel_of(T.benchmark_prices(spark, sf), "TYPE"))


def type_returns(spark: SparkSession, sf: str) -> DataFrame:
    """ticker, date, ret and the benchmark's return on the same date (other)."""
    rets = series.daily_returns(type_prices(spark, sf), ["ticker"])
    other = series.daily_returns(T.benchmark_prices(spark, sf), ["ticker"]).select("date", F.col("ret").alias("other"))
    return rets.join(other, "date", "left").select("ticker", "date", "ret", "other")


def sweep(spark: SparkSession) -> DataFrame:
    """Every scheme with every frequency and two cost rates."""
    rows = [
        (f"{w}-{f}-{int(c)}", "TYPE", list(TICKERS), "ALL", dt.date(1995, 1, 1), dt.date(2001, 12, 31), CAPITAL, w, f, RF, c, list(CUSTOM) if w == "custom" else None, 63 if w == "inverse_vol" else None)
        for w in specs.WEIGHTINGS for f in specs.REBALANCES for c in (0.0, 10.0)
    ]
    return spark.createDataFrame(rows, schemas.RUN_SPEC)


def valued(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = checked_runs(spark, sf)
    return c.nav_daily(), c.runs


# --- prices -----------------------------------------------------------------------------------


def instrument_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = series.with_drawdown(series.daily_returns(type_prices(spark, sf), ["ticker"]), ["ticker"])
    ret = F.col("ret")
    out = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("days"), M.cagr(ret).alias("cagr"), M.volatility(ret).alias("volatility"), F.min("drawdown").alias("max_drawdown"))
    return rounded(out)


def daily_close(spark: SparkSession, sf: str, ticker: str) -> DataFrame:
    raw = T.event_ticks(spark, sf, ticker)
    return rounded(P.normalised_ticks(raw))


def weekly_universe(spark: SparkSession, sf: str) -> DataFrame:
    """Every part name in the weeks in which it was ordered: panel_id is the week's first day."""
    week = F.to_date(F.date_trunc("week", "o_orderdate")).alias("start")
    orders = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), week)
    lines = T.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey").select("l_partkey", "start").distinct()
    names = T.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("ticker"))
    rows = lines.join(names, "l_partkey").select("ticker", "start").distinct()
    return rows.select(F.col("start").cast("string").alias("panel_id"), "ticker", "start", F.date_add("start", 6).alias("end"))


def universe_window(spark: SparkSession, sf: str) -> DataFrame:
    universe = T.table(spark, sf, "part").select(F.lit("BRANDS").alias("panel_id"), F.col("p_brand").alias("ticker")).distinct()
    universe = universe.withColumns({"start": F.lit(WINDOW[0]), "end": F.lit(WINDOW[1])})
    rows = P.universe_prices(T.prices_by(spark, sf, "p_brand"), universe)
    return rounded(rows.groupBy("panel_id", "ticker").agg(F.count(F.lit(1)).alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.avg("close").alias("mean_close")))


def missing_tickers(spark: SparkSession, sf: str) -> DataFrame:
    return P.missing_tickers(T.prices_by(spark, sf, "p_name"), written(weekly_universe(spark, sf), "universe"))


def brand_panel(spark: SparkSession, sf: str) -> DataFrame:
    return written(panel_of(T.prices_by(spark, sf, "p_brand"), "BRAND"), "brands")


def clean_panel(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clean.cleaned(brand_panel(spark, sf)))


def dropped_tickers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clean.ticker_shares(brand_panel(spark, sf)))


#: The configured start of the brands' panel: prices may begin a week later.
BRANDS_FROM = dt.date(1994, 12, 26)


def coverage_violations(spark: SparkSession, sf: str) -> DataFrame:
    panel = brand_panel(spark, sf)
    starts = panel.select("panel_id").distinct().withColumn("start", F.lit(BRANDS_FROM))
    return clean.late_tickers(panel, starts)


def panel_facts(spark: SparkSession, sf: str) -> DataFrame:
    return clean.panel_facts(brand_panel(spark, sf))


def every_day(panel: DataFrame) -> DataFrame:
    """A row for each of a panel's dates and tickers; close is NULL where there is none."""
    dates, tickers = panel.select("panel_id", "date").distinct(), panel.select("panel_id", "ticker").distinct()
    return dates.join(tickers, "panel_id").join(panel, ["panel_id", "ticker", "date"], "left")


def panel_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Users as panels of event types: their grids have missing and zero values and odd dates."""
    raw = T.table(spark, sf, "events").select("user_id", "event_type", "ts", "value", "event_id")
    day = raw.groupBy(F.col("user_id").cast("string").alias("panel_id"), F.col("event_type").alias("ticker"), F.to_date("ts").alias("date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    day = written(day, "days")
    return clean.panel_violations(every_day(day.where("ticker <> 'error'")), day.where("ticker = 'error'"))


def aligned_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Brands aligned with the days on which urgent orders were placed."""
    panel = brand_panel(spark, sf)
    urgent = T.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    other = urgent.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close")).select(F.lit("BRAND").alias("panel_id"), F.lit("URGENT").alias("ticker"), "date", "close")
    a, b = clean.aligned(panel, written(other, "urgent"))
    return rounded(a.unionByName(b), 4)


# --- series -----------------------------------------------------------------------------------


def daily_returns(spark: SparkSession, sf: str) -> DataFrame:
    rows = type_returns(spark, sf)
    return rounded(rows.select("ticker", "date", "ret", (F.col("ret") - M.daily_rate(F.lit(RF))).alias("excess"), (F.col("ret") - F.col("other")).alias("active")))


def drawdown_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.with_drawdown(type_returns(spark, sf), ["ticker"]).select("ticker", "date", "curve", "drawdown"))


def drawdown_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.episodes(type_returns(spark, sf), ["ticker"]))


def top_drawdowns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.top_episodes(type_returns(spark, sf), ["ticker"]))


def rolling_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.rolling_sharpe(type_returns(spark, sf), ["ticker"], F.lit(RF)).select("ticker", "date", "rolling_sharpe"), 6)


def monthly_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.monthly_grid(type_returns(spark, sf), ["ticker"]))


def instrument_measures(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.measure_table(type_returns(spark, sf), ["ticker"], F.lit(RF)))


def instrument_measures_long(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series.long_measures(series.measure_table(type_returns(spark, sf), ["ticker"], F.lit(RF)), ["ticker"]))


# --- long series ------------------------------------------------------------------------------


#: What orders the lines of the tape; lines that are equal in all of it have equal returns.
TAPE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount"]


def tape(spark: SparkSession, sf: str) -> DataFrame:
    """All lines as the ticks of one series, in the order of TAPE_ORDER: place, chunk, year, ret, curve, drawdown."""
    lines = T.table(spark, sf, "lineitem").select(F.lit("TAPE").alias("ticker"), *TAPE_ORDER).withColumn("ret", (F.col("l_discount") - 0.05) / 100)
    return scans.with_drawdown(lines, ["ticker"], TAPE_ORDER)


def tape_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every stretch under water of the one long series, by places in it."""
    return rounded(scans.episodes(tape(spark, sf), ["ticker"], "place"))


def tape_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """The rolling Sharpe ratio of the one long series, summed up by year."""
    rows = scans.rolling_sharpe(tape(spark, sf), ["ticker"], F.lit(RF), series.ROLLING_DAYS)
    value = F.col("rolling_sharpe")
    out = rows.groupBy("ticker", F.year("l_shipdate").alias("year")).agg(F.count(value).alias("ticks"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))
    return rounded(out, 5)


def asof_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Every other event of a user with the user's last error at or before it."""
    events = T.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    asked, quotes = events.where("event_type <> 'error'"), events.where("event_type = 'error'")
    rows = asof.asof(asked.select("user_id", "ts", "event_id"), quotes.select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", ["event_id"])
    return rows.select("user_id", "event_id", F.col("quote.event_id").alias("quote_id"), F.col("quote.value").alias("quote_value"))


CONFIDENCES = (0.95, 0.99)


def tail_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Value at risk and expected shortfall of all lines by return flag: few groups of very many values."""
    ret = F.col("l_extendedprice") * (F.col("l_discount") - 0.05) / 1e5
    rows = written(T.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("ticker"), ret.alias("ret")), "returns")
    return rounded(quantiles.tail_measures(rows, ["ticker"], CONFIDENCES))


#: Years that come in batches of their own, after all before them.
LATER_YEARS = (1999, 2000, 2001)


def measures_by_state(spark: SparkSession, sf: str) -> DataFrame:
    """Measures from stored states, into which the states of each later year were merged."""
    rows, batch = written(type_returns(spark, sf), "returns"), F.greatest(F.year("date"), F.lit(LATER_YEARS[0] - 1))
    made = states.of_returns(rows.withColumn("batch", batch), ["ticker", "batch"], F.lit(RF))
    made = written(made, "states")
    stored = made.where(F.col("batch") < LATER_YEARS[0]).drop("batch")
    for year in LATER_YEARS:
        later = F.col("batch") == year if year != LATER_YEARS[-1] else F.col("batch") >= year
        stored = written(states.merged(stored, made.where(later).drop("batch"), ["ticker"]), "states")
    return rounded(states.measures(stored, ["ticker"], F.lit(RF)))


# --- portfolios -------------------------------------------------------------------------------


def rebalance_calendar(spark: SparkSession, sf: str) -> DataFrame:
    dates = T.prices_by(spark, sf, "p_brand").select(F.col("ticker").alias("calendar_id"), "date").distinct()
    frequency = F.explode(F.array(*map(F.lit, specs.REBALANCES))).alias("frequency")
    return calendar.rebalance_dates(dates.select("calendar_id", frequency, "date"), ["calendar_id"])


def weights_of(spark: SparkSession, sf: str, scheme: str) -> DataFrame:
    c = checked_runs(spark, sf)
    runs = valuation.with_strategy(c.runs.where((F.col("weighting") == scheme) & (F.col("transaction_cost_bps") == 0)))
    rows = runs.select("run_id", "strategy_id").join(c.targets.withColumnRenamed("run_id", "strategy_id"), "strategy_id")
    return rounded(rows.select("run_id", "rebalance_date", "ticker", "weight"))


NAV_DIGITS = {"portfolio_value": 2, "benchmark_value": 2, "costs_paid": 4, "portfolio_return": 8, "benchmark_return": 8, "turnover": 8}


def nav_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(valued(spark, sf)[0], NAV_DIGITS)


def run_measures(daily: DataFrame, runs: DataFrame) -> DataFrame:
    keyed = daily.join(runs.select("run_id", "risk_free_rate"), "run_id")
    both = series.both_series(keyed, ["run_id"])
    return series.measure_table(both, ["run_id", "series"], F.col("risk_free_rate"))


def comparison_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(run_measures(*valued(spark, sf)), 6)


def measures_of_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The comparison with a row per measure and a column per series."""
    return rounded(series.measures_by_series(run_measures(*valued(spark, sf)), ["run_id"]), 6)


def headline(spark: SparkSession, sf: str) -> DataFrame:
    daily, runs = valued(spark, sf)
    daily = written(daily, "nav")
    return rounded(valuation.headline(daily, run_measures(daily, runs)), {"final_value": 2, "benchmark_final": 2})


def cost_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(valuation.cost_summary(*valued(spark, sf)), {"total_cost": 4, "entry_cost": 4})


def run_window(spark: SparkSession, sf: str) -> DataFrame:
    return valuation.run_window(*valued(spark, sf))


def run_violations(spark: SparkSession, sf: str) -> DataFrame:
    """The sweep over brands, as custom runs of types that brands are not, with a lookback longer than the history."""
    panel = clean.cleaned(panel_of(T.prices_by(spark, sf, "p_brand"), "TYPE"))
    runs = sweep(spark).withColumn("lookback_days", F.when(F.col("weighting") == "inverse_vol", 4000))
    return valuation.run_violations(runs, written(panel, "panel"))


#: Panels that are wrong in one way each, and the day from which the late one has prices.
FAULTS, LATE_DAY = ("FLAT", "SUNK", "LATE", "THIN", "SHORT", "APART", "NONE", "BENCH", "HOLES", "ENDLESS", "TWICE"), dt.date(1995, 6, 1)


def faulty_prices(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Prices of part types, and their benchmark, once as they are (TYPE) and once for each of FAULTS: FLAT never
    moves, SUNK goes below zero, LATE begins in LATE_DAY's month, THIN lacks every other day of each ticker, SHORT has
    a benchmark on one day only and APART one on other days, NONE has no price at all, BENCH lacks much of its benchmark, HOLES has NaN for
    every 20th day's price (which is no fault: the day before's is carried on), ENDLESS an infinite price and TWICE two prices of PROMO in January 1996."""
    kind, odd = F.col("panel_id"), F.pmod(F.datediff("date", F.lit(dt.date(1990, 1, 1))), F.lit(20)) < 10
    panels = F.explode(F.array(*map(F.lit, ("TYPE", *FAULTS)))).alias("panel_id")
    prices = type_prices(spark, sf).select(panels, "ticker", "date", "close")
    close = F.when(kind == "FLAT", 100.0).when(kind == "SUNK", F.col("close") - 105).when((kind == "THIN") & odd, None).when(kind == "NONE", None).otherwise(F.col("close"))
    close = F.when((kind == "HOLES") & (F.pmod(F.datediff("date", F.lit(dt.date(1990, 1, 1))), F.lit(20)) == 0), float("nan")).otherwise(close)
    promo = (F.col("ticker") == "PROMO") & (F.trunc("date", "month") == WINDOW[0])
    close = F.when((kind == "ENDLESS") & promo, float("inf")).otherwise(close)
    prices = prices.withColumn("close", close).where((kind != "LATE") | (F.col("date") >= LATE_DAY))
    prices = prices.withColumn("again", F.explode(F.sequence(F.lit(1), F.when((kind == "TWICE") & promo, 2).otherwise(1)))).drop("again")
    other = T.benchmark_prices(spark, sf).select(panels, "ticker", "date", "close")
    other = other.where((kind != "SHORT") | (F.col("date") == WINDOW[0])).withColumn("date", F.when(kind == "APART", F.date_add("date", 36_500)).otherwise(F.col("date")))
    return prices, other.withColumn("close", F.when((kind == "BENCH") & odd, None).otherwise(F.col("close")))


def faulty_runs(spark: SparkSession) -> DataFrame:
    """The monthly runs of the sweep on every panel, and some that are wrong by themselves."""
    base = sweep(spark).where("rebalance = 'monthly' AND transaction_cost_bps = 10")
    panels = base.drop("panel_id").withColumn("panel_id", F.explode(F.array(*map(F.lit, ("TYPE", *FAULTS, "ABSENT")))))
    panels = panels.withColumn("run_id", F.concat_ws("-", "panel_id", "weighting"))
    equal = base.where("weighting = 'equal'")
    own = [
        equal.withColumns({"run_id": F.lit("own-ticker"), "tickers": F.array(F.lit("PROMO"), F.lit("GONE"))}), equal.withColumns({"run_id": F.lit("own-benchmark"), "benchmark": F.lit("GONE")}),
        equal.withColumns({"run_id": F.lit("own-start"), "start": F.lit(dt.date(1990, 1, 1))}), equal.withColumns({"run_id": F.lit("own-capital"), "initial_capital": F.lit(0.0)}),
        base.where("weighting = 'inverse_vol'").withColumns({"run_id": F.lit("own-lookback"), "lookback_days": F.lit(4000)}),
        equal.withColumn("run_id", F.lit("own-twice")), equal.withColumns({"run_id": F.lit("own-twice"), "initial_capital": F.lit(5000.0)}), equal.withColumn("run_id", F.lit(None).cast("string")),
        equal.withColumns({"run_id": F.lit("own-infinite"), "initial_capital": F.lit(float("inf"))}), equal.withColumns({"run_id": F.lit("own-order"), "tickers": F.reverse("tickers")}),
        base.where("panel_id = 'TYPE'").withColumns({"run_id": F.concat(F.lit("own-window-"), "weighting"), "start": F.lit(WINDOW[0]), "end": F.lit(WINDOW[1])}),
    ]
    for rows in own:
        panels = panels.unionByName(rows)
    return panels


def run_problems(spark: SparkSession, sf: str) -> DataFrame:
    return guard.checked(faulty_runs(spark), *faulty_prices(spark, sf)).problems


def sound_run_values(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of the faulty runs, valued: last day and value."""
    c = guard.checked(faulty_runs(spark), *faulty_prices(spark, sf))
    daily = c.nav_daily()
    out = daily.groupBy("run_id").agg(F.max("date").alias("last_date"), F.max_by("portfolio_value", "date").alias("final_value"), F.min("portfolio_value").alias("least_value"))
    return rounded(out, 2)


#: How users write dates: the last six are none.
STARTS = ("1995-01-02 ", "19950102", " 1995-W01-1", "1995W011", "1995-W01", "1995", "1995-1-2", "1995-01-02 10:00", "1995-13-01", "1995-W53-1", "02.01.1995")


def customer_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A run definition for each customer as a line of JSON, as users might write it, mistakes included."""
    key = F.col("c_custkey")
    names = F.array(F.concat(F.lit(" "), F.lower("c_mktsegment")), F.lit("ALL "), F.concat(F.lit("N"), (F.col("c_nationkey") % 5).cast("string")), F.when(key % 7 == 0, F.lit("all")).otherwise(F.lit("X")))
    names = F.when(key % 17 == 3, F.array().cast("array<string>")).when(key % 17 == 4, F.array(F.lit("A"), F.lit("  "), F.lit("B"), F.lit("C"))).otherwise(names)
    weighting = F.when(key % 4 == 0, "Equal ").when(key % 4 == 1, "custom").when(key % 4 == 2, "INVERSE_VOL").otherwise("market")
    rebalance = F.when(key % 3 == 0, " monthly").when(key % 3 == 1, "Annual").otherwise("weekly")
    doubles = lambda *x: F.array(*map(F.lit, x))
    custom = F.when(key % 24 == 9, doubles(0.5, 0.5)).when(key % 8 == 1, doubles(0.25, 0.25, 0.25, 0.25)).when(key % 8 == 5, doubles(0.5, 0.25, 0.5, -0.5))
    start = F.get(F.array(*map(F.lit, STARTS)), (key % len(STARTS)).cast("int"))
    lines = T.table(spark, sf, "customer").select(key.alias("key"), F.to_json(F.struct(
        F.col("c_name").alias("run_id"), F.lit("P").alias("panel_id"), names.alias("tickers"), F.when(key % 2 == 0, "spx ").alias("benchmark"),
        start.alias("start"), F.when(key % 19 == 5, "never").when(key % 5 == 0, "1994-01-01").otherwise("2000-12-31").alias("end"),
        F.col("c_acctbal").alias("initial_capital"), weighting.alias("weighting"), rebalance.alias("rebalance"), F.when(key % 23 != 6, F.lit(RF)).alias("risk_free_rate"),
        (F.col("c_nationkey") - 2).cast("double").alias("transaction_cost_bps"), custom.alias("custom_weights"), F.when(key % 12 != 10, key % 6).cast("int").alias("lookback_days"),
        F.when(key % 10 == 0, "blue").alias("colour"), F.when(key % 15 == 0, 1).alias("currency"),
    )).alias("line"))
    k, line = F.col("key"), F.col("line")
    wrong = F.when(k % 29 == 3, F.regexp_replace(line, '"initial_capital":[-0-9.E]+', '"initial_capital":true')).when(k % 29 == 7, F.regexp_replace(line, '"risk_free_rate":[0-9.]+', '"risk_free_rate":"0.02"'))
    wrong = wrong.when(k % 29 == 11, F.regexp_replace(line, '"lookback_days":([0-9]+)', '"lookback_days":$1.5')).when(k % 29 == 13, F.regexp_replace(line, '"tickers":[^\\]]*\\]', '"tickers":"A"'))
    wrong = wrong.when(k % 29 == 17, F.regexp_replace(line, '"custom_weights":\\[', '"custom_weights":[null,')).when(k % 29 == 19, F.substring(line, 1, 70)).when(k % 29 == 23, F.concat(F.lit("["), line, F.lit("]")))
    return lines.select(F.coalesce(wrong, line).alias("line"))


def customer_specs(spark: SparkSession, sf: str) -> DataFrame:
    return P.parsed_specs(customer_lines(spark, sf), "line")


def spec_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The keys that readable definitions must not have."""
    return customer_specs(spark, sf).select("run_id", F.array_join("unknown_keys", "|").alias("unknown_keys")).where("unknown_keys <> ''")


def spec_violations(spark: SparkSession, sf: str) -> DataFrame:
    return specs.violations(specs.normalised(customer_specs(spark, sf)))


def spec_unreadable(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a written file that hold no JSON object."""
    path = fresh_path(spark, "lines")
    customer_lines(spark, sf).withColumnRenamed("line", "value").write.text(path)
    return P.read_unreadable(spark, path).select(F.left("value", F.lit(40)).alias("line"))


def spec_normalised(spark: SparkSession, sf: str) -> DataFrame:
    out = specs.normalised(customer_specs(spark, sf)).where("run_id IS NOT NULL")
    return out.select("run_id", F.array_join("tickers", "|").alias("tickers"), "benchmark", "start", "end", "weighting", "rebalance")


def benchmark_value(spark: SparkSession, sf: str) -> DataFrame:
    rows = series.daily_returns(T.benchmark_prices(spark, sf), ["ticker"])
    first = F.first("close").over(series.Window.partitionBy("ticker").orderBy("date").rowsBetween(series.Window.unboundedPreceding, 0))
    return rounded(rows.select("date", (CAPITAL * F.col("close") / first).alias("benchmark_value"), F.coalesce("ret", F.lit(0.0)).alias("benchmark_return")), {"benchmark_value": 4})


#: Tickers that runs on windows of their own ask for, by place in TICKERS, and their days.
SUBSETS = ((0, 1, 2, 3, 4, 5), (0, 2, 4), (5, 1), (3,))
SPANS = ((dt.date(1995, 1, 1), dt.date(2001, 12, 31)), (dt.date(1996, 3, 15), dt.date(1996, 12, 31)), WINDOW)


def window_runs(spark: SparkSession) -> DataFrame:
    """Runs of every scheme on several sets of tickers and several windows of one stored panel."""
    rows = []
    for (i, places), (j, (start, end)), w in product(enumerate(SUBSETS), enumerate(SPANS), specs.WEIGHTINGS):
        tickers = [TICKERS[k] for k in places]
        custom = [(k + 1) / sum(range(len(tickers) + 1)) for k in range(len(tickers))] if w == "custom" else None
        rows.append((f"{i}-{j}-{w}", "TYPE", tickers, "ALL", start, end, CAPITAL, w, "monthly", RF, 10.0, custom, 21 + 21 * j if w == "inverse_vol" else None))
    return spark.createDataFrame(rows, schemas.RUN_SPEC)


def windowed_nav(spark: SparkSession, sf: str) -> DataFrame:
    """Daily values of runs that differ in tickers and days, from one table of prices."""
    checked = guard.checked(window_runs(spark), panel_of(type_prices(spark, sf), "TYPE"), panel_of(T.benchmark_prices(spark, sf), "TYPE"))
    return rounded(checked.nav_daily(), NAV_DIGITS)


# --- stored tables ----------------------------------------------------------------------------


#: The day of which stored prices are corrected.
CORRECTED = dt.date(1996, 7, 4)


def stored_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Prices of brands stored by year, two of the years replaced, one day of a third corrected and a new ticker's day added; a
    range of dates of the last version, beside what the first version has there."""
    path = fresh_path(spark, "stored-prices")
    prices = T.prices_by(spark, sf, "p_brand")
    first = store.upsert(prices, path)
    store.upsert(prices.where(F.year("date").isin(1995, 1998)).withColumn("close", F.col("close") * 2), path)
    day = prices.where(F.col("date") == CORRECTED)
    store.upsert(day.withColumn("close", F.col("close") + 1).unionByName(day.limit(1).withColumns({"ticker": F.lit("NEW"), "close": F.lit(7.0)})), path)
    last = store.read_prices(spark, path, dt.date(1995, 7, 1), WINDOW[1])
    before = store.read_prices(spark, path, dt.date(1995, 7, 1), WINDOW[1], first).withColumnRenamed("close", "first_close")
    return rounded(last.join(before, ["ticker", "date"], "left"))


def bucketed_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Days, growth and worst fall of every brand from a table in buckets, whose plan has no shuffle."""
    rows = bucketed.staged(T.prices_by(spark, sf, "p_brand"))
    rows = series.with_drawdown(series.daily_returns(rows, ["ticker"]), ["ticker"])
    return rounded(rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("days"), F.max_by("curve", "date").alias("growth"), F.min("drawdown").alias("max_drawdown")), 7)


#: Files of other things among those of prices.
STRAY_FILES = 3


def readable_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Days of each brand, read from a folder in which some files hold customers' lines instead, and how many files have which fault."""
    path = fresh_path(spark, "files")
    T.prices_by(spark, sf, "p_brand").write.parquet(f"{path}/prices")
    customer_lines(spark, sf).withColumnRenamed("line", "value").repartition(STRAY_FILES).write.text(f"{path}/lines")
    prices, bad = files.checked(spark, path, "part-*")
    days = prices.groupBy(F.col("ticker").alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"))
    return days.unionByName(bad.groupBy(F.col("reason").alias("subject")).agg(F.count(F.lit(1)).alias("n")), allowMissingColumns=True)


def stored_nav(spark: SparkSession, sf: str) -> DataFrame:
    """The daily result written in folders by run and read again."""
    path = fresh_path(spark, "stored-nav")
    P.write_result(valued(spark, sf)[0], path, by="run_id")
    rows = spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("days"), F.sum("costs_paid").alias("costs"), F.max("date").alias("last_date"))
    return rounded(rows, 2)


def stored_horizons(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar-year returns as a horizon table, written and read again."""
    path = fresh_path(spark, "stored-horizons")
    years = type_returns(spark, sf).where("ret IS NOT NULL").groupBy("ticker", F.year("date").alias("year")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    P.write_result(years, path)
    return rounded(spark.read.parquet(path))


def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' names, made worse, as parts of paths."""
    key = F.col("c_custkey")
    raw = F.when(key % 9 == 0, "^^").otherwise(F.concat(F.lit("^"), F.translate("c_name", "#", "/"), F.lit("-."), F.col("c_mktsegment"), F.lit("=X ")))
    return T.table(spark, sf, "customer").select("c_custkey", P.safe_name(raw).alias("name"))


# --- resampling -------------------------------------------------------------------------------


def bootstrap_paths(spark: SparkSession, sf: str, n_paths: int) -> DataFrame:
    return resample.paths(written(type_returns(spark, sf), "returns"), ["ticker"], CAPITAL, n_paths=n_paths)


def bootstrap_draws(spark: SparkSession, sf: str) -> DataFrame:
    rows = resample.numbered(type_returns(spark, sf), ["ticker"])
    table = resample.draws(written(rows.select("n_obs").distinct(), "lengths"), 50, 252)
    return table.groupBy("n_obs", "path").agg(F.sum("idx").alias("sum_idx"), F.min("idx").alias("low"), F.max("idx").alias("high"))


def bootstrap_horizons(spark: SparkSession, sf: str, n_paths: int = PATHS) -> DataFrame:
    return rounded(resample.horizons(bootstrap_paths(spark, sf, n_paths), ["ticker"], CAPITAL), {"median": 2, "p10": 2, "p90": 2, "benchmark_median": 2})


def bootstrap_fan(spark: SparkSession, sf: str, n_paths: int = PATHS) -> DataFrame:
    return rounded(resample.fan(bootstrap_paths(spark, sf, n_paths), ["ticker"]), 2)


QUERIES = {
    f.__name__: f
    for f in (
        instrument_summary, universe_window, missing_tickers, clean_panel, dropped_tickers, coverage_violations, panel_facts, panel_violations, aligned_dates,
        daily_returns, drawdown_curve, drawdown_episodes, top_drawdowns, rolling_sharpe, monthly_grid, instrument_measures, instrument_measures_long,
        tape_episodes, tape_rolling, asof_quotes, tail_risk, measures_by_state,
        rebalance_calendar, nav_daily, windowed_nav, comparison_table, headline, cost_summary, run_window, run_violations, run_problems, sound_run_values, measures_of_runs, spec_keys, spec_violations, spec_unreadable, spec_normalised, stored_prices, readable_prices, bucketed_summary, stored_nav, stored_horizons, safe_names, benchmark_value,
        bootstrap_draws, bootstrap_horizons, bootstrap_fan,
    )
} | {
    "daily_close_from_ticks": partial(daily_close, ticker="event_type"), "daily_close_by_user": partial(daily_close, ticker="user_id"),
    "weights_equal": partial(weights_of, scheme="equal"), "weights_custom": partial(weights_of, scheme="custom"), "weights_inverse_vol": partial(weights_of, scheme="inverse_vol"),
}
