"""Clean price panels: short gaps filled, thin tickers and incomplete dates dropped, and panels aligned with each
other. Everything is by ``panel_id``: what is dropped in one panel does not touch another. What is dropped or wrong is
returned as a table, not raised.

A panel's dates are numbered, and each price is a span of places: its own and those that it is carried on to. The
share of a ticker's missing rows is a sum over its spans, and the dates that a ticker lacks are the gaps between them, counted by
a running sum over the dates of +1 where a gap begins and -1 where it ends. So nothing has a row for every date and ticker.

A NaN is a missing price. Of several rows of one ticker and day the highest price counts here; ``operators.guard`` refuses
runs on such series. A null date belongs to no date of the panel and is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import datesets
from ledgerline.sources.staging import written

#: Rows of the panel that a price is carried on, the largest share of missing rows of a ticker, and how many days late it may start.
FILL_ROWS, MISSING_LIMIT, START_SLACK = 5, 0.10, 7

SERIES = ("panel_id", "ticker")


def price(close: Column) -> Column:
    """The close, or NULL where it is NaN."""
    return F.when(~F.isnan(close), close)


def daily(panel: DataFrame) -> DataFrame:
    """One row per ticker and day: close, the number of rows it had and whether one of them was infinite."""
    close = price(F.col("close"))
    return panel.where("date IS NOT NULL").groupBy(*SERIES, "date").agg(
        F.max(close).alias("close"), F.count(F.lit(1)).alias("n_rows"), F.max(F.coalesce(F.abs(close) == float("inf"), F.lit(False))).alias("infinite")
    )


def numbered_dates(days: DataFrame) -> DataFrame:
    """panel_id, date, place (from 0) and n_dates of each panel. A panel's dates are in one task, its tickers are not."""
    w = Window.partitionBy("panel_id")
    dates = days.select("panel_id", "date").distinct()
    return dates.select("panel_id", "date", (F.row_number().over(w.orderBy("date")) - 1).alias("place"), F.count(F.lit(1)).over(w).cast("int").alias("n_dates"))


def spans(days: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per price: place, until (before which it is carried on), next (place of the ticker's next price, or n_dates), whether
    it is the ticker's first, and the ticker's missing_share and whether it stays."""
    w = Window.partitionBy(*SERIES)
    rows = days.where("close IS NOT NULL").join(dates, ["panel_id", "date"]).withColumns({
        "next": F.coalesce(F.lead("place").over(w.orderBy("place")), F.col("n_dates")), "is_first": F.row_number().over(w.orderBy("place")) == 1,
    })
    rows = rows.withColumn("until", F.least("next", F.col("place") + 1 + FILL_ROWS))
    missing = (F.col("n_dates") - F.sum(F.col("until") - F.col("place")).over(w)) / F.col("n_dates")
    rows = rows.withColumn("missing_share", missing).withColumn("kept", F.col("missing_share") <= MISSING_LIMIT)
    return rows.select(*SERIES, "date", "close", "place", "until", "next", "is_first", "n_dates", "missing_share", "kept")


def complete_dates(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """panel_id, date and place on which every ticker that stays has a price. ``rows`` are spans."""
    kept = rows.where("kept")
    gap = lambda lo, hi: F.when(lo < hi, F.array(F.struct(lo.alias("place"), F.lit(1).alias("change")), F.struct(hi.alias("place"), F.lit(-1).alias("change"))))
    none = F.array().cast("array<struct<place:int,change:int>>")
    before = F.when(F.col("is_first"), gap(F.lit(0), F.col("place")))
    ends = F.concat(F.coalesce(before, none), F.coalesce(gap(F.col("until"), F.col("next")), none))
    changes = kept.select("panel_id", F.inline(ends)).groupBy("panel_id", "place").agg(F.sum("change").alias("change"))
    upto = Window.partitionBy("panel_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    some = dates.join(kept.select("panel_id").distinct(), "panel_id", "left_semi").join(changes, ["panel_id", "place"], "left")
    return some.withColumn("gaps", F.sum(F.coalesce("change", F.lit(0))).over(upto)).where("gaps = 0").select("panel_id", "date", "place")


def carried(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """panel_id, ticker, date, close: the spans of tickers that stay on the given dates (panel_id, date, place)."""
    at = rows.where("kept").select(*SERIES, "close", F.explode(F.sequence(F.col("place"), F.col("until") - 1)).alias("place"))
    return at.join(dates.select("panel_id", "place", "date"), ["panel_id", "place"]).select(*SERIES, "date", "close")


def spanned(panel: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The days of a panel, its numbered dates and its spans; days and spans are written, as all else reads them."""
    days = written(daily(panel), "days")
    dates = numbered_dates(days)
    return days, dates, written(spans(days, dates), "spans")


def cleaned(panel: DataFrame) -> DataFrame:
    """panel_id, ticker, date, close of the tickers that stay, on the dates where all of them have a price."""
    _, dates, rows = spanned(panel)
    return carried(rows, complete_dates(rows, dates))


def shares_of(days: DataFrame, rows: DataFrame) -> DataFrame:
    """panel_id, ticker, first_date (of a price), missing_share, kept; a ticker without any price lacks every row."""
    facts = rows.where("is_first").select(*SERIES, F.col("date").alias("first_date"), "missing_share", "kept")
    out = days.select(*SERIES).distinct().join(facts, [*SERIES], "left")
    return out.select(*SERIES, "first_date", F.coalesce("missing_share", F.lit(1.0)).alias("missing_share"), F.coalesce("kept", F.lit(False)).alias("kept"))


def ticker_shares(panel: DataFrame) -> DataFrame:
    """The share of missing rows of each ticker, and whether it stays."""
    days, _, rows = spanned(panel)
    return shares_of(days, rows).drop("first_date")


def late_tickers(panel: DataFrame, starts: DataFrame) -> DataFrame:
    """Tickers whose first price is more than START_SLACK days after the panel's ``start``, or that have none."""
    first = panel.groupBy(*SERIES).agg(F.min(F.when(price(F.col("close")).isNotNull(), F.col("date"))).alias("first_date"))
    late = first.join(starts, "panel_id").where(F.col("first_date").isNull() | (F.col("first_date") > F.date_add("start", START_SLACK)))
    reason = F.when(F.col("first_date").isNull(), "no prices").otherwise("starts late")
    return late.select(*SERIES, "first_date", reason.alias("reason"))


def panel_facts(panel: DataFrame) -> DataFrame:
    """Per panel: dates and tickers before and after, and the dates dropped as incomplete."""
    days, dates, rows = spanned(panel)
    complete = complete_dates(rows, dates).groupBy("panel_id").agg(F.count(F.lit(1)).alias("complete_dates"))
    tickers = shares_of(days, rows).groupBy("panel_id").agg(F.count(F.lit(1)).alias("tickers"), F.count_if("kept").alias("tickers_kept"))
    all_dates = dates.groupBy("panel_id").agg(F.count(F.lit(1)).alias("dates"))
    out = all_dates.join(tickers, "panel_id").join(complete, "panel_id", "left").na.fill(0, ["complete_dates"])
    dropped = F.when(F.col("tickers_kept") > 0, F.col("dates") - F.col("complete_dates")).otherwise(0)
    return out.select("panel_id", "dates", "tickers", "tickers_kept", "complete_dates", dropped.alias("dropped_dates"))


def aligned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both panels on the dates that they share. Rows without a date go."""
    both = datesets.shared(left, right, ["panel_id"])
    return datesets.at_dates(left, both, ["panel_id"]), datesets.at_dates(right, both, ["panel_id"])


def panel_violations(panel: DataFrame, benchmark: DataFrame) -> DataFrame:
    """panel_id and rule of everything that keeps a panel from being valued."""
    close = price(F.col("close"))
    by_day = panel.groupBy(*SERIES, "date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(close.isNull()).alias("missing"), F.count_if(close <= 0).alias("bad"), F.count_if(F.abs(close) == float("inf")).alias("infinite")
    )
    facts = by_day.groupBy("panel_id").agg(
        F.sum("missing").alias("missing"), F.sum("bad").alias("bad"), F.sum("infinite").alias("infinite"), F.count_if(F.col("n_rows") > 1).alias("repeated"), F.count_distinct("date").alias("dates")
    )
    other = benchmark.groupBy("panel_id").agg(F.count_distinct("ticker").alias("series"))
    # A date is odd if one side alone has it; a missing date is one too.
    a, b = datesets.of(panel, ["panel_id"]), datesets.of(benchmark, ["panel_id"])
    counts = datesets.sizes(a.unionByName(b), ["panel_id"], "either").join(datesets.sizes(datesets.common(a.unionByName(b), ["panel_id"], 2), ["panel_id"], "both"), "panel_id", "left")
    undated = panel.where("date IS NULL").select("panel_id", F.lit(1).alias("side")).unionByName(benchmark.where("date IS NULL").select("panel_id", F.lit(2).alias("side")))
    one_sided = undated.groupBy("panel_id").agg((F.count_distinct("side") == 1).cast("bigint").alias("undated"))
    odd = counts.join(one_sided, "panel_id", "full").select("panel_id", (F.coalesce("either", F.lit(0)) - 2 * F.coalesce("both", F.lit(0)) + F.coalesce("undated", F.lit(0))).alias("odd_dates"))
    every = facts.join(other, "panel_id", "full").join(odd, "panel_id", "full")
    rules = {
        "no prices": F.col("dates").isNull(), "missing prices": F.col("missing") > 0, "non-positive prices": F.col("bad") > 0, "infinite prices": F.col("infinite") > 0,
        "repeated prices": F.col("repeated") > 0, "dates differ from the benchmark": F.col("odd_dates") > 0, "fewer than two dates": F.col("dates") < 2,
        "not exactly one benchmark series": F.coalesce(F.col("series"), F.lit(0)) != 1,
    }
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return every.select("panel_id", F.explode(found).alias("rule"))
