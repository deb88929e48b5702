"""Run definitions: normalise and validate many at once, without a Python function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.prices import UNREADABLE

# The names that a run definition may use.
WEIGHTINGS = ("equal", "custom", "inverse_vol")
REBALANCES = ("none", "monthly", "quarterly", "annual")
DEFAULT_BENCHMARK = "SPY"
SUM_TOLERANCE = 1e-6
#: The column of the rules of types that a definition breaks, as sources.prices.parsed_specs finds them.
WRONG = "wrong_types"


def iso_date(text: Column) -> Column:
    """A calendar date (2020-01-31 or 20200131) or week date (2020-W05-5, 2020W055, 2020-W05 for its Monday); NULL if it is none."""
    text = F.trim(text)
    plain = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).when(text.rlike(r"^\d{8}$"), F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
    week = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?$"
    dashes = text.rlike(r"^\d{4}-W\d{2}(-[1-7])?$") | text.rlike(r"^\d{4}W\d{2}[1-7]?$")
    part = lambda k: F.nullif(F.regexp_extract(text, week, k), F.lit("")).cast("int")
    year, number, day = part(1), part(2), F.coalesce(part(3), F.lit(1))
    # the year's first week holds 4 January
    fourth = F.try_to_date(F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-01-04")))
    monday = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (number - 1) * 7)
    by_week = F.when(dashes & (number >= 1) & (year >= 1) & (F.year(F.date_add(monday, 3)) == year), F.date_add(monday, day - 1))
    return F.coalesce(F.when(plain >= "0001", F.try_to_date(plain, "yyyy-MM-dd")), by_week)


def normalised(specs: DataFrame) -> DataFrame:
    """Names trimmed and in one case, ISO dates parsed (NULL if they are none), the default benchmark filled in."""
    return specs.withColumns({
        "tickers": F.transform("tickers", lambda t: F.upper(F.trim(t))),
        "benchmark": F.upper(F.trim(F.coalesce(F.nullif(F.col("benchmark"), F.lit("")), F.lit(DEFAULT_BENCHMARK)))),
        "weighting": F.lower(F.trim("weighting")), "rebalance": F.lower(F.trim("rebalance")),
        "start": iso_date(F.col("start")), "end": iso_date(F.col("end")),
    })


def broken_rules(specs: DataFrame) -> Column:
    """The names of the rules that a normalised run breaks, as an array."""
    c = F.col
    custom, inverse = c("weighting") == "custom", c("weighting") == "inverse_vol"
    given = c("custom_weights").isNotNull() & (F.size("custom_weights") > 0)
    total = F.aggregate("custom_weights", F.lit(0.0), lambda a, x: a + x)
    finite = lambda x: F.coalesce(F.abs(c(x)) < float("inf"), F.lit(True)) | F.isnan(x)
    rules = {
        "run_id missing": c("run_id").isNull(),
        "tickers missing": c("tickers").isNull() | (F.size("tickers") == 0),
        "tickers blank": F.exists("tickers", lambda t: t.isNull() | (t == "")),
        "tickers duplicated": F.size(F.array_distinct("tickers")) < F.size("tickers"),
        "start not a date": c("start").isNull(),
        "end not a date": c("end").isNull(),
        "start not before end": c("start") >= c("end"),
        "initial_capital not positive": c("initial_capital").isNull() | F.isnan("initial_capital") | (c("initial_capital") <= 0),
        "initial_capital not finite": ~finite("initial_capital"),
        "transaction_cost_bps not finite": ~finite("transaction_cost_bps"),
        "risk_free_rate not finite": ~finite("risk_free_rate"),
        "transaction_cost_bps negative": c("transaction_cost_bps").isNull() | F.isnan("transaction_cost_bps") | (c("transaction_cost_bps") < 0),
        "risk_free_rate missing": c("risk_free_rate").isNull() | F.isnan("risk_free_rate"),
        "weighting unknown": c("weighting").isNull() | ~c("weighting").isin(*WEIGHTINGS),
        "rebalance unknown": c("rebalance").isNull() | ~c("rebalance").isin(*REBALANCES),
        "custom_weights missing": custom & ~given,
        "custom_weights not one per ticker": custom & given & (F.size("custom_weights") != F.size("tickers")),
        "custom_weights negative": custom & given & F.exists("custom_weights", lambda x: x.isNull() | (x < 0)),
        "custom_weights do not sum to one": custom & given & (F.abs(total - 1) > SUM_TOLERANCE),
        "lookback_days missing": inverse & c("lookback_days").isNull(),
        "lookback_days below two": inverse & (c("lookback_days") < 2),
    }
    if COPIES in specs.columns:
        rules["run_id duplicated"] = c("run_id").isNotNull() & (c(COPIES) > 1)
    if "unknown_keys" in specs.columns:
        rules["unknown keys"] = F.size("unknown_keys") > 0
    found = lambda names: F.array_compact(F.array(*(F.when(rules[name], F.lit(name)) for name in names)))
    if WRONG not in specs.columns:
        return found(rules)
    # A value of the wrong type breaks that rule and no other of its key, and matters only where its key does.
    wrong, always = c(WRONG), ("initial_capital", "risk_free_rate", "transaction_cost_bps", "tickers")
    of_key = {name: next((k for k in (*always, "custom_weights", "lookback_days") if name.startswith(k)), None) for name in rules}
    for name, key in of_key.items():
        if key:
            rules[name] = rules[name] & ~F.exists(wrong, lambda w: w.startswith(f"{key} not a"))  # noqa: B023
    needed = F.filter(wrong, lambda w: (custom | ~w.startswith("custom_weights")) & (inverse | ~w.startswith("lookback_days")))
    return F.when(F.array_contains(wrong, UNREADABLE), wrong).otherwise(F.concat(found(rules), needed))


#: The number of definitions with a definition's run_id, while rules are looked at.
COPIES = "copies_"


def with_copies(specs: DataFrame) -> DataFrame:
    """Definitions without an id are dealt by all they hold, as they may be many."""
    unnamed = F.when(F.col("run_id").isNull(), F.xxhash64(*specs.columns))
    return specs.withColumn(COPIES, F.count(F.lit(1)).over(Window.partitionBy("run_id", unnamed)))


def violations(specs: DataFrame) -> DataFrame:
    """run_id and rule of every rule that a normalised run breaks; a run without rows is sound."""
    counted = with_copies(specs)
    return counted.select("run_id", F.explode(broken_rules(counted)).alias("rule")).distinct()


def sound(specs: DataFrame) -> DataFrame:
    """The runs that break no rule: each has an id, and no other run has it."""
    counted = with_copies(specs)
    return counted.where(F.size(broken_rules(counted)) == 0).drop(COPIES)


def require_none(found: DataFrame) -> None:
    """Raise for the first rows of a table of violations; for callers with a single run, who want an error."""
    rows = found.limit(5).collect()
    if rows:
        raise ValueError("; ".join(", ".join(str(x) for x in r) for r in rows))
