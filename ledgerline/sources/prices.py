"""Prices and run definitions: normalise, select and read (sources/store.py stores prices)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import schemas


def normalised_ticks(raw: DataFrame) -> DataFrame:
    """Daily closes from ``ticker, ts, close, seq``: the last tick of each day by ``seq`` wins.
    NaN becomes NULL here and nowhere later. ``ts`` without a time zone keeps its wall-clock date."""
    close = F.col("close").cast("double")
    ticks = raw.select("ticker", F.to_date("ts").alias("date"), F.when(~F.isnan(close), close).alias("close"), "seq")
    return ticks.groupBy("ticker", "date").agg(F.max_by("close", "seq").alias("close"))


def safe_name(ticker: Column) -> Column:
    """A ticker as part of a path: letters and digits, all else as one underscore; ``ticker`` if none are left."""
    name = F.btrim(F.regexp_replace(ticker, "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("ticker"))


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """Run definitions, one JSON object per line, as ``parsed_specs`` has them; blank lines are none."""
    return parsed_specs(spec_lines(spark, path), "value")


def spec_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")


def read_unreadable(spark: SparkSession, path: str) -> DataFrame:
    """file and value of the lines that hold no JSON object."""
    return spec_lines(spark, path).where(~is_object(F.try_parse_json("value"))).select("file", "value")


#: Rule of a line that holds no JSON object.
UNREADABLE = "line unreadable"
NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def parsed_specs(lines: DataFrame, column: str) -> DataFrame:
    """The definitions in a column of JSON objects. A value of the wrong type is NULL, and wrong_types has the rule that it
    breaks: a boolean or a text is no number, 63.5 and 63.0 are no whole numbers, a null is neither. unknown_keys has the keys that
    are none of a definition's. A text that is no object gives a row of NULLs with the rule UNREADABLE."""
    known = [field.split()[0] for field in schemas.RUN_SPEC_RAW.split(", ")]
    rows = lines.select(F.try_parse_json(column).alias("v"), F.json_object_keys(column).alias("keys"))
    get = lambda key, kind: F.try_variant_get("v", f"$.{key}", kind)
    kind = lambda key: F.schema_of_variant(get(key, "variant"))
    is_list = lambda key: kind(key).startswith("ARRAY")
    numbers = is_list("custom_weights") & F.forall(get("custom_weights", "array<variant>"), lambda x: F.coalesce(F.schema_of_variant(x).rlike(NUMBER), F.lit(False)))
    typed = {name: kind(name).rlike(NUMBER) for name in ("initial_capital", "risk_free_rate", "transaction_cost_bps")}
    wrong = {f"{name} not a number": ~ok for name, ok in typed.items()} | {
        "tickers not a list": ~is_list("tickers"), "custom_weights not a list of numbers": (kind("custom_weights") != "VOID") & ~numbers,
        "lookback_days not a whole number": kind("lookback_days") != "BIGINT",
    }
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in wrong.items())))
    values = {field.split()[0]: get(*field.split()) for field in schemas.RUN_SPEC_RAW.split(", ")}
    values |= {name: F.when(ok, values[name]) for name, ok in typed.items()} | {"tickers": F.when(is_list("tickers"), values["tickers"]), "custom_weights": F.when(numbers, values["custom_weights"])}
    values["lookback_days"] = F.when(kind("lookback_days") == "BIGINT", F.least(get("lookback_days", "bigint"), F.lit(2**31 - 1)).cast("int"))
    unknown = F.array_sort(F.array_except("keys", F.array(*map(F.lit, known))))
    none = F.array().cast("array<string>")
    return rows.select(
        *(values[name].alias(name) for name in known), F.when(is_object(F.col("v")), F.coalesce(unknown, none)).otherwise(none).alias("unknown_keys"),
        F.when(is_object(F.col("v")), found).otherwise(F.array(F.lit(UNREADABLE))).alias("wrong_types"),
    )


def write_result(df: DataFrame, path: str, by: str | None = None) -> None:
    """Write a daily result or a horizon table, in folders by ``by`` if given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def in_windows(rows: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, date, ...) joined with each of ``windows`` (keys, start, end, ...) that holds their date.

    A window of up to 2^k days has level k and lies in at most two of that level's buckets of 2^k days. Rows are looked up in
    their bucket of every level in use, so a key's rows meet the windows of their own time and length only, however many there
    are of others, and a key that most windows ask for is many join keys. ``windows`` is read twice: write it before if it is dear."""
    days = F.datediff("end", "start") + 1
    level = F.when(days > 1, F.ceil(F.log2(days.cast("double"))).cast("int")).otherwise(0)
    bucket = lambda day, of: F.floor(F.unix_date(day) / F.pow(F.lit(2.0), of)).cast("int")
    asked = windows.where("start <= end").withColumn("level_", level)
    levels = sorted(r[0] for r in asked.select("level_").distinct().collect())  # 23 at most: dates have 4-digit years
    asked = asked.withColumn("bucket_", F.explode(F.array_distinct(F.array(bucket("start", F.col("level_")), bucket("end", F.col("level_"))))))
    places = F.array(*(F.struct(F.lit(k).alias("level_"), bucket("date", F.lit(k)).alias("bucket_")) for k in levels))
    found = rows.select("*", F.inline(places if levels else places.cast("array<struct<level_:int,bucket_:int>>"))).join(asked, [*keys, "level_", "bucket_"])
    return found.where(F.col("date").between(F.col("start"), F.col("end"))).drop("level_", "bucket_")


def universe_prices(prices: DataFrame, universe: DataFrame) -> DataFrame:
    """Prices of the requested tickers in their window. ``universe``: panel_id, ticker, start, end."""
    return in_windows(prices, universe, ["ticker"]).select("panel_id", "ticker", "date", "close")


def missing_tickers(prices: DataFrame, universe: DataFrame) -> DataFrame:
    """Requested tickers without any price in their window."""
    have = universe_prices(prices.where("close IS NOT NULL"), universe).select("panel_id", "ticker").distinct()
    return universe.join(have, ["panel_id", "ticker"], "left_anti").select("panel_id", "ticker")
