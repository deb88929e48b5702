"""Price files of which some can't be read: the sound ones' rows, and the others by name.

A file counts as a whole or not at all. Its footer says how many rows it has, and reading them says how many there are: a file
that has lost its footer, or a page on the way, is unreadable, and none of its rows is used. So is one without the columns asked
for, or with them in other types. Both counts are Spark jobs over all files, the first of footers only. What the loss means for a universe is
rows as well, by ``prices.missing_tickers`` on the rows that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.sources.staging import written

#: As SQL, for a column can only be made once there is a session.
FILE = "_metadata.file_path AS file"


def listed(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """file and n_bytes of every file below ``path``; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.selectExpr(FILE, "length AS n_bytes")


def readable(spark: SparkSession, path: str, pattern: str, schema: str = schemas.PRICES) -> DataFrame:
    """The rows that can be read, with their file; what follows a damage in a file is left out."""
    options = {"ignoreCorruptFiles": True, "pathGlobFilter": pattern, "recursiveFileLookup": True}
    return spark.read.options(**options).schema(schema).parquet(path)


def checked(spark: SparkSession, path: str, pattern: str = "*.parquet") -> tuple[DataFrame, DataFrame]:
    """Prices (ticker, date, close) of the sound files below ``path``, and file, n_bytes and reason of all others: "unreadable", "damaged"
    (rows that the footer names are missing), "no prices" (not one row has both a ticker and a date, as in a file of other columns). The
    readable rows are written once. Spark passes over files of no bytes: they hold nothing and are not named, their tickers are missing."""
    rows = readable(spark, path, pattern)
    claimed = rows.selectExpr(FILE).groupBy("file").agg(F.count(F.lit(1)).alias("claimed"))  # asks for no column, so it reads footers
    found = written(rows.selectExpr(FILE, "ticker", "date", "close"), "prices")
    seen = found.groupBy("file").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("ticker").isNotNull() & F.col("date").isNotNull()).alias("priced"))
    facts = listed(spark, path, pattern).join(claimed, "file", "left").join(seen, "file", "left").na.fill(0, ["claimed", "seen", "priced"])
    reason = F.when(F.col("claimed") == 0, F.lit("unreadable")).when(F.col("seen") < F.col("claimed"), "damaged").when(F.col("priced") == 0, "no prices")
    facts = written(facts.select("file", "n_bytes", reason.alias("reason")), "files")
    bad = facts.where("reason IS NOT NULL")
    return found.join(bad, "file", "left_anti").select("ticker", "date", "close"), bad
