"""Stored prices: corrections merged by ticker and day, in versions that readers see whole or not at all.

A store is a folder with ``data`` (a folder of parquet files for each write and year) and ``versions`` (a small JSON
file for each version: the folder of every year). An upsert reads the years that its rows touch, writes them merged into
new folders, and then makes the version by renaming one file into place; a name that is there already means that another
writer came first, and the upsert starts again from that version. A job that dies before the rename has changed nothing.
Readers stay on the version they opened, as no folder is ever written twice.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import schemas

#: Tasks that write one year, each a bucket of tickers.
WRITERS_PER_YEAR = 16
#: Times that an upsert starts again because another was faster.
ATTEMPTS = 5


@dataclass(frozen=True)
class Version:
    """Version ``number`` of a store (0: nothing stored): the folders of each year, relative to the store."""

    number: int
    years: dict[int, str]


class Files:
    """Files of a store, wherever Spark's file systems reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        files = at.getFileSystem(self.conf)
        return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []

    def text(self, name: str) -> str:
        at = self.path(name)
        stream = at.getFileSystem(self.conf).open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A file with the whole text, or False if there is one of its name. Never overwrites."""
        draft, at = self.path(f"drafts/{uuid.uuid4().hex}"), self.path(name)
        files = at.getFileSystem(self.conf)
        out = files.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        files.mkdirs(at.getParent())
        fs = self.jvm.org.apache.hadoop.fs
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(files.getUri(), self.conf).rename(files.makeQualified(draft), files.makeQualified(at), options)
            return True
        except Exception as error:  # Py4J has one type for all of Java's
            if not files.exists(at) or "FileAlreadyExists" not in str(error):
                raise
            files.delete(draft, False)
            return False

    def delete(self, name: str) -> None:
        at = self.path(name)
        at.getFileSystem(self.conf).delete(at, True)


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The given version of a store, or its last."""
    files = Files(spark, path)
    there = [int(n.split(".")[0]) for n in files.names("versions") if n.endswith(".json") and not n.startswith(".")]
    if number is None:
        number = max(there, default=0)
    if number == 0:
        return Version(0, {})
    if number not in there:
        raise ValueError(f"no version {number} in {path}")
    return Version(number, {int(y): folder for y, folder in json.loads(files.text(f"versions/{number:012d}.json")).items()})


def rows_of(spark: SparkSession, path: str, at: Version, years: list[int]) -> DataFrame:
    folders = [f"{path}/{at.years[y]}" for y in years if y in at.years]
    reader = spark.read.schema(schemas.PRICES)
    return reader.parquet(*folders) if folders else spark.createDataFrame([], schemas.PRICES)


def upsert(changes: DataFrame, path: str, writers: int = WRITERS_PER_YEAR) -> int:
    """Merge ``changes`` (ticker, date, close) into the store by ticker and date, all other rows as they are, and return the
    version made. A NULL close is stored as a missing price; of several rows of a day the highest close counts; rows
    without ticker or date are left out. Only the years of the changes are written, each by up to ``writers`` tasks."""
    spark = changes.sparkSession
    key = ["ticker", "date"]
    days = changes.where("ticker IS NOT NULL AND date IS NOT NULL").groupBy(*key).agg(F.max("close").alias("close")).select("ticker", "date", "close")
    touched = sorted(r[0] for r in days.select(F.year("date").alias("year")).distinct().collect())  # a row a year
    for _ in range(ATTEMPTS):
        base = version(spark, path)
        if not touched:
            return base.number
        old = rows_of(spark, path, base, touched)
        merged = old.join(days, key, "left_anti").unionByName(days).withColumn("year", F.year("date"))
        name = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64("ticker"), F.lit(writers))
        merged.repartition("year", bucket).sortWithinPartitions("year", "ticker", "date").write.partitionBy("year").parquet(f"{path}/data/{name}")
        years = base.years | {y: f"data/{name}/year={y}" for y in touched}
        if Files(spark, path).create(f"versions/{base.number + 1:012d}.json", json.dumps(years, sort_keys=True)):
            return base.number + 1
    raise PySparkException(f"{path}: other writers were faster {ATTEMPTS} times")


def read_prices(spark: SparkSession, path: str, start: dt.date, end: dt.date, number: int | None = None) -> DataFrame:
    """Stored prices from ``start`` to ``end``, both included, of the last version or the given one; only the years needed are read."""
    at = version(spark, path, number)
    years = [y for y in sorted(at.years) if start.year <= y <= end.year]
    return rows_of(spark, path, at, years).where(F.col("date").between(F.lit(start), F.lit(end))).select("ticker", "date", "close")


def remove_unused(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all versions but the last ``keep``, and what no version left uses: for times without writers or readers of older versions."""
    files, last = Files(spark, path), version(spark, path).number
    kept = [version(spark, path, n) for n in range(max(1, last - keep + 1), last + 1)]
    for name in files.names("versions"):
        if name.endswith(".json") and not name.startswith(".") and int(name.split(".")[0]) < last - keep + 1:
            files.delete(f"versions/{name}")
    used = {folder for v in kept for folder in v.years.values()}
    for write in files.names("data"):
        if not any(folder.startswith(f"data/{write}/") for folder in used):
            files.delete(f"data/{write}")
    files.delete("drafts")
