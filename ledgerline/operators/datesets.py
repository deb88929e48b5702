"""Sets of dates as bitmaps: one row of 4 KB holds a panel's dates of some ninety years, so that panels are aligned without a
shuffle of their rows or of the distinct pairs of panel and date.

Each task folds the dates that it reads into bitmaps before anything is shuffled; sets meet by AND, and are counted without being
unfolded. A set of a date type far from 1970 has more rows, one for each 32,768 days. A NULL date is in no set; NULL keys are a key like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.staging import written

#: Bitmaps (of 4 KB) that are broadcast at most, 64 MB; beyond them the dates are unfolded and shuffled.
BROADCAST_BITMAPS = 16_384
#: Bits of a bitmap, and what the columns of a set are called.
BITS, BUCKET, BITMAP = 32_768, "days_bucket", "days_bitmap"


def day(date: Column) -> Column:
    return F.unix_date(date.cast("date")).cast("bigint")


def of(rows: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """The set of dates of each key: keys, days_bucket, days_bitmap."""
    known = rows.where(F.col(date).isNotNull()).select(*keys, day(F.col(date)).alias("day"))
    at = known.withColumn(BUCKET, F.bitmap_bucket_number("day"))
    return at.groupBy(*keys, BUCKET).agg(F.bitmap_construct_agg(F.bitmap_bit_position("day")).alias(BITMAP))


def common(sets: DataFrame, keys: list[str], n_sets: int) -> DataFrame:
    """The dates in all of ``n_sets`` sets of each key, which are as many rows of a key and bucket."""
    met = sets.groupBy(*keys, BUCKET).agg(F.bitmap_and_agg(BITMAP).alias(BITMAP), F.count(F.lit(1)).alias("n_sets"))
    return met.where((F.col("n_sets") == n_sets) & (F.bitmap_count(BITMAP) > 0)).drop("n_sets")


def sizes(sets: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The number of dates of each key that has any."""
    return sets.groupBy(*keys).agg(F.sum(F.bitmap_count(BITMAP)).alias(name))


def holds(bitmap: Column, date: Column) -> Column:
    """Whether a date's bit is set; the bitmap has to be of the date's bucket."""
    at = F.bitmap_bit_position(day(date))
    byte = F.conv(F.hex(F.substr(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def unfolded(sets: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """A row for each date of each set."""
    # Bits of bucket 1 on stand for days from 1 on, those of bucket 0 and below for 0 and the days before it.
    bit, bucket = F.col("bit"), F.col(BUCKET)
    number = F.when(bucket > 0, (bucket - 1) * BITS + bit + 1).otherwise(bucket * BITS - bit)
    rows = sets.select(*keys, BUCKET, BITMAP, F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit"))
    rows = rows.select(*keys, F.date_from_unix_date(number.cast("int")).alias(date), BITMAP)
    return rows.where(holds(F.col(BITMAP), F.col(date))).drop(BITMAP)


def at_dates(rows: DataFrame, sets: DataFrame, keys: list[str], date: str = "date", most: int = BROADCAST_BITMAPS) -> DataFrame:
    """The rows whose date is in their key's set (a written table). Up to ``most`` bitmaps are broadcast, so that the rows stay where they
    are; beyond that the rows are shuffled by key and date, as by key alone a panel would be one task."""
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    r, mine = rows.alias("r"), F.col(f"r.{date}")
    if sets.count() <= most:
        near = (F.bitmap_bucket_number(day(mine)) == F.col(f"s.{BUCKET}")) & holds(F.col(f"s.{BITMAP}"), mine)
        return r.join(F.broadcast(sets).alias("s"), same("r", "s") & near, "left_semi")
    return r.join(unfolded(sets, keys, date).alias("s"), same("r", "s") & (mine.cast("date") == F.col(f"s.{date}")), "left_semi")


def shared(left: DataFrame, right: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """The dates that both sides have, by key; written, as both sides are cut by it."""
    return written(common(of(left, keys, date).unionByName(of(right, keys, date)), keys, 2), "dateset")
