"""Files that can't be read cost their own rows only and are named."""

import pathlib

import pytest

from ledgerline import schemas
from ledgerline.sources import files
from ledgerline.sources import prices as P


@pytest.fixture()
def folder(spark, tmp_path):
    """Files of 3,000 prices each, as a download would leave them: a ticker a file."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    import datetime as dt

    days = [dt.date(2000, 1, 1) + dt.timedelta(i) for i in range(3000)]
    for t in "ABCDEF":
        (tmp_path / t).mkdir()
        closes = [100 + (hash((t, i)) % 1000) / 7 for i in range(3000)]
        pq.write_table(pa.table({"ticker": [t] * 3000, "date": days, "close": closes}), tmp_path / t / f"{t}.parquet", row_group_size=500, use_dictionary=False, compression="snappy")
    pq.write_table(pa.table({"name": ["x", "y"], "n": [1, 2]}), tmp_path / "other.parquet")
    return tmp_path


def damage(path: pathlib.Path, at: int, n: int) -> None:
    data = bytearray(path.read_bytes())
    data[at : at + n] = bytes([255]) * n
    path.write_bytes(bytes(data))


def test_unreadable_files(spark, folder):
    (folder / "B" / "B.parquet").write_bytes((folder / "B" / "B.parquet").read_bytes()[:9000])  # truncated
    (folder / "C" / "C.parquet").write_bytes(b"")  # no bytes: nothing to name
    size = (folder / "D" / "D.parquet").stat().st_size
    damage(folder / "D" / "D.parquet", size // 2, 2000)  # some row group in the middle; its footer is whole
    (folder / "E" / "E.parquet").write_bytes(b"no parquet at all, but long enough for one")
    (folder / "notes.txt").write_text("not asked for")
    prices, bad = files.checked(spark, str(folder))
    assert {(r["file"].rsplit("/", 1)[1], r["reason"]) for r in bad.collect()} == {
        ("B.parquet", "unreadable"), ("D.parquet", "damaged"), ("E.parquet", "unreadable"), ("other.parquet", "no prices"),
    }
    assert {(r["ticker"], r["count"]) for r in prices.groupBy("ticker").count().collect()} == {("A", 3000), ("F", 3000)}
    universe = spark.createDataFrame([("P", t) for t in "ABCDF"], "panel_id string, ticker string").selectExpr("*", "DATE'2000-01-01' AS start", "DATE'2009-01-01' AS end")
    assert {r["ticker"] for r in P.missing_tickers(prices, universe).collect()} == {"B", "C", "D"}


def test_sound_files(spark, folder):
    (folder / "other.parquet").unlink()
    prices, bad = files.checked(spark, str(folder))
    assert bad.count() == 0 and prices.count() == 18_000 and prices.schema.simpleString() == spark.createDataFrame([], schemas.PRICES).schema.simpleString()
