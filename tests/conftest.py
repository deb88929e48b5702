import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from ledgerline.sources.staging import clean_up

    clean_up(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def same_rows(df, relation) -> None:
    """The rows of a Spark and a DuckDB result, in any order."""
    columns = sorted(df.columns)
    names = [c[0] for c in relation.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    key = lambda row: tuple((x is None, str(round(x, 6)) if isinstance(x, float) else str(x)) for x in row)
    ours = sorted(key([r[c] for c in columns]) for r in df.collect())
    theirs = sorted(key([r[i] for i in place]) for r in relation.fetchall())
    assert ours == theirs
