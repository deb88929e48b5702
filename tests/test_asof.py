"""The as-of join against a loop."""

import datetime as dt
import random

import pytest

from ledgerline.operators import asof


@pytest.mark.parametrize("seed, chunks", [(1, 1), (2, 8), (3, 40)])
def test_last_quote_at_or_before(spark, seed, chunks):
    """Ties, rows before the first quote, repeated rows, a hot key and a hot moment, NULL keys and moments, clashing names."""
    rng = random.Random(seed)
    moment = lambda: None if rng.random() < 0.05 else dt.datetime(2020, 1, 1) + dt.timedelta(minutes=rng.choice([50, rng.randint(0, 90)]))
    key = lambda: rng.choice(["hot", "hot", "hot", "b", "never", None])
    quotes = [(k, moment(), i, rng.choice([None, 1.5, 2.5])) for i in range(120) if (k := key()) != "never"]
    asked = [(key(), moment(), i % 150, "old") for i in range(200)]
    asked += asked[:20]
    left = spark.createDataFrame(asked, "k string, t timestamp_ntz, n long, quote string")
    right = spark.createDataFrame(quotes, "k string, t timestamp_ntz, n long, close double")
    got = sorted(str((r["k"], r["t"], r["n"], r["quote"] and tuple(r["quote"]))) for r in asof.asof(left, right, ["k"], "t", ["n"], chunks).collect())
    want = []
    for k, t, n, _ in asked:
        before = [q for q in quotes if k is not None and t is not None and q[0] == k and q[1] is not None and q[1] <= t]
        best = max(before, key=lambda q: (q[1], q[2]), default=None)
        want.append(str((k, t, n, best and (best[1], best[2], best[3]))))
    assert got == sorted(want)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "k string, t date, n long")
    some = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1)], "k string, t date, n long")
    assert asof.asof(none, some, ["k"], "t").count() == 0
    assert [r["quote"] for r in asof.asof(some, none, ["k"], "t").collect()] == [None]
