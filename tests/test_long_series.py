"""Scans, selections and states: what the plain windows and a recount give, without one task for a series."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import measures as M
from ledgerline.operators import quantiles, scans, series, states

DAY = dt.date(2000, 1, 1)
SCHEMA = "k string, date date, ret double, other double"


def walks(seed: int, lengths: dict, steps=(-0.02, -0.01, 0.0, 0.01, 0.015)) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(k, DAY + dt.timedelta(i), None if rng.random() < 0.03 else rng.choice(steps), rng.choice([None, -0.01, 0.0, 0.01, 0.02])) for k, n in lengths.items() for i in range(n)]
    rng.shuffle(rows)
    return rows


def rows_of(df, digits=9) -> list[tuple]:
    fix = lambda x: round(x, digits) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(fix(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed, chunks", [(1, 1), (2, 7), (3, 60)])
def test_scans_are_the_windows(spark, seed, chunks):
    """Series of one row, of many chunks, without a name, and with losses of everything and more."""
    rows = walks(seed, {"long": 300, "one": 1, None: 80, "flat": 0}) + [("flat", DAY + dt.timedelta(i), 0.0, None) for i in range(30)]
    rows += [("lost", DAY + dt.timedelta(i), r, None) for i, r in enumerate([0.1, -0.2, 0.3, -1.0, 0.1, 0.2])]
    rows += [("beyond", DAY + dt.timedelta(i), r, None) for i, r in enumerate([0.1, -1.5, 0.3, -1.2, 0.1, -2.0, 0.4])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"place": F.lit(-1), "extra": F.lit("x")})
    got = scans.with_drawdown(frame, ["k"], ["date"], chunks)
    want = series.with_drawdown(frame, ["k"])
    columns = ["k", "date", "ret", "curve", "drawdown", "extra"]
    assert rows_of(got.select(*columns)) == rows_of(want.select(*columns))
    if chunks > 1:
        assert got.where("k = 'long'").select("chunk").distinct().count() > 1
    places = [(r["date"] - DAY).days + 1 - r["place"] for r in got.collect()]
    assert set(places) == {0}
    usual = frame.where("k NOT IN ('lost', 'beyond') OR k IS NULL")
    assert rows_of(scans.episodes(scans.with_drawdown(usual, ["k"], ["date"], chunks), ["k"])) == rows_of(series.episodes(usual, ["k"]))


@pytest.mark.parametrize("days", [1, 7, 400])
def test_rolling_over_chunks(spark, days):
    frame = spark.createDataFrame(walks(5, {"a": 230, None: 60, "b": 3}), SCHEMA)
    scanned = scans.with_drawdown(frame, ["k"], ["date"], 9)
    columns = ["k", "date", "rolling_sharpe"]
    got = scans.rolling_sharpe(scanned, ["k"], F.lit(0.02), days).select(*columns)
    assert rows_of(got) == rows_of(series.rolling_sharpe(frame, ["k"], F.lit(0.02), days).select(*columns))


def test_scans_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    rows = scans.with_drawdown(none, ["k"], ["date"], 3)
    assert rows.count() == 0 and scans.episodes(rows, ["k"]).count() == 0
    assert quantiles.exact(none, ["k"], "ret", [0.5]).count() == 0
    assert states.measures(states.of_returns(none, ["k"], F.lit(0.0)), ["k"], F.lit(0.0)).count() == 0


@pytest.mark.parametrize("cells, few, broadcast", [(8, 4, True), (4096, 0, False)])
def test_quantiles_are_exact(spark, monkeypatch, cells, few, broadcast):
    """Ties, wide ranges, the least doubles there are, infinities, few cells, one value and none."""
    monkeypatch.setattr(quantiles, "CELLS", cells)
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BROADCAST_RANKS", 100_000 if broadcast else 0)
    rng = random.Random(7)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(700)], "ties": [1.0] * 300 + [0.0, -0.0, 2.0, 2.0], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-8, 8) for _ in range(200)],
        "tiny": [5e-324 * rng.randint(0, 4) for _ in range(50)], "ends": [math.inf, -math.inf, 1.0, 2.0, 3.0, math.inf], "single": [4.25], "extreme": [-1.7e308, 1.7e308, 1.0, 1.5],
        None: [float(i) for i in range(11)], "missing": [None, math.nan], "some": [None, math.nan, 3.0, 1.0],
    }
    frame = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    shares = [0.0, 1 / 3, 0.95, 1.0]
    got = {(r["k"], r["share"]): (r["n"], r["quantile"]) for r in quantiles.exact(frame, ["k"], "v", shares).collect()}
    want = {}
    for k, vs in groups.items():
        kept = sorted(v for v in vs if v is not None and not math.isnan(v))
        for q in shares:
            if kept:
                at = (len(kept) - 1) * q
                lo, hi = kept[math.floor(at)], kept[math.ceil(at)]
                want[k, q] = (len(kept), lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi)
    assert got.keys() == want.keys()
    for key, (n, value) in want.items():
        assert got[key][0] == n and (got[key][1] == value or math.isnan(value)), key


def test_tails_are_those_of_the_measures(spark):
    frame = spark.createDataFrame(walks(11, {"a": 400, "b": 2, None: 40}), SCHEMA)
    short = series.measure_table(frame, ["k"], F.lit(0.0)).select("k", "var_95", "cvar_95")
    long = quantiles.tail_measures(frame, ["k"], [M.CONFIDENCE]).select("k", F.col("value_at_risk").alias("var_95"), F.col("expected_shortfall").alias("cvar_95"))
    assert rows_of(long) == rows_of(short)


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_states_are_the_recount(spark, seed):
    """Series cut at random days, some of them in a part of the batches only, some with a loss of everything."""
    rng = random.Random(seed)
    rows = walks(seed, {"a": 200, "b": 90, None: 40, "c": 1, "late": 0}) + [("late", DAY + dt.timedelta(150 + i), rng.gauss(0, 0.01), 0.001 * i) for i in range(40)]
    rows += [("lost", DAY + dt.timedelta(i), r, 0.01) for i, r in enumerate([0.1, -0.2, 0.3, -1.0, 0.1, 0.2])] + [("still", DAY + dt.timedelta(i), 0.0, 0.0) for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    cuts = sorted(rng.sample(range(1, 200), 2))
    stored = None
    for low, high in zip([0, *cuts], [*cuts, 1000], strict=True):
        batch = frame.where(F.datediff("date", F.lit(DAY)).between(low, high - 1))
        state = states.of_returns(batch, ["k"], F.lit(0.03))
        stored = state if stored is None else states.merged(stored, state, ["k"])
    want = series.measure_table(frame, ["k"], F.lit(0.03)).select("k", *states.MEASURES)
    assert rows_of(states.measures(stored, ["k"], F.lit(0.03)), 8) == rows_of(want, 8)
