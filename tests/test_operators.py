"""Hand-derived cases, a day-by-day loop, and invariants."""

import datetime as dt
import json
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.functions import measures as M
from ledgerline.operators import calendar, clean, guard, moments, resample, series, specs, valuation, weights
from ledgerline.sources import prices as P
from ledgerline.sources import store


def b_days(start: str, n: int) -> list[dt.date]:
    day, out = dt.date.fromisoformat(start), []
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(1)
    return out


def panel_frame(spark, columns: dict[str, list], days, panel_id="P"):
    rows = [(panel_id, t, d, None if v is None else float(v)) for t, values in columns.items() for d, v in zip(days, values, strict=True)]
    return spark.createDataFrame(rows, "panel_id string, ticker string, date date, close double")


def spec(spark, *rows, tickers=("A", "B")):
    base = dict(run_id="r", panel_id="P", tickers=list(tickers), benchmark="BM", start=dt.date(2020, 1, 1), end=dt.date(2020, 2, 28), initial_capital=100_000.0, weighting="equal", rebalance="monthly", risk_free_rate=0.0, transaction_cost_bps=10.0, custom_weights=None, lookback_days=None)
    names = [f.split()[0] for f in schemas.RUN_SPEC.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in (rows or ({},))], schemas.RUN_SPEC)


@pytest.fixture(scope="module")
def toy(spark):
    days = [d for d in b_days("2020-01-01", 60) if d <= dt.date(2020, 2, 28)]
    a = [100 if d < dt.date(2020, 1, 31) else 200 for d in days]
    return panel_frame(spark, {"A": a, "B": [100] * len(days)}, days), panel_frame(spark, {"BM": [50] * len(days)}, days)


def test_toy_portfolio(spark, toy):
    rows = {r["date"]: r for r in valuation.nav_daily(spec(spark), *toy).collect()}
    first, trade = rows[dt.date(2020, 1, 1)], rows[dt.date(2020, 1, 31)]
    assert (first["portfolio_value"], first["portfolio_return"], first["turnover"]) == (pytest.approx(99_900), 0, 1)
    assert first["costs_paid"] == pytest.approx(100)
    assert trade["turnover"] == pytest.approx(1 / 6) and trade["costs_paid"] == pytest.approx(24.975) and trade["portfolio_value"] == pytest.approx(149_850 - 24.975)
    assert [d for d, r in sorted(rows.items()) if r["turnover"] > 0] == [dt.date(2020, 1, 1), dt.date(2020, 1, 31)]
    assert {r["benchmark_value"] for r in rows.values()} == {100_000.0}
    none = valuation.nav_daily(spec(spark, {"rebalance": "none"}), *toy)
    assert none.agg(F.sum("costs_paid")).first()[0] == pytest.approx(100)


def by_loop(prices, days, scheme, every, cost, lookback, custom, capital=100_000.0):
    """Values day by day; prices: ticker -> list."""
    tickers, rets = sorted(prices), {t: [None] + [b / a - 1 for a, b in zip(p, p[1:])] for t, p in prices.items()}

    def target(i):
        if scheme == "equal":
            return {t: 1 / len(tickers) for t in tickers}
        if scheme == "custom":
            return {t: w / sum(custom) for t, w in zip(tickers, custom, strict=True)}
        inverse = {}
        for t in tickers:
            x = [r for r in rets[t][i - lookback + 1 : i + 1] if r is not None]
            m = sum(x) / len(x)
            s = math.sqrt(sum((v - m) ** 2 for v in x) / (len(x) - 1))
            inverse[t] = 1 / s if s > 0 else 0.0
        return {t: v / sum(inverse.values()) for t, v in inverse.items()}

    entry = lookback if scheme == "inverse_vol" else 0
    last = {}
    for d in days[entry:]:
        last[(d.year, d.month) if every == "monthly" else (d.year, (d.month - 1) // 3)] = d
    scheduled = {d for d in last.values() if days[entry] < d < days[-1]}
    value = capital * (1 - cost)
    shares = {t: value * w / prices[t][entry] for t, w in target(entry).items()}
    out = [(days[entry], value, 1.0)]
    for i in range(entry + 1, len(days)):
        value, turnover = sum(shares[t] * prices[t][i] for t in tickers), 0.0
        if days[i] in scheduled:
            w = target(i)
            turnover = 0.5 * sum(abs(w[t] - shares[t] * prices[t][i] / value) for t in tickers)
            value -= value * turnover * cost
            shares = {t: value * w[t] / prices[t][i] for t in tickers}
        out.append((days[i], value, turnover))
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_closed_form_is_the_day_loop(spark, partitions):
    rng = random.Random(3)
    days = b_days("2019-01-01", 300)
    prices = {t: [100.0] for t in "ABC"}
    for p, sd in zip(prices.values(), (0.01, 0.02, 0.005), strict=True):
        while len(p) < len(days):
            p.append(p[-1] * (1 + rng.gauss(0, sd)))
    runs = spec(
        spark, {"run_id": "equal", "rebalance": "quarterly"}, {"run_id": "custom", "weighting": "custom", "custom_weights": [0.5, 0.3, 0.2]},
        {"run_id": "inverse_vol", "weighting": "inverse_vol", "lookback_days": 21}, tickers="ABC",
    )
    panel, other = panel_frame(spark, prices, days).repartition(partitions), panel_frame(spark, {"BM": [50 + i for i in range(300)]}, days)
    got = {(r["run_id"], r["date"]): r for r in valuation.nav_daily(runs, panel, other).collect()}
    n = 0
    for run, every, lookback, custom in (("equal", "quarterly", 0, None), ("custom", "monthly", 0, [0.5, 0.3, 0.2]), ("inverse_vol", "monthly", 21, None)):
        for day, value, turnover in by_loop(prices, days, run, every, 0.001, lookback, custom):
            r = got[run, day]
            assert r["portfolio_value"] == pytest.approx(value, rel=1e-12) and r["turnover"] == pytest.approx(turnover, abs=1e-12)
            n += 1
    assert n == len(got) and min(d for run, d in got if run == "inverse_vol") == days[21]


def test_calendar(spark):
    days = [d for d in b_days("2019-01-01", 800) if d <= dt.date(2021, 6, 30)]
    df = spark.createDataFrame([("c", f, d) for f in ("monthly", "quarterly", "annual", "none") for d in days], "calendar_id string, frequency string, date date")
    got = {}
    for r in calendar.rebalance_dates(df, ["calendar_id"]).collect():
        got.setdefault(r["frequency"], set()).add(r["rebalance_date"])
    assert dt.date(2020, 5, 29) in got["monthly"] and dt.date(2020, 5, 31) not in got["monthly"]
    assert {dt.date(2019, 3, 29), dt.date(2019, 6, 28)} <= got["quarterly"]
    assert got["annual"] == {dt.date(2019, 12, 31), dt.date(2020, 12, 31)} and "none" not in got
    short = [d for d in days if dt.date(2020, 1, 31) <= d <= dt.date(2020, 3, 31)]
    one = spark.createDataFrame([("c", "monthly", d) for d in short], "calendar_id string, frequency string, date date")
    assert [r["rebalance_date"] for r in calendar.rebalance_dates(one, ["calendar_id"]).collect()] == [dt.date(2020, 2, 28)]


def returns_frame(spark, **named):
    rows = [(k, d, None if v is None else float(v), float(o)) for k, (ret, other) in named.items() for d, v, o in zip(b_days("2020-01-01", len(ret)), ret, other, strict=True)]
    return spark.createDataFrame(rows, "id string, date date, ret double, other double")


def test_measures_by_hand(spark):
    rng = random.Random(5)
    bench = [rng.gauss(0.0004, 0.011) for _ in range(300)]
    rf = (1.02) ** (1 / 252) - 1
    cases = {
        "const": [0.0005] * 252, "vol5": [0.01, -0.02, 0.03, -0.01, 0.005], "dd3": [0.10, -0.20, 0.05], "tail20": [x / 100 for x in range(-10, 10)],
        "sortino4": [0.02, -0.01, 0.02, -0.01], "up3": [0.01, 0.02, 0.03], "one": [0.01], "down1": [-0.01], "down2": [-0.01, -0.01], "none": [None, None],
    }
    named = {k: (v, bench[: len(v)]) for k, v in cases.items()}
    named["ols"] = ([rf + 0.0002 + 1.3 * (b - rf) for b in bench], bench)
    named["self"] = (bench, bench)
    named["alt"] = ([b + (0.001 if i % 2 else -0.001) for i, b in enumerate(bench[:100])], bench[:100])
    named["flat"] = (bench, [0.01] * 300)
    got = {r["id"]: r for r in series.measure_table(returns_frame(spark, **named), ["id"], F.lit(0.02)).collect()}
    assert got["const"]["cagr"] == pytest.approx(1.0005**252 - 1) and got["const"]["volatility"] == 0 and got["const"]["sharpe"] is None
    m = sum(cases["vol5"]) / 5
    assert got["vol5"]["volatility"] == pytest.approx(math.sqrt(sum((x - m) ** 2 for x in cases["vol5"]) / 4 * 252))
    assert got["dd3"]["max_drawdown"] == pytest.approx(-0.2) and got["dd3"]["calmar"] == pytest.approx(got["dd3"]["cagr"] / 0.2)
    assert got["tail20"]["var_95"] == pytest.approx(0.0905) and got["tail20"]["cvar_95"] == pytest.approx(0.10)
    e = [x - rf for x in cases["sortino4"]]
    assert got["sortino4"]["sortino"] == pytest.approx(sum(e) / 4 * 252 / (math.sqrt(sum(min(x, 0) ** 2 for x in e) / 4) * math.sqrt(252)))
    assert got["down1"]["sortino"] is None and got["down2"]["sortino"] is not None
    assert got["up3"]["sortino"] is None and got["one"]["volatility"] is None and got["none"]["cagr"] == 0
    assert got["ols"]["beta"] == pytest.approx(1.3) and got["ols"]["alpha"] == pytest.approx(0.0002 * 252) and got["ols"]["r_squared"] == pytest.approx(1)
    assert got["self"]["beta"] == pytest.approx(1) and got["self"]["alpha"] == pytest.approx(0, abs=1e-12) and got["self"]["tracking_error"] == 0 and got["self"]["correlation"] == pytest.approx(1)
    assert got["self"]["information_ratio"] is None
    assert got["alt"]["tracking_error"] == pytest.approx(0.001 * math.sqrt(100 / 99) * math.sqrt(252)) and got["alt"]["information_ratio"] == pytest.approx(0, abs=1e-9)
    assert all(got["flat"][c] is None for c in ("beta", "alpha", "correlation", "r_squared"))


def test_episodes(spark):
    df = returns_frame(spark, ep5=([0, -0.1, -0.1, 0.15, 0.1], [0] * 5), ep3=([0, -0.1, 0.01], [0] * 3), up=([0.1, 0.1], [0] * 2), first=([-0.5, 0.1], [0] * 2))
    got = {r["id"]: r for r in series.episodes(df, ["id"]).collect()}
    d = b_days("2020-01-01", 5)
    assert set(got) == {"ep5", "ep3"}
    r = got["ep5"]
    assert (r["peak"], r["trough"], r["recovery"], r["days_to_recover"]) == (d[0], d[2], d[4], 3)
    assert r["depth"] == pytest.approx(-0.19) and got["ep3"]["recovery"] is None and got["ep3"]["days_to_recover"] is None


def test_rolling_and_months(spark):
    df = returns_frame(spark, x=([0.01, -0.01, 0.02, 0.0] * 80, [0] * 320))
    rows = sorted(series.rolling_sharpe(df, ["id"], F.lit(0.0), days=252).collect(), key=lambda r: r["date"])
    assert all(r["rolling_sharpe"] is None for r in rows[:251]) and rows[251]["rolling_sharpe"] is not None
    grid = {r["year"]: r for r in series.monthly_grid(df, ["id"]).collect()}
    jan = [r["ret"] for r in rows if (r["date"].year, r["date"].month) == (2020, 1)]
    assert grid[2020]["m1"] == pytest.approx(math.prod(1 + x for x in jan) - 1) and grid[2021]["m12"] is None


def test_trailing_moments(spark):
    rng = random.Random(9)
    wild = lambda i: 1e6 if i % 97 == 5 else 0.25 if 100 <= i < 150 else None if i % 41 == 7 else rng.gauss(1e-4, 1e-2)
    values = {k: [wild(i) for i in range(n)] for k, n in (("a", 400), ("b", 30), ("c", 1))}
    rows = spark.createDataFrame([(k, i + 1, v) for k, vs in values.items() for i, v in enumerate(vs)], "id string, place int, x double").repartition(3)

    def want(k, place, length):
        x = [v for v in values[k][max(0, place - length) : place] if v is not None]
        mean = sum(map(Fraction, x)) / len(x) if x else 0
        return len(x), mean, math.sqrt(sum((Fraction(v) - mean) ** 2 for v in x) / (len(x) - 1)) if len(x) > 1 else None

    def same(r, length):
        n, mean, sd = want(r["id"], r["place"], length)
        assert (r["n"] or 0) == n and (n == 0 or r["mean"] == pytest.approx(float(mean), rel=1e-12, abs=1e-15))
        assert r["sd"] is None if sd is None else r["sd"] == 0 if sd == 0 else r["sd"] == pytest.approx(sd, rel=1e-12)

    told = ["id", "place", "state.n", "state.mean", moments.deviation(F.col("state")).alias("sd")]
    for length in (1, 2, 7, 63):
        got = moments.trailing(rows, ["id"], F.col("x"), length).select(*told).collect()
        assert len(got) == 431
        for r in got:
            same(r, length)
    asked = [(k, length, p) for k, vs in values.items() for length in (2, 21, 50, 500) for p in rng.sample(range(1, len(vs) + 1), min(len(vs), 25))]
    got = moments.trailing_at(spark.createDataFrame(asked, "id string, length int, place int"), rows, ["id"], F.col("x")).select("length", *told).collect()
    assert sorted((r["id"], r["length"], r["place"]) for r in got) == sorted(asked)
    for r in got:
        same(r, r["length"])
    assert want("a", 150, 21)[2] == 0  # among them a window of equal values


def test_cleaning(spark):
    days = b_days("2020-01-01", 100)
    full = [10.0] * 100
    gap = lambda at, n: [None if at <= i < at + n else 10.0 for i in range(100)]
    panel = panel_frame(spark, {"FULL": full, "GAP5": gap(10, 5), "GAP6": gap(30, 6), "TEN": gap(50, 15), "MORE": gap(50, 16), "LEAD": gap(0, 3), "LATE": gap(0, 9), "NONE": [None] * 100}, days)
    share = {r["ticker"]: (round(r["missing_share"], 4), r["kept"]) for r in clean.ticker_shares(panel).collect()}
    assert share["GAP5"] == (0, True) and share["GAP6"] == (0.01, True) and share["TEN"] == (0.10, True) and share["MORE"] == (0.11, False) and share["NONE"] == (1, False)
    kept = {(r["ticker"], r["date"]) for r in clean.cleaned(panel).collect()}
    assert {t for t, _ in kept} == {"FULL", "GAP5", "GAP6", "TEN", "LEAD", "LATE"}
    assert {d for _, d in kept} == set(days) - set(days[:9]) - {days[35]} - set(days[55:65])
    start = spark.createDataFrame([("P", days[0])], "panel_id string, start date")
    late = {r["ticker"]: r["reason"] for r in clean.late_tickers(panel, start).collect()}
    assert late == {"LATE": "starts late", "NONE": "no prices"}
    facts = clean.panel_facts(panel).first()
    assert (facts["dates"], facts["tickers"], facts["tickers_kept"], facts["complete_dates"]) == (100, 8, 6, 80)


def cleaned_by_hand(rows, fill=clean.FILL_ROWS, limit=clean.MISSING_LIMIT):
    """The rows that cleaning keeps, from a full grid. ``rows``: panel, ticker, date, close."""
    out = {}
    for panel in {p for p, *_ in rows}:
        mine = [(t, d, c) for p, t, d, c in rows if p == panel]
        dates, tickers = sorted({d for _, d, _ in mine}), sorted({t for t, _, _ in mine})
        grid = {(t, d): None for t in tickers for d in dates} | {(t, d): c for t, d, c in mine}
        full = {}
        for t in tickers:
            last, age = None, 0
            for d in dates:
                if grid[t, d] is not None:
                    last, age = grid[t, d], 0
                else:
                    age += 1
                full[t, d] = last if age <= fill else None
        kept = [t for t in tickers if sum(full[t, d] is None for d in dates) / len(dates) <= limit]
        for d in dates if kept else []:
            if all(full[t, d] is not None for t in kept):
                out |= {(panel, t, d): full[t, d] for t in kept}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_are_the_grid(spark, seed):
    rng = random.Random(seed)
    rows = []
    for panel, n, tickers in (("P", 90, 6), ("Q", 40, 3), ("ONE", 1, 1), ("EMPTY", 5, 2)):
        days = b_days("2020-01-01", n)
        for t in range(tickers):
            hole = rng.choice([0.0, 0.02, 0.3])
            gap = rng.randrange(n)
            for i, d in enumerate(days):
                if gap <= i < gap + rng.choice([4, 6, 9]) or rng.random() < hole / 2:
                    continue
                rows.append((panel, f"T{t}", d, None if panel == "EMPTY" or rng.random() < hole else float(i + t)))
    frame = spark.createDataFrame(rows, "panel_id string, ticker string, date date, close double").repartition(5)
    got = {(r["panel_id"], r["ticker"], r["date"]): r["close"] for r in clean.cleaned(frame).collect()}
    assert got == cleaned_by_hand(rows) and len(got) == clean.cleaned(frame).count()
    holes = frame.withColumn("close", F.coalesce("close", F.lit(float("nan"))))
    assert {(r["panel_id"], r["ticker"], r["date"]): r["close"] for r in clean.cleaned(holes).collect()} == got


def test_rows_in_windows(spark):
    rng = random.Random(4)
    day = lambda k: dt.date(1969, 12, 1) + dt.timedelta(k)
    rows = [(rng.choice("AB"), day(rng.randrange(400)), i) for i in range(300)]
    asked = [(w, rng.choice("ABC"), day(lo), day(lo + n)) for w, (lo, n) in enumerate((rng.randrange(380), rng.choice([-2, 0, 1, 6, 7, 8, 31, 200, 4000])) for _ in range(60))]
    left = spark.createDataFrame(rows, "ticker string, date date, x int")
    right = spark.createDataFrame(asked, "w int, ticker string, start date, end date")
    got = sorted((r["w"], r["x"]) for r in P.in_windows(left, right, ["ticker"]).collect())
    assert got == sorted((w, x) for w, t, lo, hi in asked for u, d, x in rows if t == u and lo <= d <= hi)
    assert P.in_windows(left, right.where("false"), ["ticker"]).collect() == []


def test_each_run_has_its_own_universe_and_window(spark):
    rng = random.Random(8)
    days = b_days("2020-01-01", 400)
    prices = {t: [100.0] for t in "ABC"} | {"OTHER": [100.0]}
    for p in prices.values():
        while len(p) < len(days):
            p.append(p[-1] * (1 + rng.gauss(0, 0.01)))
    late = days.index(dt.date(2020, 6, 1))
    sparse = {t: [v if t != "C" or i >= late else None for i, v in enumerate(p)] for t, p in prices.items()}  # C would be late, or drop dates, elsewhere
    panel, bench = panel_frame(spark, sparse, days), panel_frame(spark, {"BM": [50 + i for i in range(400)], "B2": [1.0] * 400}, days)
    lo, hi = dt.date(2020, 6, 1), dt.date(2020, 9, 30)
    runs = spec(
        spark, {"run_id": "ab", "tickers": ["A", "B"], "end": days[-1]}, {"run_id": "ba", "tickers": ["B", "A"], "end": days[-1]}, {"run_id": "a", "tickers": ["A"], "end": days[-1]},
        {"run_id": "summer", "tickers": ["A", "B", "C"], "start": lo, "end": hi}, {"run_id": "c", "tickers": ["C"], "end": days[-1]}, {"run_id": "b2", "tickers": ["A"], "end": days[-1], "benchmark": "B2"},
        {"run_id": "custom", "tickers": ["C", "A"], "start": lo, "end": hi, "weighting": "custom", "custom_weights": [0.8, 0.2]},
    )
    checked = guard.checked(runs, panel, bench)
    assert {tuple(r) for r in checked.problems.collect()} == {("c", "ticker starts late", "C"), ("c", "no ticker left", "P")}
    got = {(r["run_id"], r["date"]): r for r in checked.nav_daily().collect()}
    for run, tickers, a, b, scheme, custom in (
        ("ab", "AB", days[0], days[-1], "equal", None), ("ba", "AB", days[0], days[-1], "equal", None), ("a", "A", days[0], days[-1], "equal", None), ("summer", "ABC", lo, hi, "equal", None), ("custom", "AC", lo, hi, "custom", [0.2, 0.8]),
    ):
        inside = [i for i, d in enumerate(days) if a <= d <= b]
        want = by_loop({t: [prices[t][i] for i in inside] for t in tickers}, [days[i] for i in inside], scheme, "monthly", 0.001, 0, custom)
        assert [d for r, d in sorted(got) if r == run] == [d for d, *_ in want]
        for day, value, turnover in want:
            assert got[run, day]["portfolio_value"] == pytest.approx(value, rel=1e-12) and got[run, day]["turnover"] == pytest.approx(turnover, abs=1e-12)
    assert got["b2", days[-1]]["benchmark_value"] == 100_000 and got["a", days[-1]]["benchmark_value"] == pytest.approx(100_000 * 449 / 50)
    windows = {r["run_id"]: r["panel_id"] for r in checked.runs.collect()}
    assert windows["ab"] == windows["ba"] and len(set(windows.values())) == 5


def test_what_the_guard_refuses(spark, toy):
    panel, other = toy
    day = F.col("date") == "2020-01-10"
    twice = panel.unionByName(panel.where(day & (F.col("ticker") == "A")).withColumn("close", F.lit(1.0)))
    runs = spec(
        spark, {"run_id": "good"}, {"run_id": "r"}, {"run_id": "r", "initial_capital": 5000.0}, {"run_id": None}, {"run_id": None, "initial_capital": 0.0}, {"run_id": "endless", "initial_capital": float("inf")},
        {"run_id": "nan", "risk_free_rate": float("nan")}, {"run_id": "b", "tickers": ["B"]}, {"run_id": "no days", "start": None}, {"run_id": "no tickers", "tickers": None},
    )
    checked = guard.checked(runs, panel, other)
    rules = {(r["run_id"], r["rule"]) for r in checked.problems.collect()}
    assert rules == {
        ("r", "run_id duplicated"), (None, "run_id missing"), (None, "initial_capital not positive"), ("endless", "initial_capital not finite"), ("nan", "risk_free_rate missing"),
        ("no days", "start not a date"), ("no tickers", "tickers missing"),
    }
    assert {r["run_id"] for r in checked.runs.collect()} == {r["run_id"] for r in checked.nav_daily().collect()} == {"good", "b"}
    for bad, rule in ((twice, "ticker with repeated days"), (panel.withColumn("close", F.when(day & (F.col("ticker") == "A"), float("inf")).otherwise(F.col("close"))), "ticker with infinite prices")):
        checked = guard.checked(runs, bad, other)
        assert ("good", rule, "A") in {tuple(r) for r in checked.problems.collect()} and {r["run_id"] for r in checked.nav_daily().collect()} == {"b"}
    hole = panel.withColumn("close", F.when(day, float("nan")).otherwise(F.col("close")))
    value = lambda c: {(r["run_id"], r["date"]): r["portfolio_value"] for r in c.nav_daily().collect()}
    assert value(guard.checked(runs, hole, other)) == value(guard.checked(runs, panel, other))  # carried on from the day before
    found = {r["rule"] for r in clean.panel_violations(twice.withColumn("close", F.when(day & (F.col("ticker") == "B"), float("inf")).when(F.col("date") == "2020-01-13", float("nan")).otherwise(F.col("close"))), other).collect()}
    assert found == {"repeated prices", "infinite prices", "missing prices"}


def test_panels_do_not_mix(spark):
    days = b_days("2020-01-01", 20)
    one, two = panel_frame(spark, {"A": [1.0] * 20}, days, "one"), panel_frame(spark, {"A": [1.0] * 5}, days[:5], "two")
    both = clean.cleaned(one.unionByName(two)).groupBy("panel_id").count().collect()
    assert {r["panel_id"]: r["count"] for r in both} == {"one": 20, "two": 5}


def test_panel_and_run_violations(spark, toy):
    panel, other = toy
    assert clean.panel_violations(panel, other).collect() == []
    bad = panel.withColumn("close", F.when(F.col("date") == "2020-01-10", None).otherwise(F.col("close")))
    short = other.where("date > '2020-01-07'")
    assert {r["rule"] for r in clean.panel_violations(bad, short).collect()} == {"missing prices", "dates differ from the benchmark"}
    runs = spec(spark, {"run_id": "c", "weighting": "custom", "tickers": ["A", "GONE"]}, {"run_id": "i", "weighting": "inverse_vol", "lookback_days": 42})
    assert {(r["run_id"], r["subject"]) for r in valuation.run_violations(runs, panel).collect()} == {("c", "GONE"), ("i", "43")}


def trades_of(spark, rows):
    return spark.createDataFrame(rows, "run_id string, panel_id string, rebalance_date date, weighting string, lookback_days int")


def test_weights(spark):
    days = b_days("2020-01-01", 41)
    grow = lambda step: [100 * math.prod(1 + (step if i % 2 else -step) for i in range(n)) for n in range(41)]
    panel = panel_frame(spark, {"A": grow(0.01), "B": grow(0.02), "FLAT": [100.0] * 41}, days)
    got = lambda p, day: {r["ticker"]: r["weight"] for r in weights.inverse_volatility_weights(trades_of(spark, [("r", "P", day, "inverse_vol", 20)]), p).collect()}
    w = got(panel, days[30])
    assert w["A"] == pytest.approx(2 / 3, rel=1e-3) and w["B"] == pytest.approx(1 / 3, rel=1e-3) and w["FLAT"] == 0
    later = panel.withColumn("close", F.when(F.col("date") > days[30], F.col("close") * 3).otherwise(F.col("close")))
    assert got(later, days[30]) == w
    now = panel.withColumn("close", F.when((F.col("date") == days[30]) & (F.col("ticker") == "A"), F.col("close") * 1.3).otherwise(F.col("close")))
    assert got(now, days[30])["A"] < w["A"]
    assert got(panel, days[0]) == {}
    runs = spec(spark, {"run_id": "r", "weighting": "custom", "custom_weights": [0.6, 0.2]})
    custom = weights.custom_weights(trades_of(spark, [("r", "P", days[0], "custom", None)]), runs)
    assert {r["ticker"]: r["weight"] for r in custom.collect()} == {"A": pytest.approx(0.75), "B": pytest.approx(0.25)}
    equal = weights.equal_weights(trades_of(spark, [("r", "P", days[0], "equal", None)]), panel)
    assert [r["weight"] for r in equal.collect()] == [pytest.approx(1 / 3)] * 3


def test_spec_rules(spark):
    names = [f.split()[0] for f in schemas.RUN_SPEC_RAW.split(", ")]
    good = dict(run_id="ok", panel_id="P", tickers=[" spy ", "agg"], benchmark=None, start="2020-01-01", end=" 2020-12-31", initial_capital=1.0, weighting=" Custom", rebalance="MONTHLY", risk_free_rate=0.0, transaction_cost_bps=0.0, custom_weights=[0.5, 0.5], lookback_days=None)
    cases = {
        "ok": {}, "tickers missing": {"tickers": []}, "tickers blank": {"tickers": ["A", " "]}, "tickers duplicated": {"tickers": ["a", "A "]}, "start not a date": {"start": "2020-13-01"},
        "start not before end": {"end": "2020-01-01"}, "initial_capital not positive": {"initial_capital": 0.0}, "transaction_cost_bps negative": {"transaction_cost_bps": -1.0},
        "risk_free_rate missing": {"risk_free_rate": None}, "weighting unknown": {"weighting": "cap"}, "rebalance unknown": {"rebalance": "weekly"}, "custom_weights missing": {"custom_weights": None},
        "custom_weights not one per ticker": {"custom_weights": [1.0]}, "custom_weights negative": {"custom_weights": [1.5, -0.5]}, "custom_weights do not sum to one": {"custom_weights": [0.5, 0.4]},
        "lookback_days missing": {"weighting": "inverse_vol"}, "lookback_days below two": {"weighting": "inverse_vol", "lookback_days": 1},
    }
    rows = [tuple((good | change | {"run_id": name})[n] for n in names) for name, change in cases.items()]
    normal = specs.normalised(spark.createDataFrame(rows, schemas.RUN_SPEC_RAW))
    found = {}
    for r in specs.violations(normal).collect():
        found.setdefault(r["run_id"], set()).add(r["rule"])
    assert set(found) == set(cases) - {"ok"} and all(name in rules for name, rules in found.items())
    ok = normal.where("run_id = 'ok'").first()
    assert (ok["tickers"], ok["benchmark"], ok["weighting"], ok["end"]) == (["SPY", "AGG"], "SPY", "custom", dt.date(2020, 12, 31))
    assert [r["run_id"] for r in specs.sound(normal).collect()] == ["ok"]
    specs.require_none(specs.violations(normal.where("run_id = 'ok'")))
    with pytest.raises(ValueError, match="tickers missing"):
        specs.require_none(specs.violations(normal.where("run_id = 'tickers missing'")))


def test_iso_dates(spark):
    cases = {
        "2020-01-31": dt.date(2020, 1, 31), " 20200131 ": dt.date(2020, 1, 31), "2020-W05-5": dt.date(2020, 1, 31), "2020W055": dt.date(2020, 1, 31), "2020-W53": dt.date(2020, 12, 28),
        "2021-W53-1": None, "1995": None, "1995-1-2": None, "1995-01-02 10:00": None, "2020-02-30": None, "0000-01-01": None, "2020-W05-8": None, "2020-W00": None, "2020-W055": None, "": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "text string").select("text", specs.iso_date(F.col("text")).alias("date"))
    assert {r["text"]: r["date"] for r in df.collect()} == cases


def test_a_run_without_usable_deviation_is_reported_and_never_valued(spark):
    days = b_days("2020-01-01", 40)
    flat, other = panel_frame(spark, {"A": [100.0] * 40, "B": [50.0] * 40}, days), panel_frame(spark, {"BM": [50.0] * 40}, days)
    runs = spec(spark, {"run_id": "flat", "weighting": "inverse_vol", "lookback_days": 5}, {"run_id": "equal"})
    checked = guard.checked(runs, flat, other)
    found = checked.problems.collect()
    assert {(r["run_id"], r["rule"]) for r in found} == {("flat", "no ticker with a usable deviation")} and str(days[5]) in {r["subject"] for r in found}
    assert {r["run_id"] for r in checked.nav_daily().collect()} == {"equal"}
    values = valuation.nav_daily(runs.where("run_id = 'flat'"), flat, other).collect()  # unguarded: no value, not zero
    assert len(values) == 35 and {r["portfolio_value"] for r in values if r["date"] > days[5]} == {None}


def test_strategies_are_shared(spark, toy):
    runs = spec(spark, {"run_id": "a"}, {"run_id": "b", "transaction_cost_bps": 0.0, "initial_capital": 5.0}, {"run_id": "c", "rebalance": "none"})
    assert valuation.strategies(runs).count() == 2
    rows = {(r["run_id"], r["date"]): r for r in valuation.nav_daily(runs, *toy).collect()}
    assert rows["b", dt.date(2020, 1, 31)]["portfolio_value"] == pytest.approx(7.5)


def test_staging_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from ledgerline.sources import staging

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError, match="checkpoint"):
        staging.shared_dir(session)


def test_bootstrap(spark):
    n = 60
    df = returns_frame(spark, const=([0.001] * n, [0.001] * n), short=([0.1] * 5, [0.1] * 5))
    rows = resample.paths(df, ["id"], 100.0, n_paths=20, years=(1,))
    ends = resample.horizons(rows, ["id"], 100.0, years=(1,)).collect()
    assert [r["id"] for r in ends] == ["const"] and ends[0]["median"] == pytest.approx(100 * 1.001**252) and ends[0]["p_beats"] == 0 and ends[0]["p_below"] == 0
    assert {r["step"] for r in resample.fan(rows, ["id"]).collect()} == set(range(0, 252, 5))
    table = resample.draws(spark.createDataFrame([(n,)], "n_obs long"), 40, 500).collect()
    by_path = {}
    for r in table:
        by_path.setdefault(r["path"], {})[r["step"]] = r["idx"]
    jumps = sum((p[s] != (p[s - 1] + 1) % n) for p in by_path.values() for s in range(1, 500))
    assert len(table) == 40 * 500 and 0.035 < jumps / (40 * 499) < 0.06
    again = resample.draws(spark.createDataFrame([(n,)], "n_obs long").repartition(5), 40, 500).collect()
    assert sorted(table) == sorted(again)


def test_ticks_sources_and_sinks(spark, tmp_path):
    rows = [("A", dt.datetime(2020, 1, 1, 9), 1.0, 1), ("A", dt.datetime(2020, 1, 1, 23, 59), 2.0, 2), ("A", dt.datetime(2020, 1, 1, 10), 3.0, 3), ("B", dt.datetime(2021, 5, 5), float("nan"), 1)]
    got = P.normalised_ticks(spark.createDataFrame(rows, schemas.PRICES_RAW))
    assert {tuple(r) for r in got.collect()} == {("A", dt.date(2020, 1, 1), 3.0), ("B", dt.date(2021, 5, 5), None)}
    store.upsert(got, f"{tmp_path}/prices")
    store.upsert(got.where("ticker = 'B'"), f"{tmp_path}/prices")  # 2020 stays
    assert store.read_prices(spark, f"{tmp_path}/prices", dt.date(2020, 1, 1), dt.date(2020, 12, 31)).count() == 1
    universe = spark.createDataFrame([("P", "A", dt.date(2020, 1, 1), dt.date(2020, 1, 1)), ("P", "B", dt.date(2020, 1, 1), dt.date(2022, 1, 1)), ("P", "C", dt.date(2020, 1, 1), dt.date(2022, 1, 1))], "panel_id string, ticker string, start date, end date")
    assert {r["ticker"] for r in P.missing_tickers(got, universe).collect()} == {"B", "C"}
    names = {"^BRK/B=X ": "BRK_B_X", "BRK-B": "BRK_B", "^^": "ticker", "": "ticker", "a.b": "a_b"}
    for raw, name in names.items():
        assert spark.range(1).select(P.safe_name(F.lit(raw)).alias("n")).first()["n"] == name
    (tmp_path / "specs.json").write_text('{"run_id": "r", "tickers": ["a"], "start": "2020-01-01", "unknown": 1}\n')
    read = P.read_specs(spark, f"{tmp_path}/specs.json")
    assert read.first()["tickers"] == ["a"] and read.first()["unknown_keys"] == ["unknown"] and "unknown" not in read.columns
    assert {r["rule"] for r in specs.violations(specs.normalised(read)).collect()} >= {"unknown keys", "end not a date"}
    P.write_result(read.select("run_id"), f"{tmp_path}/out", by=None)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_typed_definitions(spark, tmp_path):
    good = dict(run_id="g", panel_id="P", tickers=["A", "B"], start="2020-01-01", end="2020-12-31", initial_capital=1000, weighting="inverse_vol", rebalance="none", risk_free_rate=0.02, transaction_cost_bps=5, lookback_days=63)
    cases = {
        "g": ({}, set()), "bool": ({"initial_capital": True}, {"initial_capital not a number"}), "text": ({"risk_free_rate": "0.02"}, {"risk_free_rate not a number"}), "null": ({"transaction_cost_bps": None}, {"transaction_cost_bps not a number"}),
        "half": ({"lookback_days": 63.5}, {"lookback_days not a whole number"}), "float": ({"lookback_days": 63.0}, {"lookback_days not a whole number"}), "unused": ({"weighting": "equal", "lookback_days": "x", "custom_weights": "x"}, set()),
        "list": ({"tickers": "A"}, {"tickers not a list"}), "mixed": ({"weighting": "custom", "custom_weights": [0.5, "x"]}, {"custom_weights not a list of numbers"}), "two": ({"initial_capital": [], "lookback_days": 1}, {"initial_capital not a number", "lookback_days below two"}),
        "numbers": ({"tickers": [1, 2]}, set()), "huge": ({"lookback_days": 10**15}, set()), "whole": ({"weighting": "custom", "custom_weights": [1, 0]}, set()), "big": ({"initial_capital": 1e300}, set()),
    }
    lines = [json.dumps(good | change | {"run_id": name}) for name, (change, _) in cases.items()] + ['{"run_id": "cut", "initial', "[1]", "3", "  ", '{"run_id": 1, "run_id": 2}']
    (tmp_path / "runs.json").write_text("\n".join(lines))
    normal = specs.normalised(P.read_specs(spark, f"{tmp_path}/runs.json"))
    found = {}
    for r in specs.violations(normal).collect():
        found.setdefault(r["run_id"], set()).add(r["rule"])
    assert found == {name: rules for name, (_, rules) in cases.items() if rules} | {None: {"line unreadable"}}
    assert {r["run_id"] for r in specs.sound(normal).collect()} == {name for name, (_, rules) in cases.items() if not rules}
    bad = P.read_unreadable(spark, f"{tmp_path}/runs.json").collect()
    assert [r["value"] for r in bad] == [lines[-5], "[1]", "3", lines[-1]] and bad[0]["file"].endswith("runs.json")
    assert {r["run_id"]: r["lookback_days"] for r in normal.collect()}["huge"] == 2**31 - 1


def test_upserts_keep_all_other_rows(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/store"
    day = lambda y, k: dt.date(y, 3, 1) + dt.timedelta(k)
    frame = lambda rows: spark.createDataFrame(rows, schemas.PRICES)
    rows = {(t, day(y, k)): float(k) for t in "AB" for y in (2019, 2020) for k in range(5)}
    read = lambda n=None: {(r["ticker"], r["date"]): r["close"] for r in store.read_prices(spark, path, dt.date(2019, 1, 1), dt.date(2021, 12, 31), n).collect()}
    assert read() == {} and store.upsert(frame([]), path) == 0
    assert store.upsert(frame([(*k, v) for k, v in rows.items()]), path) == 1
    fixed = store.read_prices(spark, path, dt.date(2019, 1, 1), dt.date(2021, 12, 31))
    assert store.upsert(frame([("A", day(2020, 2), 99.0), ("C", day(2021, 0), None), ("B", day(2020, 1), 5.0), ("B", day(2020, 1), 6.0), (None, day(2018, 0), 1.0)]), path) == 2
    after = rows | {("A", day(2020, 2)): 99.0, ("C", day(2021, 0)): None, ("B", day(2020, 1)): 6.0}
    assert read() == after and read(1) == rows and fixed.count() == len(rows)
    # a job that dies before its version is made
    with monkeypatch.context() as m:
        m.setattr(store.Files, "create", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.upsert(frame([("A", day(2019, 0), -1.0)]), path)
    assert read() == after and store.version(spark, path).number == 2
    # another writer comes first: both changes are in
    create, rival = store.Files.create, [True]

    def slower(self, name, text):
        if rival:
            rival.clear()
            store.upsert(frame([("A", day(2019, 1), 1.5)]), path)
        return create(self, name, text)

    with monkeypatch.context() as m:
        m.setattr(store.Files, "create", slower)
        assert store.upsert(frame([("A", day(2019, 0), -1.0)]), path) == 4
    after |= {("A", day(2019, 1)): 1.5, ("A", day(2019, 0)): -1.0}
    assert read() == after
    store.remove_unused(spark, path)
    assert read() == after and len(list((tmp_path / "store" / "data").iterdir())) == 2
    with pytest.raises(ValueError, match="no version 1"):
        read(1)


def test_streaming_closes(spark, tmp_path):
    from ledgerline.streaming.ticks import streaming_closes

    rows = [("A", dt.datetime(2020, 1, 1, 9), 1.0, 1), ("A", dt.datetime(2020, 1, 1, 10), 2.0, 2), ("A", dt.datetime(2020, 1, 3), 9.0, 3)]
    spark.createDataFrame(rows, "ticker string, ts timestamp, close double, seq long").write.parquet(f"{tmp_path}/ticks")
    stream = spark.readStream.schema("ticker string, ts timestamp, close double, seq long").parquet(f"{tmp_path}/ticks")
    query = streaming_closes(stream).writeStream.outputMode("append").format("memory").queryName("closes").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM closes").collect()] == [("A", dt.date(2020, 1, 1), 2.0)]


def test_daily_rate(spark):
    assert spark.range(1).select(M.daily_rate(F.lit(0.02)).alias("x")).first()["x"] == pytest.approx(1.02 ** (1 / 252) - 1)


def test_tables_between_steps(spark):
    from pathlib import Path

    from ledgerline.sources import staging

    df = staging.written(spark.range(3), "three")
    folder = Path(staging.shared_dir(spark)) / f"ledgerline-{spark.sparkContext.applicationId}"
    assert df.count() == 3 and any(folder.glob("three-*"))


def test_bootstrap_is_registered_with_all_paths():
    from ledgerline.plans import queries

    assert queries.PATHS == resample.N_PATHS == 10_000
