import datetime as dt
import random

import pytest

from ledgerline.operators import clean, datesets

EPOCH = dt.date(1970, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, "panel_id string, date date, n int")


def days(rows):
    return {(r["panel_id"], r["date"]) for r in rows.collect()}


@pytest.mark.parametrize("most", [datesets.BROADCAST_BITMAPS, 0])  # broadcast, and unfolded and shuffled
def test_shared_dates_equal_sets(spark, most):
    rng = random.Random(5)
    # around the epoch, and around the ends of the buckets on both sides of it
    around = [0, 32_768, -32_768, 40_000]
    pick = lambda: {(p, EPOCH + dt.timedelta(rng.choice(around) + rng.randint(-30, 30))) for p in ("a", "b", None) for _ in range(120)}
    left, right = pick(), pick()
    left.add(("only left", EPOCH)), right.add(("only right", EPOCH)), left.add(("apart", EPOCH)), right.add(("apart", EPOCH + dt.timedelta(1)))
    a, b = (frame(spark, [(p, d, k) for p, d in side for k in (1, 2)] + [("a", None, 3)]) for side in (left, right))
    both = datesets.shared(a, b, ["panel_id"])
    assert both.where("panel_id IN ('only left', 'only right', 'apart')").count() == 0
    assert days(datesets.unfolded(both, ["panel_id"])) == left & right
    kept = datesets.at_dates(a, both, ["panel_id"], most=most)
    assert days(kept) == left & right and kept.count() == 2 * len(left & right)
    assert kept.columns == a.columns
    counted = {r["panel_id"]: r["n"] for r in datesets.sizes(both, ["panel_id"], "n").collect()}
    assert counted == {p: sum(q == p for q, _ in left & right) for p in {q for q, _ in left & right}}


def test_three_sets_need_all(spark):
    d = [EPOCH + dt.timedelta(10_000 + k) for k in range(6)]
    sides = [frame(spark, [("p", x, 0) for x in part]) for part in (d[:4], d[1:5], d[2:])]
    sets = datesets.of(sides[0], ["panel_id"])
    for side in sides[1:]:
        sets = sets.unionByName(datesets.of(side, ["panel_id"]))
    assert days(datesets.unfolded(datesets.common(sets, ["panel_id"], 3), ["panel_id"])) == {("p", d[2]), ("p", d[3])}


def test_empty_tables_and_clashing_columns(spark):
    none = frame(spark, [])
    some = frame(spark, [("p", EPOCH, 1)]).withColumnRenamed("n", "day")
    both = datesets.shared(some, some.withColumnRenamed("day", datesets.BITMAP), ["panel_id"])
    assert datesets.at_dates(some, both, ["panel_id"]).count() == 1
    empty = datesets.shared(none, some, ["panel_id"])
    assert empty.count() == 0 and datesets.at_dates(some, empty, ["panel_id"]).count() == 0


def test_alignment_shuffles_bitmaps_and_no_rows(spark):
    rows = frame(spark, [(str(p), EPOCH + dt.timedelta(k), k) for p in range(5) for k in range(50)])
    path = clean.written(rows, "rows")
    a, _ = clean.aligned(path, path)
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
