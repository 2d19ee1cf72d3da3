"""Look-back, month bucket, names, settlement and grids."""

import datetime as dt
import random

from pyspark.sql import functions as F

from formline.operators import joins as J

D = dt.date


def test_look_back_edges(spark):
    df = spark.createDataFrame([(1, "h", D(2024, 1, 5)), (2, "x", D(2024, 1, 5)), (3, None, D(2024, 1, 5))], "id int, horse string, d date")
    works = spark.createDataFrame(
        [("h", D(2023, 12, 22), 50.0), ("h", D(2023, 12, 21), 40.0), ("h", D(2024, 1, 5), 30.0), ("h", D(2024, 1, 4), None), ("h", D(2024, 1, 4), 49.0), (None, D(2024, 1, 4), 1.0)],
        "horse string, w date, t double",
    )
    got = {r["id"]: (r["best"], r["n"]) for r in J.look_back(df, works, "horse", "d", "w", {"best": "t"}, "n").collect()}
    assert got == {1: (49.0, 3), 2: (None, 0), 3: (None, 0)}
    days = {r["id"]: r["m"] for r in J.look_back(df, works, "horse", "d", "w", {}, "n", "m").collect()}
    assert days == {1: 2, 2: 0, 3: 0}


def test_look_back_random(spark):
    rng = random.Random(3)
    day = lambda: D(2024, 1, 1) + dt.timedelta(days=rng.randrange(90))
    rows = [(i, rng.choice("ab"), day()) for i in range(80)]
    works = [(rng.choice("ab"), day(), float(rng.randrange(40, 60))) for _ in range(150)]
    out = J.look_back(spark.createDataFrame(rows, "id int, horse string, d date"), spark.createDataFrame(works, "horse string, w date, t double"), "horse", "d", "w", {"best": "t"}, "n")
    for r in out.collect():
        seen = [t for h, w, t in works if h == r["horse"] and 0 < (r["d"] - w).days <= 14]
        assert (r["best"], r["n"]) == (min(seen, default=None), len(seen))


def test_fills_of_a_look_back(spark):
    df = spark.createDataFrame([(1, 50.0, 2, 1), (2, None, 0, None), (3, 54.0, 1, 0)], "i int, best double, n bigint, m bigint")
    fill = lambda d: sorted(tuple(r) for r in J.with_fills(d, {"best": 53.0}, {"has": "best"}, ["n", "m"], "total").select("i", "best_filled", "has", "total").collect())
    assert fill(df) == [(1, 50.0, 1, 3), (2, 52.0, 0, 0), (3, 54.0, 1, 1)]
    # Where no value is known the given number fills; an empty table gives no rows.
    assert fill(df.filter("i = 2")) == [(2, 53.0, 0, 0)]
    assert fill(df.filter("i = 9")) == []


def test_month_bucket_crosses_the_year(spark):
    df = spark.createDataFrame([(1, "h", D(2024, 1, 10))], "id int, horse string, d date")
    works = spark.createDataFrame([("h", D(2023, 12, 30), 51.0), ("h", D(2024, 1, 20), 48.0)], "horse string, w date, t double")
    run = lambda as_of: J.month_bucket(df, works, "horse", "d", "w", {"best": "t"}, as_of=as_of).first()["best"]
    # the workout after the race must not be seen
    assert run(True) == 51.0 and run(False) == 48.0


def test_fuzzy_names(spark):
    table = "key string, pos int, rate double"
    over = spark.createDataFrame([("lemaire", 1, 0.22), ("take", 2, 0.17)], table)
    rates = spark.createDataFrame([("yoko", 1, 0.1), ("yokoyama t", 2, 0.12), ("take", 3, 0.01)], table)
    names = ["lemaire", "c.lemaire", "yokoyama", "tak", "nobody", "maire", "take"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    got = {r["name"]: r["rate"] for r in J.fuzzy_rate(df, "name", over, rates, 0.05, "rate").collect()}
    assert got == {"lemaire": 0.22, "c.lemaire": 0.22, "yokoyama": 0.1, "tak": 0.17, "nobody": 0.05, "maire": 0.22, "take": 0.17, None: 0.05}


def test_settle_pending(spark):
    p = spark.createDataFrame([(1,), (2,), (3,)], "race_id int")
    r = spark.createDataFrame([(1, 1, 5000), (2, 0, 900)], "race_id int, hit int, yen int")
    got = {x["race_id"]: (x["status"], x["profit"]) for x in J.settle_ledger(p, r, "race_id", "hit", "yen").collect()}
    assert got == {1: ("settled", 4300), 2: ("settled", -700), 3: ("pending", None)}


def test_match_bets(spark):
    bets = spark.createDataFrame([(1, [[1, 2], [1, 3]]), (2, []), (3, [[4, 5]])], "k int, bets array<array<bigint>>")
    pays = spark.createDataFrame([(1, [1, 3], 360), (1, [2, 3], 500)], "k int, combo array<bigint>, yen bigint")
    got = {r["k"]: (r["bets"], r["hits"], r["paid"]) for r in J.match_bets(bets, pays, "k").collect()}
    assert got == {1: (2, 1, 360), 2: (0, 0, 0), 3: (1, 0, 0)}


def test_grid_has_no_cross_join(spark):
    cells = spark.createDataFrame([(1200, 10, 0, "spring", 3), (2000, 16, 2, "winter", 5)], "distance int, num_horses int, going int, season string, n int")
    out = J.filter_grid(cells, [(1000, 1400), (1000, 2600)], [(8, 18)], [(0, 1), (0, 1, 2, 3)], ["spring", "winter"])
    got = out.groupBy("f_distance", "f_going", "f_season").agg(F.sum("n")).collect()
    assert {tuple(r) for r in got} >= {("1000-2600", "0123", "all", 8), ("1000-1400", "01", "spring", 3), ("1000-2600", "0123", "winter", 5)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
