"""Statistics against plain Python and numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.operators import chunked as C
from formline.operators import inrace as I
from formline.operators import roi as Q
from formline.operators import statistics as S
from formline.operators.chunked import percentiles


def test_auc_with_ties(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(20) / 10 - 1, rng.randrange(2)) for _ in range(400)] + [("one", 0.5, 1)]
    got = {r["g"]: r["auc"] for r in S.auc(spark.createDataFrame(rows, "g string, s double, y int"), ["g"], "s", "y").collect()}
    assert set(got) == {"a", "b"}
    for g in got:
        pos = [s for k, s, y in rows if k == g and y]
        neg = [s for k, s, y in rows if k == g and not y]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert abs(got[g] - want) < 1e-12


def test_percentiles_match_numpy(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice([0.0, -3.5, 1e6, rng.random() * 1000])) for _ in range(301)] + [("a", None)]
    out = percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p10": 0.1, "p50": 0.5, "p97": 0.97})
    for r in out.collect():
        v = [x for g, x in rows if g == r["g"] and x is not None]
        assert np.allclose([r["p10"], r["p50"], r["p97"]], np.percentile(v, [10, 50, 97]))


def test_top_share(spark):
    rows = [("a", float(v)) for v in [1, 1, 1, 5, 5, 10, 20, 2, 3, 4, 6, 7]]
    r = S.top_share(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"top2": 2, "top5": 5, "tenth": 0.1}).first()
    assert r["n"] == 12 and r["total"] == 65.0
    assert (r["top2"], r["top5"], r["tenth"]) == pytest.approx((30 / 65, 48 / 65, 20 / 65))


def test_bootstrap_is_stable_and_covers(spark):
    rng = random.Random(7)
    rows = [("a", 3000.0 if rng.random() < 0.3 else 0.0) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double")
    one = S.bootstrap(df, ["g"], "v", 2000, 700.0).first()
    two = S.bootstrap(df.repartition(7), ["g"], "v", 2000, 700.0).first()
    point = sum(v for _, v in rows) / (len(rows) * 700) * 100
    assert one["ci_lower"] < point < one["ci_upper"]
    assert abs(one["mean_roi"] - point) < 1.0 and abs(one["mean_roi"] - two["mean_roi"]) < 1e-9
    # the deviation of a resampled mean
    want = np.std([v for _, v in rows]) / np.sqrt(len(rows)) / 7
    assert abs(one["std_roi"] - want) < want * 0.1


def test_drop_fraction(spark):
    rows = [(i, "a" if i < 50 else "b", int(i % 2 == 0)) for i in range(100)]
    out = S.drop_fraction(spark.createDataFrame(rows, "k int, g string, hit int"), ["g"], "k", "hit", 0.2)
    got = out.groupBy("g").agg(F.sum("dropped").alias("d"), F.count("*").alias("n"), F.sum(F.col("dropped") * (1 - F.col("hit"))).alias("bad")).collect()
    assert sorted((r["g"], r["d"], r["n"], r["bad"]) for r in got) == [("a", 5, 50, 0), ("b", 5, 50, 0)]


def test_drawdown_and_streaks(spark):
    profit = [-100, 500, -100, -100, -100, 200, -100, 900, -100]
    rows = [("k", i // 3, i, p, int(p > 0)) for i, p in enumerate(profit)]
    df = spark.createDataFrame(rows, "k string, day int, i int, profit int, hit int")
    for size in (100, 2, 1):
        d = I.ledger_runs(df, ["k"], ["day", "i"], "profit", "hit", rows=size).first()
        assert (d["rows"], d["final_profit"], d["peak"], d["max_drawdown"], d["rows_below_peak"]) == (9, 1000, 1100, 300, 7)
        assert (d["longest_streak"], d["streaks"], d["longest_recovery"]) == (3, 4, 5)


def plain_runs(flags):
    runs, n = [], 0
    for f in [*flags, False]:
        if f:
            n += 1
        elif n:
            runs.append(n)
            n = 0
    return runs


@pytest.mark.parametrize("fold", [1000, 3])
def test_segments_of_any_size_give_the_same_summary(spark, monkeypatch, fold):
    """One group holds most rows, on two days; another has no hit, one no miss; a NULL group counts."""
    monkeypatch.setattr(I, "FOLD", fold)
    rng = random.Random(fold)
    rows = [("hot", rng.randint(1, 2), i, float(rng.choice([-100, -100, 0, 300])), rng.choice([0, 0, 1])) for i in range(400)]
    rows += [("cold", i, i, -5.0, 0) for i in range(9)] + [("won", i, i, 5.0, 1) for i in range(4)] + [(None, 1, i, float(rng.randint(-9, 9)), i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, day int, i int, profit double, hit int").repartition(5)
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == k)
        cum = np.cumsum([r[2] for r in own])
        peak = np.maximum(0, np.maximum.accumulate(cum))
        miss, low = plain_runs([r[3] == 0 for r in own]), plain_runs(cum < peak)
        want[k] = (len(own), cum[-1], peak[-1], (peak - cum).max(), int((cum < peak).sum()), max(miss, default=None), sum(miss) / len(miss) if miss else None, len(miss) or None, max(low, default=None))
    for size in (7, 100_000):
        got = {r["k"]: tuple(r)[1:] for r in I.ledger_runs(df, ["k"], ["day", "i"], "profit", "hit", rows=size).collect()}
        assert got == want


def test_one_scan_and_few_exchanges(spark):
    df = spark.createDataFrame([("a", 1, 1, 5, 1)], "k string, day int, i int, profit int, hit int")
    plan = I.ledger_runs(df, ["k"], ["day", "i"], "profit", "hit")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 8


def test_values_of_one_magnitude_are_cut_into_many_ranges(spark):
    """A million-fold sum of nearly equal values: ranges follow the values, and the result is exact."""
    df = spark.range(20_000).select((F.lit(1_600_000_000) + F.pmod(F.col("id") * 7919, F.lit(20_000))).alias("v"), (F.col("id") % 2).alias("y"))
    cells = C.cumulative_cells(df, [], "v", {"n": F.lit(1).cast("bigint")})
    got = [tuple(r) for r in cells.orderBy("v").select("n_before", "n_all").collect()]
    assert got == [(i, 20_000) for i in range(20_000)]
    edges = F.array(*[F.lit(e) for e in df.select(C.even_edges("v", C.PARTS).alias("e")).first()["e"]])
    sizes = df.select(C.bisect(edges, F.col("v"), C.PARTS.bit_length()).alias("b")).groupBy("b").count().collect()
    assert len(sizes) > 400 and max(r["count"] for r in sizes) < 120
    assert [round(x, 6) for x in percentiles(df, [], "v", {"p": 0.25, "q": 0.9}).first()] == [round(float(np.percentile(np.arange(1_600_000_000, 1_600_020_000), q)), 6) for q in (25, 90)]


def test_report_best_ticket(spark):
    rows = [("A", 1, 1000.0, 0, 0.0, 1, 700.0)] * 2 + [("B", 0, 0.0, 0, 0.0, 0, 0.0)]
    df = spark.createDataFrame(rows, "c string, trio_hit int, est_trio_return double, umaren_hit int, est_umaren_return double, wide_hit int, est_wide_return double")
    got = {r["c"]: (r["n"], r["best_bet"], r["stars"], r["recommended"]) for r in Q.report(df, ["c"]).collect()}
    assert got == {"A": (2, "trio", 3, True), "B": (1, "trio", 0, False)}


def test_random_rates(spark):
    df = spark.createDataFrame([(10,), (3,), (2,)], "n int")
    cols = [Q.random_rate(F.col("n"), "trio", 7), Q.random_rate(F.col("n"), "umaren", 2), Q.random_rate(F.col("n"), "wide", 2)]
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert got[0] == pytest.approx((7 / 120, 2 / 45, 1 - (1 - 3 / 45) ** 2))
    assert got[1] == pytest.approx((1.0, 2 / 3, 1.0)) and got[2] == (0.0, 0.0, 0.0)


def test_ranks_in_race(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 3, 1.0), (1, 4, 9.0)], "race int, u int, s double")
    got = {r["u"]: r["k"] for r in df.select("u", I.average_rank_floor(["race"], "s").alias("k")).collect()}
    assert got == {4: 1, 1: 2, 2: 2, 3: 4}
