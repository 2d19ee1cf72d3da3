"""History operators against plain Python over small random data."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from formline.operators import history as H
from formline.operators.audit import leaks
from formline.operators.chunked import count_chunks, lag_columns

SCHEMA = "race_date date, race_id bigint, runner_no bigint, horse string, finish bigint, is_win bigint"


def sample(seed=1, hot=False):
    """Entries with a NULL key, two races of a horse on one day, the same key twice in a race, month and year ends."""
    rng = random.Random(seed)
    rows = []
    for race in range(60):
        day = dt.date(2023, 12, 20) + dt.timedelta(days=race // 2)
        for runner in range(1, 6):
            horse = "hot" if hot and rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
            rows.append((day, race, runner, horse, runner, int(runner == 1)))
    return rows


def naive_rate(rows, mode, alpha, prior):
    out = {}
    for d, r, u, h, _, w in rows:
        def earlier(x):
            if mode == "day":
                return x[0] < d
            if mode == "race":
                return (x[0], x[1]) < (d, r)
            return (x[0], x[1], x[2]) < (d, r, u)
        past = [x for x in rows if h is not None and x[3] == h and earlier(x)]
        out[(r, u)] = (sum(x[5] for x in past) + alpha * prior) / (len(past) + alpha)
    return out


@pytest.mark.parametrize("mode", ["day", "race", "row"])
@pytest.mark.parametrize("hot", [False, True])
def test_expanding_rate(spark, mode, hot):
    rows = sample(hot=hot)
    df = spark.createDataFrame(rows, SCHEMA)
    prior = sum(r[5] for r in rows) / len(rows)
    got = {(r["race_id"], r["runner_no"]): r["rate"] for r in H.expanding_rate(df, ["horse"], F.col("is_win"), 5.0, "rate", mode=mode).collect()}
    want = naive_rate(rows, mode, 5.0, prior)
    assert got.keys() == want.keys() and len(got) == len(rows)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_min_count_and_train_prior(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    out = H.expanding_rate(df, ["horse"], F.col("is_win"), 5.0, "rate", prior="train", train=F.col("race_id") < 10, min_n=3, default=0.07)
    first = out.filter(F.col("race_date") == "2023-12-20").select("rate").distinct().collect()
    assert [r["rate"] for r in first] == [0.07]


@pytest.mark.parametrize("chunked", [True, False])
def test_lags_cross_chunks(spark, chunked):
    rows = [r for r in sample(hot=True) if r[3] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    chunk = F.trunc("race_date", "month") if chunked else None
    out = lag_columns(df, ["horse"], ["race_date", "race_id", "runner_no"], {"p1": ("finish", 1), "p4": ("finish", 4)}, chunk)
    got = {(r["race_id"], r["runner_no"]): (r["p1"], r["p4"]) for r in out.collect()}
    for d, r, u, h, _, _ in rows:
        past = sorted([x for x in rows if x[3] == h and (x[0], x[1], x[2]) < (d, r, u)], reverse=True)
        want = tuple(past[k - 1][4] if len(past) >= k else None for k in (1, 4))
        assert got[(r, u)] == want


def test_chunk_shorter_than_depth(spark):
    # One start per month: every lag comes from other chunks.
    rows = [(dt.date(2023, m, 1), m, 1, "x", m, 0) for m in range(1, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = lag_columns(df, ["horse"], ["race_date", "race_id"], {"p1": ("finish", 1), "p3": ("finish", 3)}, F.trunc("race_date", "month"))
    assert sorted((r["race_id"], r["p1"], r["p3"]) for r in out.collect())[4] == (5, 4, 2)


def test_null_lag_takes_the_default(spark):
    rows = [(dt.date(2023, 1, 1), 1, 1, "x", None, 0), (dt.date(2023, 2, 1), 2, 1, "x", 2, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = H.starts(df.withColumnRenamed("horse", "horse_id"), cols=["finish"], depth=1)
    got = {r["race_id"]: r["p"] for r in out.select("race_id", H.previous_start(1, "finish", F.lit(5)).alias("p")).collect()}
    assert got == {1: 5, 2: 5}


def test_rest_days(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 1), dt.date(2024, 2, 27)), (dt.date(2024, 3, 1), None)], "d date, p date")
    cols = [H.rest_days(F.col("d"), F.col("p")), H.rest_days(F.col("d"), F.col("p"), compat=True)]
    assert [tuple(r) for r in df.select(*cols).collect()] == [(3, 74), (30, 30)]


@pytest.mark.parametrize("mode,leaky", [("day", False), ("row", True)])
def test_leak_test_finds_leaks(spark, mode, leaky):
    df = spark.createDataFrame(sample(hot=True), SCHEMA)
    feature = lambda d: H.expanding_rate(d, ["horse"], F.col("is_win"), 5.0, "rate", prior=0.1, mode=mode)
    found = leaks(df, feature, ["race_id", "runner_no"], {"is_win": F.lit(0).cast("bigint")}, "race_date", "2024-01-05")
    assert (found.count() > 0) == leaky


def test_top_n_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "b", "a", "a", "c", None]], "v string")
    got = {r["v"]: r["v_code"] for r in H.top_n_encode(df, "v", 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, None: 2}


def test_profile_without_history(spark):
    cols = "race_date date, race_id bigint, runner_no bigint, horse_id string, distance bigint, surface bigint, course bigint, finish bigint, popularity bigint, pass4 bigint, last3f double, time double"
    rows = [(dt.date(2024, 1, d), d, 1, "x", 1600, 0, 1, d, 1, 2, 35.0, 96.0) for d in range(1, 14)]
    got = {r["race_id"]: r for r in H.recent_profile(spark.createDataFrame(rows, cols)).collect()}
    assert got[1]["dist_apt"] == 0.5 and got[1]["running_style"] == 0 and got[1]["interval_days"] == 30
    # the last ten of twelve earlier starts: finishes 3..12
    assert abs(got[13]["dist_apt"] - (1 - (7.5 - 1) / 17)) < 1e-12 and got[13]["place_rate"] == 0.1 and got[13]["best_time"] == 96.0


@pytest.mark.parametrize("prior", ["global", 0.2])
def test_rates_together_equal_single_rates(spark, prior):
    df = spark.createDataFrame([(*r, r[1] % 2) for r in sample(hot=True)], SCHEMA + ", surface bigint")
    df = df.withColumn("surface", F.when(F.col("race_id") % 5 > 0, F.col("surface")))
    win = F.col("is_win")
    many = H.expanding_rates(df, "horse", {"a": ([], win, 5.0), "b": (["surface"], win, 3.0)}, prior=prior)
    one = H.expanding_rate(df, ["horse"], win, 5.0, "a", prior=prior)
    two = H.expanding_rate(df, ["horse", "surface"], win, 3.0, "b", prior=prior)
    key = lambda d, c: {(r["race_id"], r["runner_no"]): r[c] for r in d.collect()}
    a, b = key(many, "a"), key(many, "b")
    wa, wb = key(one, "a"), key(two, "b")
    assert a.keys() == wa.keys() and all(abs(a[k] - wa[k]) < 1e-12 and abs(b[k] - wb[k]) < 1e-12 for k in a)


def test_previous_races_in_chunks(spark):
    from formline.operators.groups import previous_races

    rows = [("v", i, j) for i in range(12) for j in range(2)]
    df = spark.createDataFrame(rows, "venue string, race bigint, x bigint")
    run = lambda chunk: sorted(tuple(r) for r in previous_races(df, ["venue"], ["race"], {"x": F.col("x") + F.col("race")}, chunk=chunk).collect())
    plain, cut = run(None), run(F.floor(F.col("race") / 4))
    assert plain == cut and plain[7] == ("v", 7, sum(2 * i + 1 for i in range(2, 7)), 5)


def test_chunks_follow_the_counts(spark):
    """A third of all rows has one key and lies on three days: no chunk holds more than a few percent of them, order is
    kept, and starts and row-wise rates are those of one window."""
    rng = random.Random(4)
    rows = [(dt.date(2024, 1, rng.randint(1, 3)), race, 1, "hot", rng.randint(1, 18), rng.randint(0, 1)) for race in range(1000)]
    rows += [(dt.date(2024, 1, rng.randint(1, 28)), 1000 + i, 2, rng.choice(["a", "b", None, *"cdefg"]), rng.randint(1, 18), 0) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    order = ["race_date", "race_id", "runner_no"]
    chunked = count_chunks(df, ["horse"], order[:2], "c", rows=100, parts=64)
    sizes = {(r["horse"], r["c"]): r["count"] for r in chunked.groupBy("horse", "c").count().collect()}
    assert sum(sizes.values()) == 3000 and max(sizes.values()) <= 150
    for key in ("hot", "a", None):
        own = [r["c"] for r in chunked.filter(F.col("horse").eqNullSafe(F.lit(key))).orderBy(*order).collect()]
        assert own == sorted(own)
    assert count_chunks(df, ["horse"], order[:2], "c", rows=5000) is None
    whole = H.starts(df, "horse", order, ["finish"], 3)
    cut = H.starts(df, "horse", order, ["finish"], 3, rows=100)
    assert whole.exceptAll(cut).count() == 0 == cut.exceptAll(whole).count()
    rates = [H.prior_counts(df, ["horse"], F.col("is_win"), "p", mode="row", rows=n) for n in (100, 100_000)]
    assert rates[0].exceptAll(rates[1]).count() == 0


@pytest.mark.parametrize("prior", ["global", 0.2])
def test_rates_of_small_and_large_leads_are_alike(spark, prior):
    """Windows over rows and windows over cells give the same rates, also for NULL keys and a NULL date."""
    rows = [(None, *r[1:]) if i % 37 == 0 else r for i, r in enumerate(sample(hot=True))]
    df = spark.createDataFrame([(*r, r[1] % 2) for r in rows], SCHEMA + ", surface bigint")
    df = df.withColumn("surface", F.when(F.col("race_id") % 5 > 0, F.col("surface")))
    families = {"a": ([], F.col("is_win"), 5.0), "b": (["surface"], F.col("is_win"), 3.0)}
    plain, cells = (H.expanding_rates(df, "horse", families, prior=prior, rows=n) for n in (1000, 1))
    assert plain.exceptAll(cells).count() == 0 == cells.exceptAll(plain).count() and plain.columns == cells.columns
    plain, cells = (H.prior_counts(df, ["horse", "surface"], F.col("is_win"), "p", small=n) for n in (1000, 1))
    assert plain.exceptAll(cells.select(*plain.columns)).count() == 0 == cells.select(*plain.columns).exceptAll(plain).count()


def test_rates_count_their_history_where_it_is_named(spark):
    df = spark.createDataFrame(sample(), SCHEMA)
    families = {"a": ([], F.col("is_win"), 5.0)}
    grown = df.join(df.select("race_id").distinct(), "race_id")
    for n in (1000, 1):
        got, want = (H.expanding_rates(x, "horse", families, prior=0.1, rows=n, **k).select(*df.columns, "a") for x, k in ((grown, {"history": df}), (df, {})))
        assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_parts_follow_the_rows(spark):
    """The parts of the exchange grow with the rows, so those of one task do not."""
    from formline.operators import chunked

    assert [chunked.parts_for(n) for n in (0, 1, chunked.TASK_ROWS, 10 * chunked.TASK_ROWS, 60 * chunked.TASK_ROWS)] == [1, 1, 1, 10, 60]
    df = spark.range(300_000).selectExpr("id AS horse", "DATE'2024-01-01' AS race_date", "id AS race_id", "1L AS runner_no", "id % 2 AS is_win")
    out = H.expanding_rates(df, "horse", {"a": ([], F.col("is_win"), 5.0)}, prior=0.1)
    assert "hashpartitioning(horse" in (plan := out._jdf.queryExecution().toString()) and "3), REPARTITION_BY_NUM" in plan and "Join" not in plan


def test_rates_by_race_deal_the_rows_of_one_exchange(spark, monkeypatch):
    """No join or window of all rows but the ones on keys and day, dealt by rows; rows without key, day or race have no history."""
    day = lambda d: None if d is None else dt.date(2024, 1, d)
    rows = [("t", 1, 1, 1), ("t", 1, 1, 0), ("t", 1, 2, 1), ("t", 2, 3, 0), ("t", 2, None, 1), (None, 2, 3, 1), ("t", None, 4, 1), ("t", 2, 5, 1), ("u", 2, 3, 1)]
    df = spark.createDataFrame([(t, day(d), r, h) for t, d, r, h in rows], "trainer string, race_date date, race_id int, hit int")
    dealt = []
    monkeypatch.setattr(H, "parts_for", lambda n: dealt.append(n) or 3)
    got = lambda **more: sorted(map(str, H.prior_counts(df, ["trainer"], F.col("hit"), "p", mode="race", **more).select("trainer", "race_date", "race_id", "p_n", "p_hits").collect()))
    assert got() == got(small=0)
    assert dealt == [len(rows)]


def test_profile_counts_only_starts_there_are(spark):
    rows = [(1, 1, 1, None, 36.0), (1, 2, 1, 4, 46.0), (1, 3, 1, 2, None), (2, 1, 1, 1, 40.0)]
    cols = "horse_id int, day int, runner_no int, finish int, last3f double"
    df = spark.createDataFrame(rows, cols).selectExpr("*", "date_add(date'2024-01-01', day) AS race_date", "day AS race_id", "1200 AS distance", "0 AS surface", "CAST(NULL AS INT) AS course", "runner_no AS popularity", "runner_no AS pass4", "72.0D AS time")
    out = H.recent_profile(df)
    got = {(r["horse_id"], r["race_id"]): r for r in out.collect()}
    assert [got[k]["place_rate"] for k in ((1, 1), (1, 2), (1, 3), (2, 1))] == [0, 0, 0, 0]
    assert (got[1, 3]["dist_apt"], got[1, 3]["course_apt"], got[1, 3]["avg_last3f"], got[1, 3]["best_time"]) == (1 - 3 / 17, 0.5, 36.0, 72.0)
    assert got[1, 1]["best_time"] is None and got[1, 1]["running_style"] == 0
    # No lambda over the starts, which Spark would interpret.
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_few_cells_are_sent_to_the_rows(spark):
    """A lead with many rows but few cells: the rows are not dealt for the join, and the rates are the same."""
    df, families = spark.createDataFrame(sample(5), SCHEMA).withColumn("surface", F.col("race_id") % 2), {"a": ([], F.col("is_win"), 5.0), "b": (["surface"], F.col("is_win"), 3.0)}
    dealt, sent = (H.expanding_rates(df.hint("merge"), "horse", families, prior=0.1, rows=1, few=n) for n in (0, 10_000))
    assert dealt.exceptAll(sent).count() == 0 == sent.exceptAll(dealt).count()
    join = sent._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in join and "SortMergeJoin" not in join
    assert "BroadcastHashJoin" not in H.expanding_rates(df.hint("merge"), "horse", families, prior=0.1, rows=1, few=3)._jdf.queryExecution().executedPlan().toString()
