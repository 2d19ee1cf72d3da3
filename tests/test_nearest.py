"""The two-sided join in time against plain Python."""

import datetime as dt
import random

import pytest

from formline.operators.nearest import nearest_in_time

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("rows", [1_000_000, 20])
def test_nearest_equals_brute_force(spark, rows):
    """One venue has most rows; ties go to the earlier time, equal times to the larger value; NULLs find nothing."""
    rng = random.Random(rows)
    at = lambda: T0 + dt.timedelta(minutes=rng.randint(0, 600))
    venue = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, venue(), at() if rng.random() > 0.05 else None) for i in range(400)] + [(400, "empty", T0)]
    right = [(venue(), at() if rng.random() > 0.05 else None, rng.randint(0, 99)) for _ in range(150)] + [("only right", T0, 1)]
    l = spark.createDataFrame(left, "i int, v string, t timestamp_ntz").repartition(3)
    r = spark.createDataFrame(right, "v string, s timestamp_ntz, x int").repartition(3)
    got = {row["i"]: (row["near_s"], row["near_x"]) for row in nearest_in_time(l, r, ["v"], "t", "s", ["x"], rows=rows).collect()}
    assert len(got) == len(left)
    for i, v, t in left:
        near = [(abs(s - t), s, -x) for w, s, x in right if v is not None and w == v and s is not None and t is not None]
        want = (None, None) if not near else (min(near)[1], -min(near)[2])
        assert got[i] == want, (i, v, t)


def test_nothing_to_find(spark):
    l = spark.createDataFrame([(1, "a", T0)], "i int, v string, t timestamp_ntz")
    r = spark.createDataFrame([], "v string, s timestamp_ntz, x int")
    assert [tuple(x)[3:] for x in nearest_in_time(l, r, ["v"], "t", "s", ["x"]).collect()] == [(None, None)]
    assert nearest_in_time(l.limit(0), r, ["v"], "t", "s", ["x"]).count() == 0


def test_a_long_calendar_takes_one_step_a_row(spark):
    """A frame that shrinks from row to row is counted anew for each: 60,000 times of one venue without a match took minutes."""
    l = spark.range(60_000).selectExpr("id AS i", "'a' AS v", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS t")
    r = spark.createDataFrame([("a", T0 + dt.timedelta(days=30), 7)], "v string, s timestamp_ntz, x int")
    out = nearest_in_time(l, r, ["v"], "t", "s", ["x"])
    assert "UnboundedFollowing" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "unboundedfollowing" not in plan
    assert out.filter("near_x = 7").count() == 60_000
