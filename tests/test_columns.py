"""Golden cases of the scalar encodings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from formline.functions import bets as B
from formline.functions import columns as C


def values(spark, df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_race_classes(spark):
    cases = [(12, 1800, False, "A"), (10, 2000, True, "B"), (16, 1600, False, "C"), (12, 1200, False, "D"), (6, 1800, False, "E"), (16, 2000, True, "X"), (10, 1500, False, "X"), (8, 1400, True, "D")]
    df = spark.createDataFrame(cases, "n int, d int, h boolean, want string")
    got = values(spark, df, C.classify_race(F.col("n"), F.col("d"), F.col("h")), "want")
    assert all(a == b for a, b in got)


@pytest.mark.parametrize("name,value,code", [("distance", 1200, 0), ("distance", 1201, 1), ("distance", 1400, 1), ("distance", 1800, 2), ("distance", 2200, 3), ("distance", 2201, 4), ("distance", 0, 2), ("rest", 6, 0), ("rest", 7, 1), ("bracket", 3, 0), ("bracket", 9, 1), ("weight", None, 1)])
def test_bins_are_right_closed(spark, name, value, code):
    df = spark.createDataFrame([(value,)], "v int")
    assert values(spark, df, C.cut_named("v", name)) == [(code,)]


def test_coerce_and_clip_keep_null_rules(spark):
    df = spark.createDataFrame([("3.0",), ("x",), (None,), ("NaN",)], "t string")
    assert values(spark, df, C.to_long("t"), C.to_double("t", 5.0)) == [(3, 3.0), (None, 5.0), (None, 5.0), (None, 5.0)]
    d = spark.createDataFrame([(1000.0,), (None,)], "v double")
    assert values(spark, d, C.clip("v", 1.0, 999.0)) == [(999.0,), (None,)]


def test_keys_and_dates(spark):
    df = spark.createDataFrame([(6, 24, 2, 10, 11)], "c int, y int, k int, n int, r int")
    key8 = C.race_key_from_parts(*[F.col(c) for c in "cyknr"])
    assert values(spark, df, key8, C.race_key12(key8)) == [("06242A11", "202406021011")]
    d = spark.createDataFrame([(24, 2, 29), (23, 2, 29)], "y int, m int, d int")
    got = values(spark, d, C.real_date(C.full_year(F.col("y")), F.col("m"), F.col("d")))
    assert got == [(dt.date(2024, 2, 29),), (None,)]


def test_text_fields(spark):
    df = spark.createDataFrame([("480(+4)",), ("計不",)], "t string")
    a, b = C.parse_weight(F.col("t"))
    assert values(spark, df, a, b) == [(480, 4), (None, None)]
    w = spark.createDataFrame([("北北東の風 やや強く",), ("南の風",), ("",)], "t string")
    assert values(spark, w, C.wind_speed(F.col("t")), C.wind_direction(F.col("t"))) == [(10.0, "北北東"), (4.0, "南"), (None, None)]


def test_lap_pace(spark):
    df = spark.createDataFrame([([12.0, 11.0, 12.5, 13.0],), ([13.0, 13.0, 11.0, 11.0],), ([12.0, 12.0, 12.0],), ([12.0, 12.0, 12.0, 12.0, 0.5],)], "a array<double>")
    assert values(spark, df, C.lap_pace(F.col("a"))) == [("S",), ("H",), (None,), ("M",)]


def test_going_as_text(spark):
    cases = [("良", "A", "A"), ("稍", "A", "A"), ("稍重", "B", "A"), ("重", "B", "B"), ("不良", "B", "A"), ("", "A", "X"), (None, "A", "X")]
    df = spark.createDataFrame(cases, "g string, plain string, strict string")
    n, d = F.lit(12), F.lit(1800)
    got = values(spark, df, C.classify_race_by_text(n, d, F.col("g")), "plain", C.classify_race_by_text(n, d, F.col("g"), strict=True), "strict")
    assert all(a == b and c == e for a, b, c, e in got)


def test_sire_score(spark):
    from formline.operators import scoring as S

    df = spark.createDataFrame([("ロードカナロア", 1200), ("nobody", 1200), (None, 2400)], "father string, distance int")
    got = {r["father"]: r["sire_score"] for r in S.sire_score(df, S.sire_fit_table(spark), F.lit(True)).collect()}
    assert got == {"ロードカナロア": 0.95, "nobody": 0.5, None: 0.5}


def test_regional_classes_and_bets(spark):
    cases = [(7, 1600, False, "E"), (8, 1600, False, "A"), (14, 2000, True, "B"), (8, 1800, None, "A"), (15, 1600, True, "C"),
             (4, 1599, False, "D"), (5, 1400, True, "F"), (8, 1000, False, "G"), (None, 1600, False, "X"), (None, 1200, False, "G")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n int, d int, h boolean, want string")
    df = df.withColumn("key", C.classify_regional_race(F.col("n"), F.col("d"), F.col("h")))
    ticket, bets, buy = B.regional_bets(F.col("key"), F.array(*[F.lit(x).cast("bigint") for x in (5, 3, 9, 1, 7, 2)]))
    rows = df.select("key", "want", ticket.alias("t"), F.size(bets).alias("n"), buy.alias("buy")).collect()
    assert all(r["key"] == r["want"] for r in rows)
    assert {r["key"]: (r["t"], r["n"]) for r in rows} == {k: ("trio", 7) for k in "ABX"} | {k: ("wide", 2) for k in "CDFG"} | {"E": ("umaren", 2)}
    assert {r["key"] for r in rows if r["buy"]} == set("ABDEF")
