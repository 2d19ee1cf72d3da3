"""Golden cases of bets and settlement."""

from pyspark.sql import functions as F

from formline.functions import bets as B


def one(spark, row, schema, col):
    return spark.createDataFrame([row], schema).select(col.alias("x")).first()["x"]


def test_seven_trio_bets(spark):
    got = one(spark, ([5, 6, 2, 4, 7, 8],), "p array<bigint>", B.bets_to_text(B.trio_bets(F.col("p"))))
    assert got == "2-4-5; 2-5-6; 2-5-7; 2-5-8; 4-5-6; 5-6-7; 5-6-8"


def test_bet_counts(spark):
    for n, want in ((18, 7), (6, 7), (3, 1), (2, 0)):
        assert one(spark, (list(range(1, n + 1)),), "p array<bigint>", F.size(B.trio_bets(F.slice("p", 1, 6)))) == want
    assert one(spark, ([4, 9],), "p array<bigint>", F.size(B.pair_bets(F.col("p")))) == 0


def test_text_codec_and_hits(spark):
    hit = lambda text, top: one(spark, (text, top), "t string, p array<bigint>", B.has_hit(B.bets_from_text(F.col("t")), F.col("p")))
    assert hit("1-3-5; 1-3-7; 1-5-7", [1, 3, 5]) is True
    assert hit("1-3-5; 1-3-7; 1-5-7", [2, 4, 6]) is False
    assert hit("5-3-1", [1, 3, 5]) is True
    assert hit("5-3-x; 1-2-3", [3, 2, 1]) is True
    assert one(spark, ("[[3,1,2]]",), "t string", B.bets_from_json(F.col("t"))) == [[1, 2, 3]]


def test_wide_text(spark):
    got = one(spark, ("3-7/7-15/3-15", "360/780/1040"), "n string, p string", B.wide_pays_from_text(F.col("n"), F.col("p")))
    assert [(list(x["combo"]), x["yen"]) for x in got] == [([3, 7], 360), ([7, 15], 780), ([3, 15], 1040)]
    assert one(spark, ("3-7/7-15", "360"), "n string, p string", B.wide_pays_from_text(F.col("n"), F.col("p"))) is None


def test_pairs_and_dead_heat(spark):
    pairs = B.pair_bets(F.col("p"))
    hit = lambda top: one(spark, ([3, 7, 1], top), "p array<bigint>, t array<bigint>", B.has_hit(pairs, F.col("t"), places=2))
    assert [hit([3, 7]), hit([1, 3]), hit([5, 9])] == [True, True, False]
    # four runners placed: the subset rule pays, equality does not, skip leaves the race out
    args = ([1, 2, 3], [1, 2, 3, 9]), "p array<bigint>, t array<bigint>"
    trio = B.trio_bets(F.col("p"))
    assert one(spark, *args, B.has_hit(trio, F.col("t"), "subset")) is True
    assert one(spark, *args, B.has_hit(trio, F.col("t"), "equal")) is False
    assert one(spark, *args, B.has_hit(trio, F.col("t"), "skip")) is None


def test_stakes(spark):
    cases = [(5, 3, 400, 300), (3, 5, 300, 400), (4, 4, 400, 300), (0, 3, 350, 350), (5, 0, 350, 350), (0, 0, 350, 350)]
    df = spark.createDataFrame([(float(a), float(b), c, d) for a, b, c, d in cases], "a double, b double, c bigint, d bigint")
    x, y = B.stake_split_by_odds(F.col("a"), F.col("b"))
    assert all((r[0], r[1]) == (r[2], r[3]) for r in df.select(x, y, "c", "d").collect())


def test_estimates_and_wilson(spark):
    assert one(spark, (2.5, 3.0, 4.1), "a double, b double, c double", B.estimate_trio(F.col("a"), F.col("b"), F.col("c"))) == int(2.5 * 3.0 * 4.1 * 20)
    assert one(spark, (1.0, 1.0), "a double, b double", B.estimate_wide(F.col("a"), F.col("b"))) == 100
    low, high = B.wilson(F.col("h"), F.col("n"))
    assert abs(one(spark, (45, 100), "h int, n int", low) - 0.35607) < 1e-4
    assert abs(one(spark, (45, 100), "h int, n int", high) - 0.54756) < 1e-4
