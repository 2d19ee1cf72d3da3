"""Bet formation, settlement and value (BT*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.functions import bets as B
from formline.functions import columns as C
from formline.operators import inrace as I
from formline.plans.registry import query
from formline.plans.views import R, RR, entries, races, ranked

BETS_SQL = """
, trio AS (
  SELECT DISTINCT a.race_id, list_sort([a.runner_no, s.runner_no, t.runner_no]) AS b
  FROM ranked a JOIN ranked s ON s.race_id = a.race_id AND s.pred_rank IN (2, 3) JOIN ranked t ON t.race_id = a.race_id AND t.pred_rank BETWEEN 2 AND 6 AND t.pred_rank <> s.pred_rank
  WHERE a.pred_rank = 1 AND a.field >= 3
),
pairs AS (
  SELECT DISTINCT a.race_id, list_sort([a.runner_no, s.runner_no]) AS b FROM ranked a JOIN ranked s ON s.race_id = a.race_id AND s.pred_rank IN (2, 3) WHERE a.pred_rank = 1 AND a.field >= 3
),
text3 AS (SELECT race_id, string_agg(b[1] || '-' || b[2] || '-' || b[3], '; ' ORDER BY b) AS txt, count(*) AS n FROM trio GROUP BY 1),
text2 AS (SELECT race_id, string_agg(b[1] || '-' || b[2], '; ' ORDER BY b) AS txt, count(*) AS n FROM pairs GROUP BY 1)
"""


@query("bt1_trio_bets", R + BETS_SQL + "SELECT race_id, n AS bets, txt AS trio_bets FROM text3")
def bt1(spark: SparkSession, sf: str) -> DataFrame:
    return races(spark, sf).select("race_id", F.size("trio_bets").cast("bigint").alias("bets"), B.bets_to_text(F.col("trio_bets")).alias("trio_bets"))


@query("bt2_pair_bets", R + BETS_SQL + "SELECT race_id, n AS bets, txt AS pair_bets FROM text2")
def bt2(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.array_sort("pair_bets")
    return races(spark, sf).select("race_id", F.size(pairs).cast("bigint").alias("bets"), B.bets_to_text(pairs).alias("pair_bets"))


@query("bt3_bets_by_class", RR + BETS_SQL + """
SELECT r.race_id, CASE WHEN cond_key = 'E' THEN 'umaren' ELSE 'trio' END AS ticket, CASE WHEN cond_key = 'E' THEN text2.txt ELSE text3.txt END AS bets
FROM races r JOIN text3 ON text3.race_id = r.race_id JOIN text2 ON text2.race_id = r.race_id
""")
def bt3(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("cond_key")
    return races(spark, sf).select(
        "race_id", B.ticket_of_class(key).alias("ticket"), B.bets_to_text(F.array_sort(B.bets_for_class(key, F.col("picks")))).alias("bets")
    )


@query("bt3_regional_bets", RR + BETS_SQL + """
, k AS (
  SELECT race_id, CASE WHEN distance >= 1600 THEN CASE WHEN num_horses <= 7 THEN 'E' WHEN num_horses >= 15 THEN 'C' WHEN going >= 2 THEN 'B' ELSE 'A' END
         WHEN num_horses <= 4 THEN 'D' WHEN num_horses <= 7 THEN 'F' ELSE 'G' END AS cond_key FROM races
)
SELECT k.race_id, cond_key, CASE WHEN cond_key IN ('A', 'B') THEN 'trio' WHEN cond_key = 'E' THEN 'umaren' ELSE 'wide' END AS ticket,
       CASE WHEN cond_key IN ('A', 'B') THEN text3.txt ELSE text2.txt END AS bets, cond_key NOT IN ('C', 'G') AS recommended
FROM k JOIN text3 ON text3.race_id = k.race_id JOIN text2 ON text2.race_id = k.race_id
""")
def bt3_regional(spark: SparkSession, sf: str) -> DataFrame:
    r = races(spark, sf).withColumn("cond_key", C.classify_regional_race(F.col("num_horses"), F.col("distance"), F.col("going") >= 2))
    ticket, bets, buy = B.regional_bets(F.col("cond_key"), F.col("picks"))
    return r.select("race_id", "cond_key", ticket.alias("ticket"), B.bets_to_text(F.array_sort(bets)).alias("bets"), buy.alias("recommended"))


@query("bt4_bet_text_codec", RR + """
SELECT race_id, least(f1, f2, f3) || '-' || (f1 + f2 + f3 - least(f1, f2, f3) - greatest(f1, f2, f3)) || '-' || greatest(f1, f2, f3) AS combo,
       CAST(wide0 + wide1 + wide2 AS BIGINT) AS wide_total, CASE WHEN race_id % 7 = 0 THEN 0 ELSE 3 END AS wide_pairs
FROM (SELECT race_id, f1, f2, f3, CASE WHEN race_id % 7 = 0 THEN NULL ELSE wide0 END AS wide0, wide1, wide2 FROM races)
""")
def bt4(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda *c: F.concat_ws("-", *[F.col(x).cast("string") for x in c])
    r = races(spark, sf).selectExpr("*", "order3[0] AS f1", "order3[1] AS f2", "order3[2] AS f3")
    nums = F.concat_ws("/", text("f2", "f1"), text("f1", "f3"), text("f3", "f2"))
    # Every seventh text is damaged and must come out as unknown.
    pays = F.concat_ws("/", F.when(F.col("race_id") % 7 == 0, "x").otherwise(F.col("wide0").cast("string")), *[F.col(c).cast("string") for c in ("wide1", "wide2")])
    wide = B.wide_pays_from_text(nums, pays)
    return r.select(
        "race_id", F.array_join(F.transform(B.bet_from_text(text("f3", "f1", "f2"), 3), lambda x: x.cast("string")), "-").alias("combo"),
        F.aggregate(wide, F.lit(0).cast("bigint"), lambda a, x: a + x["yen"]).alias("wide_total"),
        F.coalesce(F.size(wide), F.lit(0)).cast("int").alias("wide_pairs"),
    )


@query("bt5_settle_equal", RR + "SELECT race_id, trio_hit, umaren_hit, wide_hits FROM races")
def bt5(spark: SparkSession, sf: str) -> DataFrame:
    return races(spark, sf).select("race_id", "trio_hit", "umaren_hit", "wide_hits")


@query("bt6_settle_dead_heats", R + BETS_SQL + """
, d AS (SELECT race_id, count(*) AS placed, list_sort(list(runner_no)) AS top FROM ranked WHERE field >= 3 AND CASE WHEN finish = 4 AND race_id % 3 = 0 THEN 3 ELSE finish END <= 3 GROUP BY 1),
h AS (SELECT d.race_id, placed, max(CASE WHEN list_has_all(top, b) THEN 1 ELSE 0 END) AS any_subset, max(CASE WHEN top = b THEN 1 ELSE 0 END) AS any_equal FROM d JOIN trio ON trio.race_id = d.race_id GROUP BY ALL)
SELECT race_id, placed, any_subset = 1 AS hit_subset, any_equal = 1 AS hit_equal, CASE WHEN placed = 3 THEN any_equal = 1 END AS hit_skip FROM h
""")
def bt6(spark: SparkSession, sf: str) -> DataFrame:
    # A dead heat for third in every third race: the runner in fourth shares the place.
    r = ranked(entries(spark, sf)).filter("field >= 3").withColumn("place", F.expr("CASE WHEN finish = 4 AND race_id % 3 = 0 THEN 3 ELSE finish END"))
    race = r.groupBy("race_id").agg(
        F.expr("transform(sort_array(collect_list(CASE WHEN pred_rank <= 6 THEN struct(pred_rank, runner_no) END)), x -> x.runner_no)").alias("picks"),
        F.expr("sort_array(collect_list(CASE WHEN place <= 3 THEN runner_no END))").alias("top"),
    )
    bets, top = B.trio_bets(F.col("picks")), F.col("top")
    return race.select(
        "race_id", F.size("top").cast("bigint").alias("placed"), B.has_hit(bets, top, "subset").alias("hit_subset"),
        B.has_hit(bets, top, "equal").alias("hit_equal"), B.has_hit(bets, top, "skip").alias("hit_skip"),
    )


@query("bt7_estimate_payouts", RR + "SELECT race_id, est_trio, est_umaren, est_wide0, est_wide1, est_wide2, est_wide_return FROM races")
def bt7(spark: SparkSession, sf: str) -> DataFrame:
    return races(spark, sf).select("race_id", "est_trio", "est_umaren", "est_wide0", "est_wide1", "est_wide2", "est_wide_return")


@query("bt8_actual_returns", RR + "SELECT race_id, trio_return, umaren_return, wide_return FROM races WHERE has_payout = 1")
def bt8(spark: SparkSession, sf: str) -> DataFrame:
    return races(spark, sf).filter("has_payout = 1").select("race_id", "trio_return", "umaren_return", "wide_return")


@query("bt9_five_tickets", RR + "SELECT race_id, tansho_hit, tierce_hit, tansho_return, umaren_return, wide_return, trio_return, tierce_return FROM races")
def bt9(spark: SparkSession, sf: str) -> DataFrame:
    return races(spark, sf).select("race_id", "tansho_hit", "tierce_hit", *[f"{t}_return" for t in ("tansho", "umaren", "wide", "trio", "tierce")])


@query("bt10_combined_ticket", RR + """
SELECT race_id, CAST(umaren_hit = 1 OR wide_hit = 1 AS BIGINT) AS combo_hit, CAST(floor(umaren_hit * umaren_yen * 2.5::DOUBLE) AS BIGINT) + CAST(floor((w0 * wide0 + w1 * wide1 + w2 * wide2) * 2.5::DOUBLE) AS BIGINT) AS combo_return,
       700 // greatest(CASE field WHEN 3 THEN 1 WHEN 4 THEN 3 WHEN 5 THEN 5 ELSE 7 END, 1) AS unit FROM races
""")
def bt10(spark: SparkSession, sf: str) -> DataFrame:
    return races(spark, sf).selectExpr(
        "race_id", "CAST(umaren_hit = 1 OR wide_hit = 1 AS BIGINT) AS combo_hit",
        "floor(umaren_hit * umaren_yen * 2.5D) + floor((w0 * wide0 + w1 * wide1 + w2 * wide2) * 2.5D) AS combo_return",
        "CAST(700 div greatest(size(trio_bets), 1) AS INT) AS unit",
    )


@query("bt11_stake_split", R + """
, p AS (SELECT race_id, max(CASE WHEN pred_rank = 2 THEN CASE WHEN race_id % 9 = 0 THEN 0.0::DOUBLE ELSE odds END END) AS a, max(CASE WHEN pred_rank = 3 THEN odds END) AS b FROM ranked WHERE field >= 3 GROUP BY 1)
SELECT race_id, CAST(CASE WHEN a <= 0 OR b <= 0 THEN 350 WHEN a >= b THEN 400 ELSE 300 END AS BIGINT) AS stake_a, CAST(CASE WHEN a <= 0 OR b <= 0 THEN 350 WHEN a >= b THEN 300 ELSE 400 END AS BIGINT) AS stake_b FROM p
""")
def bt11(spark: SparkSession, sf: str) -> DataFrame:
    odds = lambda k: F.max(F.when(F.col("pred_rank") == k, F.col("odds")))
    p = ranked(entries(spark, sf)).filter("field >= 3").groupBy("race_id").agg(odds(2).alias("a"), odds(3).alias("b"))
    a, b = B.stake_split_by_odds(F.when(F.col("race_id") % 9 == 0, 0.0).otherwise(F.col("a")), F.col("b"))
    return p.select("race_id", a.alias("stake_a"), b.alias("stake_b"))


@query("bt12_expected_values", R + """
, s AS (SELECT race_id, runner_no, pred_rank, odds, score / sum(score) OVER (PARTITION BY race_id) AS p FROM ranked WHERE field >= 3),
c AS (SELECT *, least(p * 3.0::DOUBLE, 0.85::DOUBLE) AS q FROM s WHERE pred_rank <= 6)
SELECT race_id, 'win' AS kind, CAST(runner_no AS VARCHAR) AS runners, CAST(CAST(least(p * 1.5::DOUBLE, 0.6::DOUBLE) AS FLOAT) AS DOUBLE) AS prob, CAST(CAST(least(p * 1.5::DOUBLE, 0.6::DOUBLE) * odds AS FLOAT) AS DOUBLE) AS ev FROM c WHERE odds > 0
UNION ALL SELECT a.race_id, 'wide', least(a.runner_no, b.runner_no) || '-' || greatest(a.runner_no, b.runner_no), CAST(CAST(a.q * b.q * 0.8::DOUBLE AS FLOAT) AS DOUBLE), 0.0::DOUBLE FROM c a JOIN c b ON a.race_id = b.race_id AND a.pred_rank < b.pred_rank AND b.pred_rank <= 3
UNION ALL SELECT a.race_id, 'trio', array_to_string(list_sort([a.runner_no, b.runner_no, d.runner_no]), '-'), CAST(CAST(a.q * b.q * d.q * 0.6::DOUBLE AS FLOAT) AS DOUBLE), 0.0::DOUBLE
  FROM c a JOIN c b ON a.race_id = b.race_id AND a.pred_rank = 1 AND b.pred_rank IN (2, 3) JOIN c d ON d.race_id = a.race_id AND d.pred_rank > b.pred_rank
""")
def bt12(spark: SparkSession, sf: str) -> DataFrame:
    s = ranked(entries(spark, sf)).filter("field >= 3").withColumn("p", I.share(["race_id"], "score")).filter("pred_rank <= 6")
    # At most six picks per race.
    race = s.groupBy("race_id").agg(F.expr("sort_array(collect_list(struct(pred_rank AS r, runner_no AS u, odds AS o, p, least(p * 3.0D, 0.85D) AS q)))").alias("t"))
    rows = """inline(concat(
        transform(filter(t, a -> a.o > 0), a -> struct('win' AS kind, array(a.u) AS us, least(a.p * 1.5D, 0.6D) AS prob, least(a.p * 1.5D, 0.6D) * a.o AS ev)),
        flatten(transform(t, a -> transform(filter(t, b -> a.r < b.r AND b.r <= 3),
            b -> struct('wide' AS kind, array(a.u, b.u) AS us, a.q * b.q * 0.8D AS prob, 0.0D AS ev)))),
        flatten(transform(filter(t, b -> b.r IN (2, 3)), b -> transform(filter(t, d -> d.r > b.r),
            d -> struct('trio' AS kind, array(t[0].u, b.u, d.u) AS us, t[0].q * b.q * d.q * 0.6D AS prob, 0.0D AS ev))))))"""
    return race.selectExpr("race_id", rows).selectExpr("race_id", "kind", "array_join(array_sort(us), '-') AS runners", "CAST(CAST(prob AS FLOAT) AS DOUBLE) AS prob", "CAST(CAST(ev AS FLOAT) AS DOUBLE) AS ev")


EV_SQL = BETS_SQL + """
, s AS (SELECT race_id, runner_no, odds, score / sum(score) OVER (PARTITION BY race_id) AS p FROM ranked WHERE field >= 3),
t3 AS (SELECT t.race_id, sum(least(a.p * b.p * c.p * 6.0::DOUBLE * 20.0::DOUBLE, 0.3::DOUBLE) * greatest(100.0::DOUBLE, a.odds * b.odds * c.odds * 20.0::DOUBLE)) / 700.0::DOUBLE AS ev
  FROM trio t JOIN s a ON a.race_id = t.race_id AND a.runner_no = t.b[1] JOIN s b ON b.race_id = t.race_id AND b.runner_no = t.b[2] JOIN s c ON c.race_id = t.race_id AND c.runner_no = t.b[3] GROUP BY 1),
t2 AS (SELECT t.race_id, sum(least(a.p * b.p * 2.0::DOUBLE * 15.0::DOUBLE, 0.5::DOUBLE) * greatest(100.0::DOUBLE, a.odds * b.odds * 50.0::DOUBLE)) / 700.0::DOUBLE AS ev
  FROM pairs t JOIN s a ON a.race_id = t.race_id AND a.runner_no = t.b[1] JOIN s b ON b.race_id = t.race_id AND b.runner_no = t.b[2] GROUP BY 1),
ev AS (SELECT t3.race_id, round(t3.ev, 6) AS trio_ev, round(t2.ev, 6) AS umaren_ev FROM t3 JOIN t2 ON t3.race_id = t2.race_id)
"""


def race_values(spark: SparkSession, sf: str) -> DataFrame:
    """Expected return ratio of the trio and the pair bets of each race."""
    s = ranked(entries(spark, sf)).filter("field >= 3").withColumn("p", I.share(["race_id"], "score")).filter("pred_rank <= 6")
    race = s.groupBy("race_id").agg(F.expr("sort_array(collect_list(struct(pred_rank AS r, runner_no AS u, odds AS o, p)))").alias("t"))
    race = race.withColumn("picks", F.col("t.u"))
    pick = F.expr("map_from_entries(transform(t, x -> struct(x.u, x)))")
    race = race.withColumn("m", pick)

    def value(bets, size):
        at = lambda b, i: F.element_at(F.col("m"), F.get(b, F.lit(i)))
        def one(b):
            x = [at(b, i) for i in range(size)]
            if size == 3:
                return B.trio_bet_value(x[0]["p"], x[1]["p"], x[2]["p"], x[0]["o"], x[1]["o"], x[2]["o"])
            return B.umaren_bet_value(x[0]["p"], x[1]["p"], x[0]["o"], x[1]["o"])
        return F.aggregate(bets, F.lit(0.0), lambda acc, b: acc + one(b)) / 700.0

    return race.select(
        "race_id", F.round(value(B.trio_bets(F.col("picks")), 3), 6).alias("trio_ev"), F.round(value(B.pair_bets(F.col("picks")), 2), 6).alias("umaren_ev")
    )


@query("bt13_race_value_ratio", R + EV_SQL + "SELECT * FROM ev")
def bt13(spark: SparkSession, sf: str) -> DataFrame:
    return race_values(spark, sf)
