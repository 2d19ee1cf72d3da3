"""Scores and their adjustment (SC*, AG38, AG39)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.functions import columns as C
from formline.operators import inrace as I
from formline.operators import scoring as S
from formline.plans.registry import query
from formline.plans.views import E, entries

ROW = ["race_id", "runner_no"]
D = "::DOUBLE"

STYLED = E + """
, st AS (SELECT *, CASE WHEN pass4 <= 2 THEN 1 WHEN pass4 <= 4 THEN 2 WHEN pass4 <= 6 THEN 3 ELSE 4 END AS style,
  least(8, greatest(1, (runner_no - 1) * 8 // greatest(field, 1) + 1)) AS bracket FROM entries)
"""


def styled(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("pass4")
    return entries(spark, sf).withColumns({
        "style": F.when(p <= 2, 1).when(p <= 4, 2).when(p <= 6, 3).otherwise(4).cast("bigint"),
        "bracket": C.bracket(F.col("runner_no"), F.col("field")),
    })


def components(spark: SparkSession, sf: str) -> dict:
    return {
        "ai": F.col("score"), "odds": S.odds_score(F.col("odds")), "agari": S.last3f_score(F.col("last3f")), "jockey": S.jockey_score(F.col("carry") / 300.0),
        "pop": F.lit(0.4), "apt": F.lit(0.6), "course": F.lit(0.55), "other": F.lit(0.45), "time": F.lit(0.7),
    }


@query("sc1_blended_score", E + f"""
, c AS (SELECT race_id, runner_no, score AS ai, least(1.0{D}, greatest(0.0{D}, 1.0{D} - ln(1.0{D} + odds) / ln(101.0{D}))) AS o, least(1.0{D}, greatest(0.0{D}, 1.0{D} - (last3f - 33.0{D}) / 5.0{D})) AS a,
  least(1.0{D}, greatest(0.0{D}, carry / 300.0{D} / 0.18{D})) AS j FROM entries)
SELECT race_id, runner_no, round(ai * 0.65{D} + o * 0.08{D} + 0.6{D} * 0.06{D} + 0.5{D} * 0.06{D} + a * 0.05{D} + 0.55{D} * 0.04{D} + 0.45{D} * 0.03{D} + 0.4{D} * 0.03{D}, 9) AS with_odds,
  round(ai * 0.45{D} + 0.4{D} * 0.15{D} + 0.6{D} * 0.1{D} + 0.5{D} * 0.1{D} + a * 0.1{D} + 0.55{D} * 0.05{D} + 0.45{D} * 0.05{D}, 9) AS base,
  round(ai * 0.27{D} + 0.4{D} * 0.13{D} + 0.5{D} * 0.18{D} + a * 0.08{D} + j * 0.1{D} + 0.6{D} * 0.08{D} + 0.7{D} * 0.08{D} + 0.55{D} * 0.04{D} + 0.45{D} * 0.04{D}, 9) AS regional FROM c
""")
def sc1(spark: SparkSession, sf: str) -> DataFrame:
    parts = components(spark, sf)
    score = lambda v: F.round(S.blend(parts, v), 9)
    return entries(spark, sf).select(*ROW, score("v9_odds").alias("with_odds"), score("base").alias("base"), score("regional").alias("regional"))


@query("sc2_going_adjustment", STYLED + f"""
, m AS (SELECT race_id, runner_no, CASE WHEN going > 0 THEN score + CASE style WHEN 1 THEN 0.015{D} WHEN 2 THEN 0.02{D} WHEN 3 THEN -0.005{D} ELSE -0.02{D} END * going - CASE WHEN last3f / 120.0{D} < 0.3{D} THEN 0.01{D} * going ELSE 0.0{D} END ELSE score END AS s FROM st)
SELECT race_id, runner_no, round(s, 9) AS adjusted, CAST(floor(rank() OVER (PARTITION BY race_id ORDER BY round(s, 6) DESC) + (count(*) OVER (PARTITION BY race_id, round(s, 6)) - 1) / 2.0{D}) AS BIGINT) AS ai_rank FROM m
""")
def sc2(spark: SparkSession, sf: str) -> DataFrame:
    s = S.going_adjusted(F.col("score"), F.col("style"), F.col("last3f") / 120.0, F.lit(0), F.col("going"))
    out = styled(spark, sf).withColumn("s", s).withColumn("r", F.round("s", 6))
    return out.select(*ROW, F.round("s", 9).alias("adjusted"), I.average_rank_floor(["race_id"], "r").alias("ai_rank"))


@query("sc3_pace_advantage", E + f"""
, h AS (SELECT DISTINCT race_id, distance, surface, going, num_horses, course FROM entries),
p AS (SELECT race_id,
  0.5{D} + CASE WHEN course >= 5 THEN 0.15{D} ELSE 0.0{D} END + CASE WHEN surface = 1 THEN 0.1{D} WHEN distance <= 1400 THEN 0.15{D} WHEN distance >= 2400 THEN -0.1{D} ELSE 0.0{D} END + CASE WHEN going >= 2 THEN 0.05{D} ELSE 0.0{D} END + CASE WHEN num_horses <= 10 THEN 0.1{D} WHEN num_horses >= 16 THEN -0.05{D} ELSE 0.0{D} END AS s1,
  0.5{D} + CASE WHEN course >= 5 THEN 0.2{D} ELSE 0.0{D} END + CASE WHEN surface = 1 THEN 0.15{D} WHEN distance <= 1400 THEN 0.1{D} ELSE 0.0{D} END + CASE WHEN going >= 2 THEN 0.08{D} WHEN going = 1 THEN 0.04{D} ELSE 0.0{D} END + CASE WHEN num_horses <= 10 THEN 0.05{D} ELSE 0.0{D} END AS s2,
  0.5{D} + CASE WHEN course >= 5 THEN -0.05{D} ELSE 0.0{D} END + CASE WHEN surface = 1 THEN -0.05{D} WHEN distance <= 1400 THEN -0.05{D} WHEN distance >= 2400 THEN 0.1{D} ELSE 0.0{D} END + CASE WHEN num_horses >= 16 THEN 0.08{D} ELSE 0.0{D} END AS s3,
  0.5{D} + CASE WHEN course >= 5 THEN -0.2{D} ELSE 0.0{D} END + CASE WHEN surface = 1 THEN -0.15{D} WHEN distance <= 1400 THEN -0.2{D} WHEN distance >= 2400 THEN 0.05{D} ELSE 0.0{D} END + CASE WHEN going >= 2 THEN -0.1{D} WHEN going = 1 THEN -0.05{D} ELSE 0.0{D} END + CASE WHEN num_horses <= 10 THEN -0.1{D} WHEN num_horses >= 16 THEN 0.05{D} ELSE 0.0{D} END AS s4 FROM h),
u AS (SELECT race_id, 1 AS k, round(s1, 6) AS s FROM p UNION ALL SELECT race_id, 2, round(s2, 6) FROM p UNION ALL SELECT race_id, 3, round(s3, 6) FROM p UNION ALL SELECT race_id, 4, round(s4, 6) FROM p)
SELECT race_id, string_agg(CAST(k AS VARCHAR), '' ORDER BY s DESC, k) AS styles, max(CASE WHEN k = 1 THEN s END) AS leader FROM u GROUP BY 1
""")
def sc3(spark: SparkSession, sf: str) -> DataFrame:
    h = entries(spark, sf).filter("runner_no = 1")
    adv = S.pace_advantage(F.col("distance"), F.col("surface") == 1, F.col("going"), F.col("num_horses"), F.col("course") >= 5)
    return h.select("race_id", S.rank_styles(adv).alias("styles"), F.round(adv[1], 6).alias("leader"))


PACE_SQL = STYLED + """
, rc AS (SELECT race_id, max(field) AS n, max(distance) AS d, count(*) FILTER (style = 1) AS l, count(*) FILTER (style = 2) AS s FROM st GROUP BY 1),
b AS (SELECT *, CASE WHEN l >= 3 OR (l >= 2 AND (l + s) / CAST(greatest(n, 1) AS DOUBLE) >= 0.55::DOUBLE) THEN 'high' WHEN l >= 2 AND d <= 1400 THEN 'high' WHEN l <= 1 AND (l + s) / CAST(greatest(n, 1) AS DOUBLE) <= 0.35::DOUBLE THEN 'slow' WHEN l = 0 THEN 'slow' ELSE 'middle' END AS p0 FROM rc),
pace AS (SELECT race_id, l AS leaders, s AS stalkers, CASE WHEN p0 = 'middle' AND d >= 2400 AND l <= 1 THEN 'slow' WHEN p0 = 'middle' AND d <= 1200 AND l >= 2 THEN 'high' ELSE p0 END AS pace FROM b)
"""


def paces(spark: SparkSession, sf: str) -> DataFrame:
    race = styled(spark, sf).groupBy("race_id").agg(
        F.max("field").alias("n"), F.max("distance").alias("d"), F.count_if(F.col("style") == 1).alias("leaders"), F.count_if(F.col("style") == 2).alias("stalkers")
    )
    return race.select("race_id", "leaders", "stalkers", S.race_pace(F.col("leaders"), F.col("stalkers"), F.col("n"), F.col("d")).alias("pace"))


@query("ag38_race_pace", PACE_SQL + "SELECT * FROM pace")
def ag38(spark: SparkSession, sf: str) -> DataFrame:
    return paces(spark, sf)


@query("sc3_pace_adjusted_score", PACE_SQL + f"""
SELECT race_id, runner_no, round(score + CASE pace WHEN 'high' THEN CASE style WHEN 1 THEN -0.025{D} WHEN 2 THEN -0.01{D} WHEN 3 THEN 0.02{D} ELSE 0.025{D} END
  WHEN 'slow' THEN CASE style WHEN 1 THEN 0.025{D} WHEN 2 THEN 0.02{D} WHEN 3 THEN -0.01{D} ELSE -0.025{D} END ELSE CASE style WHEN 1 THEN 0.005{D} WHEN 2 THEN 0.01{D} WHEN 3 THEN 0.005{D} ELSE -0.01{D} END END, 9) AS adjusted
FROM st JOIN pace USING (race_id)
""")
def sc3_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    out = styled(spark, sf).join(paces(spark, sf), "race_id")
    return out.select(*ROW, F.round(F.col("score") + S.pace_adjustment(F.col("pace"), F.col("style")), 9).alias("adjusted"))


BIAS_SQL = STYLED + f"""
, bi AS (SELECT course, race_date, avg(CASE WHEN pass4 BETWEEN 1 AND 3 THEN finish END) AS ff, avg(CASE WHEN pass4 >= 6 THEN finish END) AS bf, avg(CASE WHEN pass4 BETWEEN 1 AND 3 THEN CAST(is_top3 AS DOUBLE) END) AS fr, avg(CASE WHEN pass4 >= 6 THEN CAST(is_top3 AS DOUBLE) END) AS br,
  avg(CASE WHEN bracket BETWEEN 1 AND 3 THEN finish END) AS nf, avg(CASE WHEN bracket >= 6 THEN finish END) AS ofi, avg(CASE WHEN bracket BETWEEN 1 AND 3 THEN CAST(is_top3 AS DOUBLE) END) AS nr, avg(CASE WHEN bracket >= 6 THEN CAST(is_top3 AS DOUBLE) END) AS orr FROM st GROUP BY ALL),
bias AS (SELECT course, race_date, CASE WHEN ff IS NULL OR bf IS NULL THEN 0.0{D} ELSE greatest(-1.0{D}, least(1.0{D}, (bf - ff) * 0.1{D} + (fr - br) * 0.5{D})) END AS front_bias,
  CASE WHEN nf IS NULL OR ofi IS NULL THEN 0.0{D} ELSE greatest(-1.0{D}, least(1.0{D}, (ofi - nf) * 0.1{D} + (nr - orr) * 0.5{D})) END AS inner_bias FROM bi)
"""


@query("ag39_track_bias", BIAS_SQL + "SELECT course, race_date, round(front_bias, 9) AS front_bias, round(inner_bias, 9) AS inner_bias FROM bias")
def ag39(spark: SparkSession, sf: str) -> DataFrame:
    out = S.track_bias(styled(spark, sf), ["course", "race_date"], "pass4", "bracket", "finish")
    return out.select("course", "race_date", F.round("front_bias", 9).alias("front_bias"), F.round("inner_bias", 9).alias("inner_bias"))


@query("sc4_bias_adjustment", BIAS_SQL + f"""
, m AS (SELECT race_id, runner_no, score * CASE WHEN abs(front_bias) > 0.15 THEN 1.0{D} + front_bias * CASE style WHEN 1 THEN 0.04{D} WHEN 2 THEN 0.03{D} WHEN 3 THEN -0.02{D} ELSE -0.04{D} END ELSE 1.0{D} END
  * CASE WHEN abs(inner_bias) > 0.15 THEN 1.0{D} + inner_bias * ((max(bracket) OVER (PARTITION BY race_id) / 2.0{D} - bracket) / (max(bracket) OVER (PARTITION BY race_id) / 2.0{D})) * 0.04{D} ELSE 1.0{D} END AS s FROM st JOIN bias USING (course, race_date))
SELECT race_id, runner_no, CAST(CAST(s AS FLOAT) AS DOUBLE) AS adjusted FROM m
""")
def sc4(spark: SparkSession, sf: str) -> DataFrame:
    rows = styled(spark, sf)
    bias = S.track_bias(rows, ["course", "race_date"], "pass4", "bracket", "finish")
    rows = rows.withColumn("top_bracket", F.max("bracket").over(Window.partitionBy("race_id"))).join(bias, ["course", "race_date"])
    s = S.bias_adjusted(*[F.col(c) for c in ("score", "style", "bracket", "top_bracket", "front_bias", "inner_bias")])
    return rows.select(*ROW, s.cast("float").cast("double").alias("adjusted"))


@query("sc5_routed_score", E + f"""
SELECT race_id, runner_no, CASE WHEN distance <= 1400 THEN 'sprint' WHEN distance <= 2000 THEN 'middle' ELSE 'long' END AS segment,
  CASE WHEN distance <= 1400 THEN score * 0.9{D} + 0.05{D} WHEN distance <= 2000 THEN score ELSE CASE WHEN runner_no % 2 = 0 THEN score * 1.1{D} ELSE score END END AS routed FROM entries
""")
def sc5(spark: SparkSession, sf: str) -> DataFrame:
    score, segment = F.col("score"), C.segment3(F.col("distance"))
    models = {"sprint": score * 0.9 + 0.05, "long": F.when(F.col("runner_no") % 2 == 0, score * 1.1)}
    return entries(spark, sf).select(*ROW, segment.alias("segment"), S.routed(segment, models, score).alias("routed"))
