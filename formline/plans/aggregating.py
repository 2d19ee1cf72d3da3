"""Entity tables and encodings (AG1-AG12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.functions import columns as C
from formline.operators import groups as G
from formline.operators import history as H
from formline.plans.registry import query
from formline.plans.views import E, entries, table

RATES = """count(*) AS races, CAST(sum(is_win) AS BIGINT) AS wins, CAST(sum(is_top3) AS BIGINT) AS top3"""


@query("ag1_entity_history", E + f"""
SELECT jockey_id, course, races, wins, top3, total_prize, CAST(wins AS DOUBLE) / races AS win_rate, CAST(top3 AS DOUBLE) / races AS top3_rate
FROM (SELECT jockey_id, course, {RATES}, round(sum(prize), 3) AS total_prize FROM entries GROUP BY jockey_id, course)
""")
def ag1(spark: SparkSession, sf: str) -> DataFrame:
    return H.entity_history(entries(spark, sf), ["jockey_id", "course"]).withColumn("total_prize", F.round("total_prize", 3))


def _slices_sql(source: str, key: str) -> str:
    conds = {"turf": "surface = 0", "dirt": "surface = 1", "sprint": "distance <= 1400", "mile": "distance > 1400 AND distance <= 1800",
             "middle": "distance > 1800 AND distance <= 2200", "long": "distance > 2200"}
    cols = []
    for s, c in conds.items():
        n, t = f"count(*) FILTER ({c})", f"coalesce(sum(is_top3) FILTER ({c}), 0)"
        cols.append(f"{n} AS {s}_races, CAST(coalesce(sum(is_win) FILTER ({c}), 0) AS BIGINT) AS {s}_wins, CAST({t} AS BIGINT) AS {s}_top3, CAST({t} AS DOUBLE) / greatest({n}, 1) AS {s}_rate")
    return f"SELECT {key}, " + ", ".join(cols) + f" FROM {source} GROUP BY {key}"


@query("ag2_breakdown", E + _slices_sql("entries", "trainer_id"))
def ag2(spark: SparkSession, sf: str) -> DataFrame:
    return H.breakdown(entries(spark, sf), ["trainer_id"], H.standard_slices())


@query("ag3_progeny", E + f"""
, f AS (SELECT father, {RATES} FROM entries GROUP BY 1), b AS (SELECT bms, {RATES} FROM entries GROUP BY 1),
h AS (SELECT horse_id, arg_max(father, (race_date, race_id, runner_no)) AS father, arg_max(bms, (race_date, race_id, runner_no)) AS bms FROM entries GROUP BY 1)
SELECT horse_id, h.father, h.bms, f.races AS sire_races, CAST(f.top3 AS DOUBLE) / f.races AS sire_top3_rate, b.races AS bms_races, CAST(b.wins AS DOUBLE) / b.races AS bms_win_rate
FROM h JOIN f ON h.father = f.father JOIN b ON h.bms = b.bms
""")
def ag3(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf, pedigree=True)
    last = H.last_value(e, ["horse_id"], H.EXACT_ORDER, ["father", "bms"])
    sire = H.entity_history(e, ["father"], None).select("father", F.col("races").alias("sire_races"), F.col("top3_rate").alias("sire_top3_rate"))
    dam = H.entity_history(e, ["bms"], None).select("bms", F.col("races").alias("bms_races"), F.col("win_rate").alias("bms_win_rate"))
    return last.join(sire, "father", "left").join(dam, "bms", "left")


@query("ag4_horse_history", E + f"""
SELECT horse_id, {RATES}, CAST(sum(finish) AS DOUBLE) / count(*) AS avg_finish, min(finish) AS best_finish, round(avg(last3f), 6) AS avg_last3f, min(last3f) AS best_last3f,
       arg_max(father, (race_date, race_id, runner_no)) AS father
FROM entries GROUP BY horse_id
""")
def ag4(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf, pedigree=True)
    return e.groupBy("horse_id").agg(
        F.count("*").alias("races"), F.sum("is_win").alias("wins"), F.sum("is_top3").alias("top3"),
        (F.sum("finish") / F.count("*")).alias("avg_finish"), F.min("finish").alias("best_finish"),
        F.round(F.avg("last3f"), 6).alias("avg_last3f"), F.min("last3f").alias("best_last3f"),
        F.max_by("father", F.struct(*H.EXACT_ORDER)).alias("father"),
    )


@query("ag5_best_course", E + """
, c AS (SELECT horse_id, course, count(*) AS races, CAST(sum(is_win) AS DOUBLE) / count(*) AS wr FROM entries GROUP BY ALL)
SELECT horse_id, arg_max(course, (wr, races, course)) AS best_course FROM c GROUP BY 1
""")
def ag5(spark: SparkSession, sf: str) -> DataFrame:
    cells = H.entity_history(entries(spark, sf), ["horse_id", "course"], None)
    return G.best_per_group(cells, ["horse_id"], "course", ["win_rate", "races", "course"], "best_course")


@query("ag6_smoothed_tables", E + """
SELECT 'sire' AS kind, father || '/' || surface AS key, count(*) AS n, (CAST(sum(is_win) AS DOUBLE) + 50.0::DOUBLE * 0.1::DOUBLE) / (count(*) + 50.0::DOUBLE) AS rate FROM entries GROUP BY 2
UNION ALL SELECT 'trainer', CAST(trainer_id AS VARCHAR), count(*), (CAST(sum(is_top3) AS DOUBLE) + 20.0::DOUBLE * 0.25::DOUBLE) / (count(*) + 20.0::DOUBLE) FROM entries GROUP BY 2
UNION ALL SELECT 'jockey', CAST(jockey_id AS VARCHAR), count(*), (CAST(sum(is_win) AS DOUBLE) + 30.0::DOUBLE * 0.05::DOUBLE) / (count(*) + 30.0::DOUBLE) FROM entries GROUP BY 2
""")
def ag6(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf, pedigree=True).withColumn("sire_surface", F.concat_ws("/", "father", F.col("surface").cast("string")))
    make = lambda kind, key, hit, a, p: H.smoothed_table(e, [key], F.col(hit), a, p, "rate").select(
        F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), "n", "rate"
    )
    return make("sire", "sire_surface", "is_win", 50.0, 0.1).unionByName(make("trainer", "trainer_id", "is_top3", 20.0, 0.25)).unionByName(
        make("jockey", "jockey_id", "is_win", 30.0, 0.05)
    )


@query("ag7_train_only_rates", E + """
, p AS (SELECT avg(CAST(is_win AS DOUBLE)) AS g FROM entries WHERE year < 1998),
j AS (SELECT jockey_id, (CAST(sum(is_win) AS DOUBLE) + (SELECT g FROM p) * 30.0::DOUBLE) / (count(*) + 30.0::DOUBLE) AS r FROM entries WHERE year < 1998 GROUP BY 1),
c AS (SELECT jockey_id, course, (CAST(sum(is_win) AS DOUBLE) + (SELECT g FROM p) * 10.0::DOUBLE) / (count(*) + 10.0::DOUBLE) AS r FROM entries WHERE year < 1998 GROUP BY 1, 2)
SELECT race_id, runner_no, coalesce(j.r, (SELECT g FROM p)) AS jockey_rate, coalesce(c.r, (SELECT g FROM p)) AS jockey_course_rate
FROM entries e LEFT JOIN j USING (jockey_id) LEFT JOIN c ON c.jockey_id = e.jockey_id AND c.course = e.course
""")
def ag7(spark: SparkSession, sf: str) -> DataFrame:
    train, win = F.col("year") < 1998, F.col("is_win")
    out = H.train_only_rate(entries(spark, sf), ["jockey_id"], win, 30.0, train, "jockey_rate")
    out = H.train_only_rate(out, ["jockey_id", "course"], win, 10.0, train, "jockey_course_rate")
    return out.select("race_id", "runner_no", "jockey_rate", "jockey_course_rate")


@query("ag8_gated_rate", E + """
, f AS (SELECT jockey_id, trainer_id, count(*) AS n, CAST(sum(is_win) AS DOUBLE) / count(*) AS r FROM entries GROUP BY ALL), c AS (SELECT jockey_id, CAST(sum(is_win) AS DOUBLE) / count(*) AS r FROM entries GROUP BY ALL)
SELECT race_id, runner_no, coalesce(CASE WHEN f.n >= 10 THEN f.r END, c.r, 0.05::DOUBLE) AS rate FROM entries e JOIN f ON e.jockey_id = f.jockey_id AND e.trainer_id = f.trainer_id JOIN c ON c.jockey_id = e.jockey_id
""")
def ag8(spark: SparkSession, sf: str) -> DataFrame:
    out = G.gated_group_rate(entries(spark, sf), ["jockey_id", "trainer_id"], ["jockey_id"], "is_win", 10, 0.05, "rate")
    return out.select("race_id", "runner_no", "rate")


@query("ag9_rate_maps", E + """
, d AS (SELECT horse_id, CAST(CASE WHEN distance <= 1200 THEN 0 WHEN distance <= 1400 THEN 1 WHEN distance <= 1800 THEN 2 WHEN distance <= 2200 THEN 3 ELSE 4 END AS BIGINT) AS l, round(CAST(sum(is_top3) AS DOUBLE) / count(*), 4) AS r FROM entries GROUP BY ALL),
s AS (SELECT horse_id, surface AS l, round(CAST(sum(is_top3) AS DOUBLE) / count(*), 4) AS r FROM entries GROUP BY ALL),
la AS (SELECT horse_id, arg_max(finish, (race_date, race_id, runner_no)) AS last_finish, arg_max(distance, (race_date, race_id, runner_no)) AS last_distance FROM entries GROUP BY 1)
SELECT horse_id, last_finish, last_distance, (SELECT string_agg(l || ':' || CAST(r AS VARCHAR), ',' ORDER BY l) FROM d WHERE d.horse_id = la.horse_id) AS by_distance,
       (SELECT string_agg(l || ':' || CAST(r AS VARCHAR), ',' ORDER BY l) FROM s WHERE s.horse_id = la.horse_id) AS by_surface FROM la
""")
def ag9(spark: SparkSession, sf: str) -> DataFrame:
    axes = {"by_distance": C.cut_named("distance", "distance").cast("bigint"), "by_surface": F.col("surface")}
    out = G.rate_maps(entries(spark, sf), "horse_id", axes, "is_top3", {"last_finish": "finish", "last_distance": "distance"}, H.EXACT_ORDER)
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat_ws(":", x["key"].cast("string"), F.round(x["value"], 4).cast("string"))), ",")
    return out.select("horse_id", "last_finish", "last_distance", text("by_distance").alias("by_distance"), text("by_surface").alias("by_surface"))


@query("ag10_workout_summary", """
WITH w AS (
  SELECT l_orderkey AS key, CAST(l_shipdate AS DATE) AS d, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE l_returnflag WHEN 'A' THEN 'slope' WHEN 'R' THEN 'wood' ELSE 'pool' END AS kind,
         CASE WHEN l_quantity > 40 THEN NULL ELSE 48.0::DOUBLE + l_tax * 40.0::DOUBLE END AS t4, 36.0::DOUBLE + l_discount * 30.0::DOUBLE AS t3, 12.0::DOUBLE + l_quantity / 50.0::DOUBLE AS t1,
         CASE l_linestatus WHEN 'F' THEN '一杯' ELSE '馬なり' END AS intensity, CASE WHEN l_quantity < 10 THEN 'a' WHEN l_quantity < 20 THEN 'C' ELSE '-' END AS evaluation, CASE WHEN l_tax > 0.04 THEN '先着' ELSE '遅れ' END AS awase
  FROM lineitem
)
SELECT key, count(*) AS training_count, count(*) FILTER (kind = 'slope') AS slope_count, count(*) FILTER (kind = 'wood') AS wood_count,
  min(t4) AS best_4f, round(avg(t4), 6) AS avg_4f, arg_max(t4, (d, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) FILTER (t4 IS NOT NULL) AS last_4f,
  min(t3) AS best_3f, round(avg(t3), 6) AS avg_3f, arg_max(t3, (d, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS last_3f,
  min(t1) AS best_1f, arg_max(t1, (d, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS last_1f,
  CAST(CASE arg_max(intensity, (d, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) WHEN '一杯' THEN 3 ELSE 1 END AS BIGINT) AS last_intensity_enc,
  CAST(CASE arg_max(evaluation, (d, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) WHEN 'a' THEN 5 ELSE 3 END AS BIGINT) AS last_eval_enc,
  CAST(CASE arg_max(awase, (d, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) WHEN '先着' THEN 2 ELSE 0 END AS BIGINT) AS last_awase_enc,
  count(*) FILTER (intensity = '一杯') AS ippai_count, count(*) FILTER (awase = '先着') AS awase_win_count
FROM w GROUP BY key
""")
def ag10(spark: SparkSession, sf: str) -> DataFrame:
    works = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS key", "to_date(l_shipdate) AS d", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "CASE l_returnflag WHEN 'A' THEN 'slope' WHEN 'R' THEN 'wood' ELSE 'pool' END AS training_type",
        "CASE WHEN l_quantity <= 40 THEN 48.0D + l_tax * 40.0D END AS time_4f", "36.0D + l_discount * 30.0D AS time_3f",
        "12.0D + l_quantity / 50.0D AS time_1f", "CASE l_linestatus WHEN 'F' THEN '一杯' ELSE '馬なり' END AS intensity",
        "CASE WHEN l_quantity < 10 THEN 'a' WHEN l_quantity < 20 THEN 'C' ELSE '-' END AS evaluation",
        "CASE WHEN l_tax > 0.04D THEN '先着' ELSE '遅れ' END AS awase_result",
    )
    out = G.workout_summary(works, "key", ["d", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.withColumns({"avg_4f": F.round("avg_4f", 6), "avg_3f": F.round("avg_3f", 6)})


@query("ag11_race_mean", E + """
SELECT race_id, runner_no, round(last3f - avg(last3f) OVER (PARTITION BY race_id), 6) AS relative_last3f FROM entries
""")
def ag11(spark: SparkSession, sf: str) -> DataFrame:
    mean = F.avg("last3f").over(Window.partitionBy("race_id"))
    return entries(spark, sf).select("race_id", "runner_no", F.round(F.col("last3f") - mean, 6).alias("relative_last3f"))


@query("ag12_top_n_encode", E + """
, c AS (SELECT father, row_number() OVER (ORDER BY count(*) DESC, father) - 1 AS code FROM entries WHERE year < 1998 GROUP BY father)
SELECT race_id, runner_no, CASE WHEN code < 12 THEN code ELSE 12 END AS father_code FROM entries LEFT JOIN c USING (father)
""")
def ag12(spark: SparkSession, sf: str) -> DataFrame:
    return H.top_n_encode(entries(spark, sf, pedigree=True), "father", 12, F.col("year") < 1998).select("race_id", "runner_no", "father_code")
