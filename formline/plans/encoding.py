"""Projections, filters and scalar encodings (PRJ*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline import constants as K
from formline.functions import columns as C
from formline.operators import scoring as S
from formline.plans.registry import query
from formline.plans.views import E, entries, table

ROW = ["race_id", "runner_no"]


@query("prj1_coerce", """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 480.0::DOUBLE) AS weight,
       coalesce(TRY_CAST(event_type AS DOUBLE), 5.0::DOUBLE) AS finish,
       coalesce(CAST(trunc(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE)) AS BIGINT), 0) AS whole_value
FROM events
""")
def prj1(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("weight"), F.col("event_type").alias("finish"),
        F.col("value").cast("string").alias("whole_value"),
    )
    return C.coerce(raw, {"weight": K.MISSING_DEFAULTS["weight"], "finish": K.MISSING_DEFAULTS["finish"]}, {"whole_value": 0})


@query("prj2_dates_from_parts", """
SELECT o_orderkey, CAST(y2 + 2000 AS BIGINT) AS year_plus, CAST(CASE WHEN y2 < 50 THEN y2 + 2000 ELSE y2 + 1900 END AS BIGINT) AS year_split,
       CAST((y2 + 2000) * 10000 + m * 100 + d2 AS BIGINT) AS date_num,
       CAST(try_strptime(lpad(CAST(y2 + 2000 AS VARCHAR), 4, '0') || lpad(CAST(m AS VARCHAR), 2, '0') || lpad(CAST(d2 AS VARCHAR), 2, '0'), '%Y%m%d') AS DATE) AS race_date
FROM (SELECT o_orderkey, year(o_orderdate) % 100 AS y2, month(o_orderdate) AS m, 1 + o_orderkey % 31 AS d2 FROM orders)
""")
def prj2(spark: SparkSession, sf: str) -> DataFrame:
    y2, m = F.year("o_orderdate") % 100, F.month("o_orderdate")
    d = (F.col("o_orderkey") % 31 + 1).cast("int")
    return table(spark, sf, "orders").select(
        "o_orderkey", C.full_year(y2).cast("bigint").alias("year_plus"),
        C.full_year(y2, "below50").cast("bigint").alias("year_split"),
        C.date_number(C.full_year(y2), m, d).alias("date_num"), C.real_date(C.full_year(y2), m, d).alias("race_date"),
    )


@query("prj3_normalise_ids", """
SELECT c_custkey, substr(trim(t), 1, 8) AS race_key, CASE WHEN length(trim(t)) > 8 THEN right(trim(t), 8) ELSE trim(t) END AS horse_key,
       CASE WHEN length(trim(t)) = 10 THEN right(trim(t), 8) ELSE trim(t) END AS horse_key_ten
FROM (SELECT c_custkey, '  ' || substr(c_name, 1 + CAST(c_custkey % 12 AS INTEGER), 18) || ' ' AS t FROM customer)
""")
def prj3(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("  "), F.substr("c_name", (F.col("c_custkey") % 12 + 1).cast("int"), F.lit(18)), F.lit(" "))
    return table(spark, sf, "customer").select(
        "c_custkey", C.race_key8(text).alias("race_key"), C.horse_key(text).alias("horse_key"),
        C.horse_key(text, only_if=10).alias("horse_key_ten"),
    )


@query("prj4_encode_contains", """
SELECT p_partkey, CAST(CASE WHEN contains(p_name, 'red') THEN 0 WHEN contains(p_name, 'r') THEN 1 WHEN contains(p_name, 'bolt') THEN 2 ELSE 9 END AS BIGINT) AS code,
       CAST(CASE WHEN contains(p_type, 'ECO') THEN 0 WHEN contains(p_type, 'S') THEN 1 ELSE 2 END AS BIGINT) AS kind
FROM part
""")
def prj4(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", C.encode_contains("p_name", [("red", 0), ("r", 1), ("bolt", 2)], 9).cast("bigint").alias("code"),
        C.encode_contains("p_type", [("ECO", 0), ("S", 1)], 2).cast("bigint").alias("kind"),
    )


@query("prj5_map_lookup", """
SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 24 END AS BIGINT) AS course_code,
       CASE o_orderstatus WHEN 'F' THEN 0.25::DOUBLE WHEN 'O' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS weather
FROM orders
""")
def prj5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey", C.map_lookup("o_orderpriority", {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}, 24).cast("bigint").alias("course_code"),
        C.map_lookup("o_orderstatus", {"F": 0.25, "O": 0.5}, 0.0).alias("weather"),
    )


@query("prj6_cut_distance", E + """
SELECT race_id, runner_no, distance,
       CAST(CASE WHEN distance <= 1200 THEN 0 WHEN distance <= 1400 THEN 1 WHEN distance <= 1800 THEN 2 WHEN distance <= 2200 THEN 3 ELSE 4 END AS BIGINT) AS dist_cat
FROM entries
""")
def prj6_distance(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select(*ROW, "distance", C.cut_named("distance", "distance").cast("bigint").alias("dist_cat"))


@query("prj6_cut_all_bins", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       CAST(CASE WHEN w <= 0 THEN 1 WHEN w <= 440 THEN 0 WHEN w <= 480 THEN 1 WHEN w <= 520 THEN 2 ELSE 3 END AS BIGINT) AS weight_cat,
       CAST(CASE WHEN r <= 6 THEN 0 WHEN r <= 14 THEN 1 WHEN r <= 35 THEN 2 WHEN r <= 63 THEN 3 WHEN r <= 180 THEN 4 ELSE 5 END AS BIGINT) AS rest_cat,
       CAST(CASE WHEN r <= 0 THEN 2 WHEN r <= 14 THEN 0 WHEN r <= 28 THEN 1 WHEN r <= 60 THEN 2 WHEN r <= 180 THEN 3 ELSE 4 END AS BIGINT) AS rest_cat_old,
       CAST(CASE WHEN r <= 14 THEN 0 WHEN r <= 35 THEN 1 WHEN r <= 90 THEN 2 ELSE 3 END AS BIGINT) AS rest_cat_regional,
       CAST(CASE WHEN l_linenumber <= 3 THEN 0 WHEN l_linenumber <= 6 THEN 1 WHEN l_linenumber <= 8 THEN 2 ELSE 1 END AS BIGINT) AS bracket_pos,
       CAST(CASE WHEN p <= -1 THEN 0 WHEN p <= 1 THEN 1 ELSE 2 END AS BIGINT) AS pace_cat
FROM (SELECT *, 400.0::DOUBLE + 3.0::DOUBLE * l_quantity AS w, l_orderkey % 400 AS r, 100.0::DOUBLE * l_tax - 4.0::DOUBLE AS p FROM lineitem)
""")
def prj6_all(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").withColumns({
        "w": F.lit(400.0) + F.lit(3.0) * F.col("l_quantity"), "r": F.col("l_orderkey") % 400,
        "p": F.lit(100.0) * F.col("l_tax") - 4.0,
    })
    cats = {"weight_cat": ("w", "weight"), "rest_cat": ("r", "rest"), "rest_cat_old": ("r", "rest_old"),
            "rest_cat_regional": ("r", "rest_regional"), "bracket_pos": ("l_linenumber", "bracket"), "pace_cat": ("p", "pace")}
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        *[C.cut_named(c, b).cast("bigint").alias(n) for n, (c, b) in cats.items()],
    )


@query("prj7_numeric_shaping", E + """
SELECT race_id, runner_no, ln(1.0::DOUBLE + CASE WHEN odds < 1 THEN 1.0::DOUBLE WHEN odds > 999 THEN 999.0::DOUBLE ELSE odds END) AS odds_log,
       CAST(runner_no AS DOUBLE) / CAST(CASE WHEN num_horses < 1 THEN 1 ELSE num_horses END AS DOUBLE) AS num_ratio,
       CAST(least(8, greatest(1, (runner_no - 1) * 8 // greatest(num_horses, 1) + 1)) AS BIGINT) AS bracket,
       CAST((runner_no - 1) // 2 + 1 AS BIGINT) AS bracket_old, abs(carry - 25.0::DOUBLE) AS carry_abs
FROM entries
""")
def prj7(spark: SparkSession, sf: str) -> DataFrame:
    n, u = F.col("num_horses"), F.col("runner_no")
    return entries(spark, sf).select(
        *ROW, F.log1p(C.clip("odds", 1.0, 999.0)).alias("odds_log"), C.safe_ratio(u, n).alias("num_ratio"),
        C.bracket(u, n).alias("bracket"), C.bracket_of_pairs(u).alias("bracket_old"), F.abs(F.col("carry") - 25.0).alias("carry_abs"),
    )


@query("prj8_crossed_codes", E + """
SELECT race_id, runner_no, surface * 10 + dc AS surface_dist, going * 10 + surface AS cond_surface, course * 10 + surface AS course_surface,
       age * 10 + surface AS age_surface, dc * 5 + going AS dist_going_old
FROM (SELECT *, CAST(CASE WHEN distance <= 1200 THEN 0 WHEN distance <= 1400 THEN 1 WHEN distance <= 1800 THEN 2 WHEN distance <= 2200 THEN 3 ELSE 4 END AS BIGINT) AS dc FROM entries)
""")
def prj8(spark: SparkSession, sf: str) -> DataFrame:
    s, g, dc = F.col("surface"), F.col("going"), C.cut_named("distance", "distance").cast("bigint")
    return entries(spark, sf, pedigree=True).select(
        *ROW, C.cross_code(s, dc).alias("surface_dist"), C.cross_code(g, s).alias("cond_surface"),
        C.cross_code(F.col("course"), s).alias("course_surface"), C.cross_code(F.col("age"), s).alias("age_surface"),
        C.cross_code(dc, g, 5).alias("dist_going_old"),
    )


@query("prj9_season_code", """
SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) IN (3,4,5) THEN 0 WHEN month(o_orderdate) IN (6,7,8) THEN 1 WHEN month(o_orderdate) IN (9,10,11) THEN 2 ELSE 3 END AS BIGINT) AS season
FROM orders
""")
def prj9(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", C.season_code(F.month("o_orderdate")).cast("bigint").alias("season"))


@query("prj10_complete_features", """
SELECT c_custkey, coalesce(c_acctbal, 0.0::DOUBLE) AS c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey, 0.0::DOUBLE AS c_mktsegment, 0.0::DOUBLE AS wind_speed
FROM customer
""")
def prj10(spark: SparkSession, sf: str) -> DataFrame:
    feats = ["c_acctbal", "c_nationkey", "c_mktsegment", "wind_speed"]
    return C.complete_features(table(spark, sf, "customer"), feats).select("c_custkey", *feats)


@query("prj11_classify_race", E + """
SELECT race_id, CASE WHEN n <= 7 THEN 'E' WHEN d <= 1400 THEN 'D' WHEN n <= 14 AND d >= 1600 AND g < 2 THEN 'A' WHEN n <= 14 AND d >= 1600 THEN 'B'
       WHEN d >= 1600 AND g < 2 THEN 'C' ELSE 'X' END AS cond_key,
       NOT (n > 7 AND d <= 1000) AS recommended
FROM (SELECT race_id, max(num_horses) AS n, max(distance) AS d, max(going) AS g FROM entries GROUP BY race_id)
""")
def prj11(spark: SparkSession, sf: str) -> DataFrame:
    race = entries(spark, sf).groupBy("race_id").agg(F.max("num_horses").alias("n"), F.max("distance").alias("d"), F.max("going").alias("g"))
    key = C.classify_race(F.col("n"), F.col("d"), F.col("g") >= 2)
    return race.select("race_id", key.alias("cond_key"), C.buy_recommended(key, F.col("d")).alias("recommended"))


@query("prj11_classify_regional_race", E + """
SELECT race_id, CASE WHEN d < 1600 AND n <= 4 THEN 'D' WHEN d < 1600 AND n <= 7 THEN 'F' WHEN d < 1600 THEN 'G' WHEN n <= 7 THEN 'E'
       WHEN n >= 15 THEN 'C' WHEN g >= 2 THEN 'B' ELSE 'A' END AS cond_key
FROM (SELECT race_id, max(num_horses) AS n, max(distance) AS d, max(going) AS g FROM entries GROUP BY race_id)
""")
def prj11_regional(spark: SparkSession, sf: str) -> DataFrame:
    race = entries(spark, sf).groupBy("race_id").agg(F.max("num_horses").alias("n"), F.max("distance").alias("d"), F.max("going").alias("g"))
    return race.select("race_id", C.classify_regional_race(F.col("n"), F.col("d"), F.col("g") >= 2).alias("cond_key"))


@query("prj11_classify_race_by_text", """
WITH t AS (SELECT o_orderkey, o_orderkey % 18 + 1 AS n, 1000 + o_custkey % 17 * 100 AS d, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '良' WHEN '2' THEN '稍' WHEN '3' THEN '稍重' WHEN '4' THEN '不良' ELSE '' END AS g FROM orders),
f AS (SELECT *, contains(g, '重') OR contains(g, '不') AS heavy, contains(g, '良') OR contains(g, '稍') AS good FROM t)
SELECT o_orderkey, CASE WHEN n <= 7 THEN 'E' WHEN d <= 1400 THEN 'D' WHEN n <= 14 AND d >= 1600 AND NOT heavy THEN 'A' WHEN n <= 14 AND d >= 1600 THEN 'B' WHEN d >= 1600 AND NOT heavy THEN 'C' ELSE 'X' END AS cond_key,
  CASE WHEN n <= 7 THEN 'E' WHEN d <= 1400 THEN 'D' WHEN n <= 14 AND d >= 1600 AND good THEN 'A' WHEN n <= 14 AND d >= 1600 AND heavy THEN 'B' WHEN n >= 15 AND d >= 1600 AND good THEN 'C' ELSE 'X' END AS strict_key FROM f
""")
def prj11_text(spark: SparkSession, sf: str) -> DataFrame:
    n, d = F.col("o_orderkey") % 18 + 1, F.col("o_custkey") % 17 * 100 + 1000
    g = C.map_lookup(F.substring("o_orderpriority", 1, 1), {"1": "良", "2": "稍", "3": "稍重", "4": "不良"}, "")
    return table(spark, sf, "orders").select(
        "o_orderkey", C.classify_race_by_text(n, d, g).alias("cond_key"), C.classify_race_by_text(n, d, g, strict=True).alias("strict_key")
    )


@query("prj12_axes", E + """
SELECT cond_key, dist, nh, cond, course_name AS course, class, season, surface, count(*) AS n FROM (
  SELECT *, 1 AS x FROM (SELECT * EXCLUDE (surface), CASE surface WHEN 0 THEN 'turf' ELSE 'dirt' END AS surface,
         CASE WHEN num_horses <= 7 THEN 'E' WHEN distance <= 1400 THEN 'D' WHEN num_horses <= 14 AND distance >= 1600 AND going < 2 THEN 'A'
              WHEN num_horses <= 14 AND distance >= 1600 THEN 'B' WHEN distance >= 1600 AND going < 2 THEN 'C' ELSE 'X' END AS cond_key,
         CASE WHEN distance <= 1200 THEN 'sprint' WHEN distance <= 1600 THEN 'mile' WHEN distance <= 2200 THEN 'middle' ELSE 'long' END AS dist,
         CASE WHEN num_horses <= 7 THEN 'small' WHEN num_horses <= 14 THEN 'medium' ELSE 'large' END AS nh,
         CASE WHEN going <= 1 THEN 'good' ELSE 'heavy' END AS cond, 'c' || course AS course_name, 'cls' || class_code AS class,
         CASE WHEN month IN (3,4,5) THEN 'spring' WHEN month IN (6,7,8) THEN 'summer' WHEN month IN (9,10,11) THEN 'autumn' ELSE 'winter' END AS season
  FROM entries WHERE runner_no = 1)) GROUP BY ALL
""")
def prj12(spark: SparkSession, sf: str) -> DataFrame:
    axes = C.race_axes(*[F.col(c) for c in ("num_horses", "distance", "going", "course", "class_code", "month", "surface")])
    heads = entries(spark, sf).filter(F.col("runner_no") == 1).select(*[v.alias(k) for k, v in axes.items()])
    return heads.groupBy(*axes).agg(F.count("*").alias("n"))


@query("prj13_race_keys", """
SELECT o_orderkey, lpad(CAST(c AS VARCHAR), 2, '0') || lpad(CAST(y AS VARCHAR), 2, '0') || CAST(k AS VARCHAR) || CASE WHEN n < 10 THEN CAST(n AS VARCHAR) ELSE chr(CAST(55 + n AS INTEGER)) END || lpad(CAST(r AS VARCHAR), 2, '0') AS key8,
       '20' || lpad(CAST(y AS VARCHAR), 2, '0') || lpad(CAST(c AS VARCHAR), 2, '0') || '0' || CAST(k AS VARCHAR) || lpad(CAST(n AS VARCHAR), 2, '0') || lpad(CAST(r AS VARCHAR), 2, '0') AS key12,
       strftime(o_orderdate, '%Y%m%d') || lpad(CAST(c AS VARCHAR), 2, '0') || lpad(CAST(r AS VARCHAR), 2, '0') AS day_key
FROM (SELECT *, o_custkey % 10 + 1 AS c, year(o_orderdate) % 100 AS y, o_orderkey % 5 + 1 AS k, o_orderkey % 12 + 1 AS n, o_orderkey % 11 + 1 AS r FROM orders)
""")
def prj13(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    c, y, k, n, r = F.col("o_custkey") % 10 + 1, F.year("o_orderdate"), key % 5 + 1, key % 12 + 1, key % 11 + 1
    key8 = C.race_key_from_parts(c, y, k, n, r)
    return table(spark, sf, "orders").select(
        "o_orderkey", key8.alias("key8"), C.race_key12(key8).alias("key12"), C.day_course_race_key(F.col("o_orderdate"), c, r).alias("day_key")
    )


@query("prj14_class_ladder", """
SELECT p_partkey, CASE WHEN x >= 190 THEN 'G1' WHEN x >= 160 THEN 'G2G3' WHEN x >= 130 THEN 'OP' WHEN x >= 100 THEN '3win' WHEN x >= 67 THEN '2win'
       WHEN x >= 34 THEN '1win' WHEN x >= 16 THEN 'maiden' WHEN x >= 5 THEN 'newcomer' ELSE 'other' END AS class_label
FROM (SELECT p_partkey, p_size * 4 AS x FROM part)
""")
def prj14(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", C.class_ladder(F.col("p_size") * 4).alias("class_label"))


@query("prj15_row_filters", E + """
SELECT race_id, runner_no, odds, 48.0::DOUBLE + (last3f - 33.0::DOUBLE) * 6.0::DOUBLE AS time_4f FROM entries
WHERE finish >= 1 AND field >= 5 AND odds > 0 AND 48.0::DOUBLE + (last3f - 33.0::DOUBLE) * 6.0::DOUBLE < 80 AND course IN (1, 3, 5, 7) AND CAST(race_date AS VARCHAR) LIKE '199%'
""")
def prj15(spark: SparkSession, sf: str) -> DataFrame:
    time4 = F.lit(48.0) + (F.col("last3f") - 33.0) * 6.0
    kept = entries(spark, sf).filter(
        (F.col("finish") >= 1) & (F.col("field") >= 5) & (F.col("odds") > 0) & (time4 > 30) & (time4 < 80)
        & F.col("course").isin(1, 3, 5, 7) & F.col("race_date").cast("string").rlike(r"^199\d-")
    )
    return kept.select(*ROW, "odds", time4.alias("time_4f"))


APTITUDE = [("Brand#%d" % i, i % 5 / 5.0, i % 3 / 3.0, i % 4 / 4.0, i % 7 / 7.0, i % 6 / 6.0, i % 8 / 8.0) for i in range(1, 20)]


@query("prj16_aptitude_score", E + """
, apt AS (
  SELECT 'Brand#' || i AS father, (i % 5) / 5.0::DOUBLE AS turf, (i % 3) / 3.0::DOUBLE AS dirt, (i % 4) / 4.0::DOUBLE AS sprint,
         (i % 7) / 7.0::DOUBLE AS mile, (i % 6) / 6.0::DOUBLE AS mid, (i % 8) / 8.0::DOUBLE AS long FROM range(1, 20) t(i)
)
SELECT race_id, runner_no, coalesce(CASE WHEN surface = 0 THEN turf ELSE dirt END, 0.5::DOUBLE) * 0.5::DOUBLE
     + coalesce(CASE WHEN distance <= 1400 THEN sprint WHEN distance <= 1800 THEN mile WHEN distance <= 2200 THEN mid ELSE long END, 0.5::DOUBLE) * 0.5::DOUBLE AS sire_score
FROM entries LEFT JOIN apt USING (father)
""")
def prj16(spark: SparkSession, sf: str) -> DataFrame:
    # A static table of 19 sires: its size does not grow with the data.
    fits = S.sire_fit_table(spark, APTITUDE)
    return S.sire_score(entries(spark, sf, pedigree=True), fits, F.col("surface") == 0).select(*ROW, "sire_score")


@query("prj18_split_text_fields", """
SELECT p_partkey, substr(t, 1, 1) AS sex, TRY_CAST(substr(t, 2) AS BIGINT) AS age, TRY_CAST(regexp_extract(w, '(\\d{3,})\\(([+-]?\\d+)\\)', 1) AS BIGINT) AS weight,
       TRY_CAST(regexp_extract(w, '(\\d{3,})\\(([+-]?\\d+)\\)', 2) AS BIGINT) AS weight_change
FROM (SELECT p_partkey, substr(p_type, 1, 1) || CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS t,
             CASE WHEN p_partkey % 11 = 0 THEN '計不' ELSE CAST(400 + p_size AS VARCHAR) || '(' || CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END || CAST(p_partkey % 20 AS VARCHAR) || ')' END AS w FROM part)
""")
def prj18(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    t = F.concat(F.substring("p_type", 1, 1), F.when(key % 9 == 0, "x").otherwise(F.col("p_size").cast("string")))
    sign = F.when(key % 2 == 0, "+").otherwise("-")
    w = F.when(key % 11 == 0, "計不").otherwise(
        F.concat((F.col("p_size") + 400).cast("string"), F.lit("("), sign, (key % 20).cast("string"), F.lit(")"))
    )
    sex, age = C.split_sex_age(t)
    weight, change = C.parse_weight(w)
    return table(spark, sf, "part").select("p_partkey", sex.alias("sex"), age.alias("age"), weight.alias("weight"), change.alias("weight_change"))


@query("prj19_weather_text", """
SELECT o_orderkey, CASE WHEN contains(t, '非常に強') THEN 15.0::DOUBLE WHEN contains(t, '強く') OR contains(t, '強い') THEN 10.0::DOUBLE WHEN contains(t, 'やや強') THEN 7.0::DOUBLE
         WHEN contains(t, '弱く') OR contains(t, '弱い') THEN 2.0::DOUBLE ELSE 4.0::DOUBLE END AS wind_speed,
       CASE WHEN contains(t, '北東') AND NOT contains(t, '北北東') THEN '北東' WHEN contains(t, '北北東') THEN '北北東' WHEN contains(t, '西') THEN '西' WHEN contains(t, '南') THEN '南' END AS wind_direction,
       CASE WHEN p >= 80 THEN 5.0::DOUBLE WHEN p >= 60 THEN 2.0::DOUBLE WHEN p >= 40 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS rain
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '北東' WHEN 1 THEN '北北東' WHEN 2 THEN '西' ELSE '南' END || 'の風 ' ||
             CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '非常に強く' WHEN '2' THEN '強く' WHEN '3' THEN 'やや強' WHEN '4' THEN '弱く' ELSE '' END AS t, o_custkey % 100 AS p FROM orders)
""")
def prj19(spark: SparkSession, sf: str) -> DataFrame:
    where = C.map_lookup(F.col("o_orderkey") % 4, {0: "北東", 1: "北北東", 2: "西"}, "南")
    force = C.map_lookup(F.substring("o_orderpriority", 1, 1), {"1": "非常に強く", "2": "強く", "3": "やや強", "4": "弱く"}, "")
    text = F.concat(where, F.lit("の風 "), force)
    return table(spark, sf, "orders").select(
        "o_orderkey", C.wind_speed(text).alias("wind_speed"), C.wind_direction(text).alias("wind_direction"),
        C.rain_from_probability(F.col("o_custkey") % 100).alias("rain"),
    )


@query("prj20_mean_available", """
SELECT c_custkey, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END AS moisture
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS a, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS b FROM customer)
""")
def prj20(spark: SparkSession, sf: str) -> DataFrame:
    a = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal"))
    b = F.when(F.col("c_custkey") % 2 != 0, F.col("c_nationkey").cast("double"))
    return table(spark, sf, "customer").select("c_custkey", C.mean_available([a, b]).alias("moisture"))


@query("prj21_row_statistics", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, (a + b + c) / 3.0::DOUBLE AS avg3, least(a, b, c) AS best3,
       CAST(a <= 3 AS BIGINT) + CAST(b <= 3 AS BIGINT) + CAST(c <= 3 AS BIGINT) AS top3
FROM (SELECT *, CAST(l_linenumber AS DOUBLE) AS a, l_quantity AS b, 100.0::DOUBLE * l_tax AS c FROM lineitem)
""")
def prj21(spark: SparkSession, sf: str) -> DataFrame:
    mean, low, count = C.row_stats([F.col("l_linenumber").cast("double"), F.col("l_quantity"), F.lit(100.0) * F.col("l_tax")])
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", mean.alias("avg3"), low.alias("best3"), count.alias("top3")
    )


@query("prj22_target_variants", E + """
SELECT race_id, runner_no, is_win, is_top3, CASE finish WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.7::DOUBLE WHEN 3 THEN 0.5::DOUBLE WHEN 4 THEN 0.1::DOUBLE WHEN 5 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS graded
FROM entries
""")
def prj22(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select(*ROW, "is_win", "is_top3", C.graded_target(F.col("finish")).alias("graded"))


@query("prj23_lap_pace", E + """
, laps AS (
  SELECT race_id, runner_no, last3f / 3.0::DOUBLE AS lap, field, runner_no <= field // 2 AS early FROM entries
),
halves AS (
  SELECT race_id, max(field) AS laps, round(sum(CASE WHEN early THEN lap ELSE 0.0::DOUBLE END), 6) AS first_half, round(sum(CASE WHEN early THEN 0.0::DOUBLE ELSE lap END), 6) AS second_half FROM laps GROUP BY race_id
)
SELECT race_id, laps, CASE WHEN laps >= 4 THEN first_half END AS first_half, CASE WHEN laps >= 4 THEN second_half END AS second_half,
       CASE WHEN laps < 4 THEN NULL WHEN first_half - second_half < -1 THEN 'S' WHEN first_half - second_half > 1 THEN 'H' ELSE 'M' END AS pace
FROM halves
""")
def prj23(spark: SparkSession, sf: str) -> DataFrame:
    # The laps of one race: as many as it has runners, so the array is bounded.
    laps = F.transform(F.sort_array(F.collect_list(F.struct("runner_no", (F.col("last3f") / 3.0).alias("lap")))), lambda x: x["lap"])
    race = entries(spark, sf).groupBy("race_id").agg(laps.alias("a"))
    first, second = C.lap_halves(F.col("a"))
    return race.select(
        "race_id", F.size("a").cast("bigint").alias("laps"), F.round(first, 6).alias("first_half"), F.round(second, 6).alias("second_half"),
        C.lap_pace(F.col("a")).alias("pace"),
    )
