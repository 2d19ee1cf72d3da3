"""Joins (JN*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.functions import bets as B
from formline.operators import joins as J
from formline.operators.history import smoothed_table
from formline.plans.registry import query
from formline.plans.views import ENTRIES, LEDGER, RANKED, RR, WORKOUTS, E, entries, ledger, races, ranked, table, with_views, workouts


@query("jn1_race_facts", E + """
, laps AS (
  SELECT l_orderkey AS race_id, arg_min(l_tax, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS lap_tax, min(l_linenumber) AS x FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1
)
SELECT e.race_id, e.runner_no, 35.8::DOUBLE + lap_tax * 10.0::DOUBLE AS race_first3f FROM entries e LEFT JOIN laps USING (race_id)
""")
def jn1(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").filter(F.col("l_returnflag") != "N")
    laps = lines.select(F.col("l_orderkey").alias("race_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax")
    out = J.attach(entries(spark, sf), laps, ["race_id"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.select("race_id", "runner_no", (F.lit(35.8) + F.col("l_tax") * 10.0).alias("race_first3f"))


@query("jn2_payout_lookup", RR + """
SELECT has_payout, cond_key, count(*) AS n, CAST(coalesce(sum(CASE WHEN has_payout = 1 THEN trio_yen END), 0) AS BIGINT) AS yen FROM races GROUP BY ALL
""")
def jn2(spark: SparkSession, sf: str) -> DataFrame:
    all_races = races(spark, sf)
    payouts = all_races.filter(F.col("has_payout") == 1).select("race_id", F.col("trio_yen").alias("yen"))
    joined = J.with_flag(all_races.select("race_id", "cond_key"), payouts, ["race_id"], "has_payout")
    return joined.groupBy("has_payout", "cond_key").agg(F.count("*").alias("n"), F.coalesce(F.sum("yen"), F.lit(0)).cast("bigint").alias("yen"))


@query("jn3_group_statistics", E + """
, s AS (SELECT jockey_id, course, count(*) AS rides, CAST(sum(is_win) AS DOUBLE) / count(*) AS rate FROM entries GROUP BY ALL)
SELECT race_id, runner_no, rides, rate FROM entries JOIN s USING (jockey_id, course)
""")
def jn3(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    stats = e.groupBy("jockey_id", "course").agg(F.count("*").alias("rides"), (F.sum("is_win") / F.count("*")).alias("rate"))
    return e.join(stats, ["jockey_id", "course"]).select("race_id", "runner_no", "rides", "rate")


LOOK_BACK_SQL = with_views(ENTRIES, WORKOUTS) + """
SELECT e.race_id, e.runner_no, min(w.time_4f) AS best_4f, min(w.time_3f) AS best_3f, count(w.horse_id) AS n_works,
       count(DISTINCT w.work_date) AS n_days
FROM entries e LEFT JOIN workouts w ON w.horse_id = e.horse_id AND w.work_date >= e.race_date - 14 AND w.work_date < e.race_date
GROUP BY ALL
"""


@query("jn4_lookback_best", LOOK_BACK_SQL)
def jn4(spark: SparkSession, sf: str) -> DataFrame:
    works = workouts(spark, sf)
    best = {"best_4f": "time_4f", "best_3f": "time_3f"}
    out = J.look_back(entries(spark, sf), works, "horse_id", "race_date", "work_date", best, "n_works", "n_days")
    return out.select("race_id", "runner_no", "best_4f", "best_3f", "n_works", "n_days")


@query("jn4_lookback_fills", LOOK_BACK_SQL.replace("SELECT e.race_id", ", lb AS (SELECT e.race_id", 1) + """)
SELECT race_id, runner_no, round(coalesce(best_4f, avg(best_4f) OVER (), 53.0), 6) AS best_4f_filled, round(coalesce(best_3f, avg(best_3f) OVER (), 39.0), 6) AS best_3f_filled,
       CAST(best_4f IS NOT NULL AS BIGINT) AS has_training, n_works + n_days AS total_count FROM lb
""")
def jn4_fills(spark: SparkSession, sf: str) -> DataFrame:
    best = {"best_4f": "time_4f", "best_3f": "time_3f"}
    out = J.look_back(entries(spark, sf), workouts(spark, sf), "horse_id", "race_date", "work_date", best, "n_works", "n_days")
    out = J.with_fills(out, {"best_4f": 53.0, "best_3f": 39.0}, {"has_training": "best_4f"}, ["n_works", "n_days"], "total_count")
    return out.select("race_id", "runner_no", *[F.round(c, 6).alias(c) for c in ("best_4f_filled", "best_3f_filled")], "has_training", "total_count")


@query("jn5_month_bucket", with_views(ENTRIES, WORKOUTS) + """
, m AS (SELECT horse_id, date_trunc('month', work_date) AS mon, min(time_4f) AS t FROM workouts GROUP BY ALL),
j AS (
  SELECT e.race_id, e.runner_no, a.t AS now_all, b.t AS before,
         (SELECT min(w.time_4f) FROM workouts w WHERE w.horse_id = e.horse_id AND w.work_date >= date_trunc('month', e.race_date) AND w.work_date < e.race_date) AS now_asof
  FROM entries e LEFT JOIN m a ON a.horse_id = e.horse_id AND a.mon = date_trunc('month', e.race_date)
  LEFT JOIN m b ON b.horse_id = e.horse_id AND b.mon = date_trunc('month', e.race_date) - INTERVAL 1 MONTH
)
SELECT race_id, runner_no, coalesce(now_all, before) AS month_4f, coalesce(now_asof, before) AS asof_4f FROM j
""")
def jn5(spark: SparkSession, sf: str) -> DataFrame:
    works = workouts(spark, sf)
    out = J.month_bucket(entries(spark, sf), works, "horse_id", "race_date", "work_date", {"month_4f": "time_4f"}, as_of=False)
    out = J.month_bucket(out, works, "horse_id", "race_date", "work_date", {"asof_4f": "time_4f"}, as_of=True)
    return out.select("race_id", "runner_no", "month_4f", "asof_4f")


@query("jn6_resolve_names", E + """
SELECT w.l_partkey AS work_part, w.name, last.horse_id, count(*) AS works
FROM (SELECT l_partkey, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey) w
LEFT JOIN (SELECT horse_name, arg_max(horse_id, (race_date, race_id, runner_no, horse_id)) AS horse_id FROM entries GROUP BY 1) last ON last.horse_name = w.name
GROUP BY ALL
""")
def jn6(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("horse_name"))
    works = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("works")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    out = J.resolve_names(works, entries(spark, sf, pedigree=True), "horse_name", "horse_id", ["race_date", "race_id", "runner_no"])
    return out.select(F.col("l_partkey").alias("work_part"), F.col("horse_name").alias("name"), "horse_id", "works")


@query("jn7_lookup_chain", E + """
, hist AS (SELECT * FROM entries WHERE year < 1998),
a AS (SELECT father, surface, (CAST(sum(is_win) AS DOUBLE) + 10.0::DOUBLE * 0.1::DOUBLE) / (count(*) + 10.0::DOUBLE) AS sire_rate FROM hist GROUP BY ALL),
b AS (SELECT trainer_id, (CAST(sum(is_top3) AS DOUBLE) + 20.0::DOUBLE * 0.25::DOUBLE) / (count(*) + 20.0::DOUBLE) AS trainer_rate FROM hist GROUP BY ALL),
c AS (SELECT jockey_id, course, (CAST(sum(is_win) AS DOUBLE) + 10.0::DOUBLE * 0.05::DOUBLE) / (count(*) + 10.0::DOUBLE) AS jockey_rate FROM hist GROUP BY ALL)
SELECT race_id, runner_no, coalesce(sire_rate, 0.1::DOUBLE) AS sire_rate, coalesce(trainer_rate, 0.25::DOUBLE) AS trainer_rate, coalesce(jockey_rate, 0.05::DOUBLE) AS jockey_rate
FROM entries LEFT JOIN a USING (father, surface) LEFT JOIN b USING (trainer_id) LEFT JOIN c USING (jockey_id, course) WHERE year >= 1998
""")
def jn7(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf, pedigree=True)
    hist = e.filter(F.col("year") < 1998)
    win, top3 = F.col("is_win"), F.col("is_top3")
    rate = lambda keys, hit, a, prior, name: smoothed_table(hist, keys, hit, a, prior, name).drop("n", "hits")
    out = J.lookup_chain(e.filter(F.col("year") >= 1998), [
        (rate(["father", "surface"], win, 10.0, 0.1, "sire_rate"), ["father", "surface"], "sire_rate", 0.1),
        (rate(["trainer_id"], top3, 20.0, 0.25, "trainer_rate"), ["trainer_id"], "trainer_rate", 0.25),
        (rate(["jockey_id", "course"], win, 10.0, 0.05, "jockey_rate"), ["jockey_id", "course"], "jockey_rate", 0.05),
    ])
    return out.select("race_id", "runner_no", "sire_rate", "trainer_rate", "jockey_rate")


@query("jn8_composite_key", """
WITH odds AS (SELECT CAST(o_orderdate AS DATE) AS d, o_custkey % 20 AS course, o_orderkey % 12 AS race_no, max(o_totalprice) AS price FROM orders GROUP BY ALL)
SELECT o_orderkey, price FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_custkey % 20 AS course, o_orderkey % 12 AS race_no FROM orders) JOIN odds USING (d, course, race_no)
""")
def jn8(spark: SparkSession, sf: str) -> DataFrame:
    key = ["race_date", "course", "race_no"]
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("race_date"), (F.col("o_custkey") % 20).alias("course"),
        (F.col("o_orderkey") % 12).alias("race_no"),
    )
    odds = o.groupBy(*key).agg(F.max("o_totalprice").alias("price"))
    return o.join(odds, key).select("o_orderkey", "price")


@query("jn9_predictions_with_results", RR + """
SELECT k.race_id, k.runner_no AS top_runner, k.odds AS top_odds, r.cond_key, r.trio_hit
FROM ranked k JOIN races r ON k.race_id = r.race_id WHERE k.pred_rank = 1 AND r.has_payout = 1
""")
def jn9(spark: SparkSession, sf: str) -> DataFrame:

    top = ranked(entries(spark, sf)).groupBy("race_id").agg(
        F.min_by("runner_no", "pred_rank").alias("top_runner"), F.min_by("odds", "pred_rank").alias("top_odds")
    )
    settled = races(spark, sf).filter(F.col("has_payout") == 1).select("race_id", "cond_key", "trio_hit")
    return top.join(settled, "race_id")


@query("jn10_settle_or_pending", RR + """
SELECT race_id, cond_key, CASE WHEN has_payout = 1 THEN 'settled' ELSE 'pending' END AS status,
       CASE WHEN has_payout = 1 THEN trio_hit * trio_yen - 700 END AS profit FROM races
""")
def jn10(spark: SparkSession, sf: str) -> DataFrame:
    r = races(spark, sf)
    results = r.filter(F.col("has_payout") == 1).select("race_id", "trio_hit", "trio_yen")
    return J.settle_ledger(r.select("race_id", "cond_key"), results, "race_id", "trio_hit", "trio_yen").select("race_id", "cond_key", "status", "profit")


@query("jn11_fuzzy_names", """
WITH o AS (SELECT p_name AS key, min(p_partkey) AS pos, (min(p_partkey) % 50) / 100.0::DOUBLE AS rate FROM part WHERE p_size <= 7 AND length(p_name) > 8 GROUP BY 1),
r AS (SELECT substr(p_name, 1, 6) AS key, min(p_partkey) AS pos, (min(p_partkey) % 40) / 100.0::DOUBLE AS rate FROM part WHERE p_size >= 46 GROUP BY 1),
n AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 3) WHEN 2 THEN 'x ' || p_name ELSE substr(p_name, 1, 4) END AS name FROM part)
SELECT name, coalesce((SELECT arg_min(rate, pos) FROM o WHERE key = name), (SELECT arg_min(rate, pos) FROM r WHERE key = name),
  (SELECT arg_min(rate, pos) FROM o WHERE contains(name, key) OR contains(key, name)),
  (SELECT arg_min(rate, pos) FROM r WHERE starts_with(name, key) OR starts_with(key, name)), 0.05::DOUBLE) AS rate
FROM n
""")
def jn11(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    key, name = F.col("p_partkey"), F.col("p_name")
    pos = F.min("p_partkey")
    rates = lambda df, text, m: df.groupBy(text.alias("key")).agg(pos.alias("pos"), (pos % m / 100.0).alias("rate"))
    names = part.select(
        F.when(key % 4 == 0, name).when(key % 4 == 1, F.substring(name, 3, 100)).when(key % 4 == 2, F.concat(F.lit("x "), name))
        .otherwise(F.substring(name, 1, 4)).alias("name")
    ).distinct()
    overrides = rates(part.filter((F.col("p_size") <= 7) & (F.length(name) > 8)), name, 50)
    table2 = rates(part.filter(F.col("p_size") >= 46), F.substring(name, 1, 6), 40)
    return J.fuzzy_rate(names, "name", overrides, table2, 0.05, "rate")


@query("jn12_bets_with_payouts", RR + """
, b AS (
  SELECT DISTINCT a.race_id, list_sort([a.runner_no, s.runner_no, t.runner_no]) AS combo
  FROM ranked a JOIN ranked s ON s.race_id = a.race_id AND s.pred_rank IN (2, 3) JOIN ranked t ON t.race_id = a.race_id AND t.pred_rank BETWEEN 2 AND 6 AND t.pred_rank <> s.pred_rank
  WHERE a.pred_rank = 1 AND a.field >= 3
),
p AS (SELECT race_id, list_sort([f1, f2, f3]) AS combo, trio_yen AS yen FROM races WHERE has_payout = 1)
SELECT race_id, count(*) AS bets, count(yen) AS hits, CAST(coalesce(sum(yen), 0) AS BIGINT) AS paid FROM b LEFT JOIN p USING (race_id, combo) GROUP BY race_id
""")
def jn12(spark: SparkSession, sf: str) -> DataFrame:
    r = races(spark, sf)
    payouts = r.filter(F.col("has_payout") == 1).select("race_id", F.col("top3").alias("combo"), F.col("trio_yen").alias("yen"))
    return J.match_bets(r.select("race_id", F.col("trio_bets").alias("bets")), payouts, "race_id")


@query("jn13_semi_anti", with_views(LEDGER) + """
SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, 'open' AS state FROM ledger WHERE entity NOT IN (SELECT entity FROM ledger WHERE hit = 1 AND entity IS NOT NULL) GROUP BY 1
UNION ALL
SELECT CAST(day AS VARCHAR), count(*), 'known' FROM ledger WHERE entity IN (SELECT entity FROM ledger WHERE hit = 1) GROUP BY 1
""")
def jn13(spark: SparkSession, sf: str) -> DataFrame:
    rows = ledger(spark, sf)
    done = rows.filter(F.col("hit") == 1).select("entity").distinct()
    count = lambda df, state: df.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n")).withColumn("state", F.lit(state))
    return count(rows.join(done, "entity", "left_anti"), "open").unionByName(count(rows.join(done, "entity", "left_semi"), "known"))


@query("jn14_equal_sample", RR + """
SELECT race_id, cond_key, trio_hit FROM (SELECT *, row_number() OVER (PARTITION BY cond_key ORDER BY md5(CAST(race_id AS VARCHAR)), race_id) AS rn FROM races WHERE has_payout = 1) WHERE rn <= 50
""")
def jn14(spark: SparkSession, sf: str) -> DataFrame:
    r = races(spark, sf).filter(F.col("has_payout") == 1).select("race_id", "cond_key", "trio_hit")
    return J.equal_sample(r, "cond_key", "race_id", 50)


GRID_DISTANCE = [(1000, 1400), (1400, 1800), (1600, 2200), (1800, 2600), (1000, 2600)]
GRID_FIELD = [(2, 7), (8, 14), (12, 18), (2, 40)]
GRID_GOING = [(0,), (0, 1), (2, 3), (0, 1, 2, 3)]
SEASONS = ["spring", "summer", "autumn", "winter"]

GRID_SQL = """
, gd(dlo, dhi) AS (VALUES (1000, 1400), (1400, 1800), (1600, 2200), (1800, 2600), (1000, 2600)),
gf(flo, fhi) AS (VALUES (2, 7), (8, 14), (12, 18), (2, 40)),
gg(gs, glo, ghi) AS (VALUES ('0', 0, 0), ('01', 0, 1), ('23', 2, 3), ('0123', 0, 3)),
gs(se) AS (VALUES ('all'), ('spring'), ('summer'), ('autumn'), ('winter')),
grid AS (
  SELECT dlo || '-' || dhi AS f_distance, flo || '-' || fhi AS f_field, gs AS f_going, se AS f_season, r.*
  FROM races r JOIN gd ON r.distance BETWEEN dlo AND dhi JOIN gf ON r.num_horses BETWEEN flo AND fhi JOIN gg ON r.going BETWEEN glo AND ghi JOIN gs ON se IN ('all', r.season)
)
"""


@query("jn15_filter_grid", RR + GRID_SQL + """
SELECT f_distance, f_field, f_going, f_season, count(*) AS n, CAST(sum(trio_hit) AS BIGINT) AS hits FROM grid GROUP BY ALL
""")
def jn15(spark: SparkSession, sf: str) -> DataFrame:
    cells = races(spark, sf).groupBy("distance", "num_horses", "going", "season").agg(F.count("*").alias("n"), F.sum("trio_hit").alias("hits"))
    grid = J.filter_grid(cells, GRID_DISTANCE, GRID_FIELD, GRID_GOING, SEASONS)
    return grid.groupBy("f_distance", "f_field", "f_going", "f_season").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
