"""History and window operators (WN*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.functions import columns as C
from formline.operators import groups as G
from formline.operators import history as H
from formline.operators import inrace as I
from formline.plans.registry import query
from formline.plans.views import LEDGER, E, entries, ledger, with_views

ROW = ["race_id", "runner_no"]

# name: (keys, hit, alpha, prior taken from the table)
RATES = {
    "jockey": (["jockey_id"], "is_win", 30.0),
    "jockey_course": (["jockey_id", "course"], "is_win", 10.0),
    "jockey_surface": (["jockey_id", "surface"], "is_win", 10.0),
    "trainer": (["trainer_id"], "is_top3", 20.0),
    "horse": (["horse_id"], "is_win", 5.0),
    "horse_top3": (["horse_id"], "is_top3", 5.0),
    "sire_surface": (["father", "surface"], "is_win", 50.0),
    "sire_dist": (["father", "dist_cat"], "is_win", 50.0),
    "bms_surface": (["bms", "surface"], "is_win", 50.0),
    "horse_dist": (["horse_id", "dist_cat"], "is_top3", 5.0),
    "horse_surface": (["horse_id", "surface"], "is_top3", 5.0),
    "course_dist_bracket": (["course", "dist_cat", "bracket"], "is_win", 100.0),
    "jockey_dist": (["jockey_id", "dist_cat"], "is_win", 20.0),
    "horse_course": (["horse_id", "course"], "is_top3", 3.0),
    "horse_season": (["horse_id", "season"], "is_top3", 3.0),
    "trainer_jockey": (["trainer_id", "jockey_id"], "is_win", 10.0),
    "sire_age": (["father", "age"], "is_win", 30.0),
    "horse_distance": (["horse_id", "distance"], "is_top3", 3.0),
}

FEATURES_SQL = E + """
, feats AS (
  SELECT *, CAST(CASE WHEN distance <= 1200 THEN 0 WHEN distance <= 1400 THEN 1 WHEN distance <= 1800 THEN 2 WHEN distance <= 2200 THEN 3 ELSE 4 END AS BIGINT) AS dist_cat,
         least(8, greatest(1, (runner_no - 1) * 8 // greatest(num_horses, 1) + 1)) AS bracket,
         CASE WHEN month IN (3,4,5) THEN 0 WHEN month IN (6,7,8) THEN 1 WHEN month IN (9,10,11) THEN 2 ELSE 3 END AS season
  FROM entries
)"""


def feature_rows(spark: SparkSession, sf: str, pedigree: bool) -> DataFrame:
    return entries(spark, sf, pedigree=pedigree).withColumns({
        "dist_cat": C.cut_named("distance", "distance").cast("bigint"),
        "bracket": C.bracket(F.col("runner_no"), F.col("num_horses")),
        "season": C.season_code(F.col("month")),
    })


def _day_sql(keys: list[str], hit: str, alpha: float) -> str:
    k = ", ".join(keys)
    return FEATURES_SQL + f"""
, state AS (
  SELECT race_id, runner_no, count(*) OVER w AS n, coalesce(sum({hit}) OVER w, 0) AS h FROM feats
  WINDOW w AS (PARTITION BY {k} ORDER BY race_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)
)
SELECT race_id, runner_no, (CAST(h AS DOUBLE) + (SELECT avg(CAST({hit} AS DOUBLE)) FROM entries) * {alpha}::DOUBLE) / (CAST(n AS DOUBLE) + {alpha}::DOUBLE) AS rate FROM state
"""


def _register_rate(name: str, keys: list[str], hit: str, alpha: float) -> None:
    pedigree = bool({"father", "bms", "age"} & set(keys))

    @query(f"wn1_expanding_rate_{name}", _day_sql(keys, hit, alpha))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return H.expanding_rate(feature_rows(spark, sf, pedigree), keys, F.col(hit), alpha, "rate").select(*ROW, "rate")


for _name, (_keys, _hit, _alpha) in RATES.items():
    _register_rate(_name, _keys, _hit, _alpha)


TOGETHER = {
    "horse_id": {n: RATES[n] for n in ("horse", "horse_top3", "horse_dist", "horse_surface", "horse_course", "horse_season", "horse_distance")},
    "jockey_id": {n: RATES[n] for n in ("jockey", "jockey_course", "jockey_surface", "jockey_dist")},
}


def _together_sql(lead: str) -> str:
    state, rate = [], []
    for name, (keys, hit, alpha) in TOGETHER[lead].items():
        w = f"(PARTITION BY {', '.join(keys)} ORDER BY race_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"
        state.append(f"count(*) OVER {w} AS n_{name}, coalesce(sum({hit}) OVER {w}, 0) AS h_{name}")
        rate.append(
            f"(CAST(h_{name} AS DOUBLE) + (SELECT avg(CAST({hit} AS DOUBLE)) FROM entries) * {alpha}::DOUBLE) / (CAST(n_{name} AS DOUBLE) + {alpha}::DOUBLE) AS {name}"
        )
    return FEATURES_SQL + f", state AS (SELECT race_id, runner_no, {', '.join(state)} FROM feats) SELECT race_id, runner_no, {', '.join(rate)} FROM state"


def _register_together(lead: str) -> None:
    families = {n: ([k for k in keys if k != lead], hit, alpha) for n, (keys, hit, alpha) in TOGETHER[lead].items()}

    @query(f"wn1_rates_together_{lead.removesuffix('_id')}", _together_sql(lead))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        live = {n: (keys, F.col(hit), alpha) for n, (keys, hit, alpha) in families.items()}
        return H.expanding_rates(feature_rows(spark, sf, False), lead, live).select(*ROW, *live)


for _lead in TOGETHER:
    _register_together(_lead)


@query("wn1_expanding_rate_row_order", E + """
, s AS (SELECT race_id, runner_no, count(*) OVER w AS n, coalesce(sum(is_win) OVER w, 0) AS h FROM entries WINDOW w AS (PARTITION BY jockey_id ORDER BY race_date, race_id, runner_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT race_id, runner_no, (CAST(h AS DOUBLE) + 0.08::DOUBLE * 30.0::DOUBLE) / (CAST(n AS DOUBLE) + 30.0::DOUBLE) AS rate FROM s
""")
def wn1_row(spark: SparkSession, sf: str) -> DataFrame:
    return H.expanding_rate(entries(spark, sf), ["jockey_id"], F.col("is_win"), 30.0, "rate", prior=0.08, mode="row").select(*ROW, "rate")


@query("wn2_gated_rates_by_day", E + """
, s AS (SELECT race_id, runner_no, count(*) OVER j AS jn, coalesce(sum(is_win) OVER j, 0) AS jh, count(*) OVER h AS hn, coalesce(sum(is_top3) OVER h, 0) AS hh FROM entries
  WINDOW j AS (PARTITION BY jockey_id ORDER BY race_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), h AS (PARTITION BY horse_id ORDER BY race_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT race_id, runner_no, CASE WHEN jn >= 5 THEN CAST(jh AS DOUBLE) / jn ELSE 0.08::DOUBLE END AS jockey_rate, CASE WHEN hn >= 2 THEN CAST(hh AS DOUBLE) / hn ELSE 0.25::DOUBLE END AS horse_rate FROM s
""")
def wn2(spark: SparkSession, sf: str) -> DataFrame:
    out = H.gated_rate(entries(spark, sf), ["jockey_id"], F.col("is_win"), "jockey_rate", 5, 0.08)
    return H.gated_rate(out, ["horse_id"], F.col("is_top3"), "horse_rate", 2, 0.25).select(*ROW, "jockey_rate", "horse_rate")


@query("wn3_rates_by_race", E + """
, c AS (SELECT trainer_id, race_date, race_id, count(*) AS n, sum(is_top3) AS h FROM entries GROUP BY ALL),
s AS (SELECT trainer_id, race_id, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(h) OVER w, 0) AS h FROM c WINDOW w AS (PARTITION BY trainer_id ORDER BY race_date, race_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT e.race_id, e.runner_no, CAST(s.h AS DOUBLE) / greatest(s.n, 1) AS rate FROM entries e JOIN s ON s.trainer_id = e.trainer_id AND s.race_id = e.race_id
""")
def wn3(spark: SparkSession, sf: str) -> DataFrame:
    return H.gated_rate(entries(spark, sf), ["trainer_id"], F.col("is_top3"), "rate", 0, 0.0, mode="race").select(*ROW, "rate")


@query("wn4_gated_rates_by_row", E + """
, s AS (SELECT race_id, runner_no, count(*) OVER j AS jn, coalesce(sum(is_win) OVER j, 0) AS jh, count(*) OVER t AS tn, coalesce(sum(is_top3) OVER t, 0) AS th FROM entries
  WINDOW j AS (PARTITION BY jockey_id ORDER BY race_date, race_id, runner_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t AS (PARTITION BY trainer_id ORDER BY race_date, race_id, runner_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT race_id, runner_no, CASE WHEN jn >= 10 THEN CAST(jh AS DOUBLE) / jn ELSE 0.08::DOUBLE END AS jockey_rate, CASE WHEN tn >= 10 THEN CAST(th AS DOUBLE) / tn ELSE 0.25::DOUBLE END AS trainer_rate FROM s
""")
def wn4(spark: SparkSession, sf: str) -> DataFrame:
    out = H.gated_rate(entries(spark, sf), ["jockey_id"], F.col("is_win"), "jockey_rate", 10, 0.08, mode="row")
    return H.gated_rate(out, ["trainer_id"], F.col("is_top3"), "trainer_rate", 10, 0.25, mode="row").select(*ROW, "jockey_rate", "trainer_rate")


LAG_WINDOW = "WINDOW w AS (PARTITION BY horse_id ORDER BY race_date, race_id, runner_no)"


@query("wn5_lags", E + f"""
SELECT race_id, runner_no, coalesce(lag(finish, 1) OVER w, 5) AS prev_finish, coalesce(lag(finish, 5) OVER w, 5) AS prev5_finish, coalesce(lag(last3f, 2) OVER w, 35.5::DOUBLE) AS prev2_last3f,
       coalesce(lag(pass4, 1) OVER w, 8) AS prev_pass4, coalesce(lag(prize, 3) OVER w, 0.0::DOUBLE) AS prev3_prize, coalesce(lag(odds, 1) OVER w, 15.0::DOUBLE) AS prev_odds,
       coalesce(lag(distance, 1) OVER w, distance) AS prev_distance, coalesce(lag(carry, 1) OVER w, carry) AS prev_carry, lag(race_date, 1) OVER w AS prev_date
FROM entries {LAG_WINDOW}
""")
def wn5(spark: SparkSession, sf: str) -> DataFrame:
    out = H.starts(entries(spark, sf), cols=["finish", "last3f", "pass4", "prize", "odds", "distance", "carry", "race_date"])
    prev = H.previous_start
    return out.select(
        *ROW, prev(1, "finish", F.lit(5)).alias("prev_finish"), prev(5, "finish", F.lit(5)).alias("prev5_finish"),
        prev(2, "last3f", F.lit(35.5)).alias("prev2_last3f"), prev(1, "pass4", F.lit(8)).alias("prev_pass4"),
        prev(3, "prize", F.lit(0.0)).alias("prev3_prize"), prev(1, "odds", F.lit(15.0)).alias("prev_odds"),
        prev(1, "distance", F.col("distance")).alias("prev_distance"), prev(1, "carry", F.col("carry")).alias("prev_carry"),
        prev(1, "race_date").alias("prev_date"),
    )


@query("wn6_form_features", E + f"""
, l AS (SELECT race_id, runner_no, CAST(coalesce(lag(finish, 1) OVER w, 5) AS DOUBLE) AS p1, CAST(coalesce(lag(finish, 2) OVER w, 5) AS DOUBLE) AS p2, CAST(coalesce(lag(finish, 3) OVER w, 5) AS DOUBLE) AS p3 FROM entries {LAG_WINDOW})
SELECT race_id, runner_no, (p1 + p2 + p3) / 3.0::DOUBLE AS avg_finish_3r, least(p1, p2, p3) AS best_finish_3r, CAST(p1 <= 3 AS BIGINT) + CAST(p2 <= 3 AS BIGINT) + CAST(p3 <= 3 AS BIGINT) AS top3_count_3r,
       p3 - p1 AS finish_trend, p1 * 0.5::DOUBLE + p2 * 0.3::DOUBLE + p3 * 0.2::DOUBLE AS weighted_finish FROM l
""")
def wn6(spark: SparkSession, sf: str) -> DataFrame:
    out = H.form_features(H.starts(entries(spark, sf), cols=["finish"], depth=3))
    return out.select(*ROW, "avg_finish_3r", "best_finish_3r", "top3_count_3r", "finish_trend", "weighted_finish")


@query("wn7_rest_days", E + f"""
, l AS (SELECT race_id, runner_no, race_date, lag(race_date) OVER w AS p FROM entries {LAG_WINDOW})
SELECT race_id, runner_no, CAST(least(365, greatest(1, coalesce(race_date - p, 30))) AS BIGINT) AS rest_days,
       CAST(least(365, greatest(1, coalesce(CAST(strftime(race_date, '%Y%m%d') AS BIGINT) - CAST(strftime(p, '%Y%m%d') AS BIGINT), 30))) AS BIGINT) AS rest_days_compat FROM l
""")
def wn7(spark: SparkSession, sf: str) -> DataFrame:
    out = H.starts(entries(spark, sf), cols=["race_date"], depth=1)
    before = H.previous_start(1, "race_date")
    return out.select(
        *ROW, H.rest_days(F.col("race_date"), before).alias("rest_days"), H.rest_days(F.col("race_date"), before, compat=True).alias("rest_days_compat")
    )


@query("wn8_ranks_in_race", E + """
SELECT race_id, runner_no, rank() OVER (PARTITION BY race_id ORDER BY prize DESC) AS prize_rank, CAST(rank() OVER (PARTITION BY race_id ORDER BY prize DESC) AS DOUBLE) / field AS prize_rank_ratio,
       rank() OVER (PARTITION BY race_id ORDER BY CASE WHEN o > 0 THEN o ELSE 9999.0::DOUBLE END) AS pop_rank, CASE WHEN o > 0 THEN rank() OVER (PARTITION BY race_id ORDER BY CASE WHEN o > 0 THEN 0 ELSE 1 END, last3f) END AS last3f_rank
FROM (SELECT *, CASE WHEN runner_no % 5 = 0 THEN 0.0::DOUBLE ELSE odds END AS o FROM entries)
""")
def wn8(spark: SparkSession, sf: str) -> DataFrame:
    race = ["race_id"]
    out = entries(spark, sf).withColumn("o", F.when(F.col("runner_no") % 5 == 0, 0.0).otherwise(F.col("odds")))
    prize = I.min_rank(race, F.desc("prize"))
    return out.select(
        *ROW, prize.alias("prize_rank"), (prize / F.col("field")).alias("prize_rank_ratio"), I.popularity(race, F.col("o")).alias("pop_rank"),
        I.min_rank(race, F.asc("last3f"), F.col("o") > 0).alias("last3f_rank"),
    )


@query("wn9_average_rank", E + """
SELECT race_id, runner_no, CAST(floor(rank() OVER (PARTITION BY race_id ORDER BY s DESC) + (count(*) OVER (PARTITION BY race_id, s) - 1) / 2.0::DOUBLE) AS BIGINT) AS ai_rank
FROM (SELECT *, floor(score * 10.0::DOUBLE) AS s FROM entries)
""")
def wn9(spark: SparkSession, sf: str) -> DataFrame:
    out = entries(spark, sf).withColumn("s", F.floor(F.col("score") * 10.0))
    return out.select(*ROW, I.average_rank_floor(["race_id"], "s").alias("ai_rank"))


@query("wn10_deviation", E + """
SELECT race_id, runner_no, round(carry - avg(carry) OVER (PARTITION BY race_id), 6) AS carry_diff, round(carry - (SELECT avg(carry) FROM entries), 6) AS carry_diff_global, carry - 55.0::DOUBLE AS carry_diff_fixed FROM entries
""")
def wn10(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    mean = e.select(F.avg("carry").alias("m")).scalar()
    return e.select(
        *ROW, F.round(I.deviation(["race_id"], "carry"), 6).alias("carry_diff"), F.round(F.col("carry") - mean, 6).alias("carry_diff_global"),
        (F.col("carry") - 55.0).alias("carry_diff_fixed"),
    )


@query("wn11_group_size", "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem")
def wn11(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", I.group_size(["l_orderkey"]).alias("n"))


@query("wn12_first_last_per_key", E + """
SELECT horse_id, arg_min(race_id, (race_date, race_id, runner_no)) AS first_race, arg_max(race_id, (race_date, race_id, runner_no)) AS last_race, arg_max(finish, (race_date, race_id, runner_no)) AS last_finish FROM entries GROUP BY 1
""")
def wn12(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    first = H.last_value(e, ["horse_id"], H.EXACT_ORDER, ["race_id"], first=True).withColumnRenamed("race_id", "first_race")
    last = H.last_value(e, ["horse_id"], H.EXACT_ORDER, ["race_id", "finish"]).withColumnsRenamed({"race_id": "last_race", "finish": "last_finish"})
    return first.join(last, "horse_id")


@query("wn13_recent_profile", E + """
, s AS (SELECT *, rank() OVER (PARTITION BY race_id ORDER BY odds) AS popularity, CAST(distance AS DOUBLE) * 0.06::DOUBLE + CAST(runner_no AS DOUBLE) AS time, row_number() OVER (PARTITION BY horse_id ORDER BY race_date, race_id, runner_no) AS k FROM entries),
j AS (SELECT a.race_id, a.runner_no, a.distance, a.surface, a.course, a.race_date, b.finish, b.popularity, b.pass4, b.last3f, b.time, b.distance AS bd, b.surface AS bs, b.course AS bc, b.race_date AS bdate, b.k AS bk
  FROM s a LEFT JOIN s b ON a.horse_id = b.horse_id AND b.k BETWEEN a.k - 10 AND a.k - 1),
g AS (SELECT race_id, runner_no, CAST(sum(finish) FILTER (abs(bd - distance) <= 200) AS DOUBLE) / count(*) FILTER (abs(bd - distance) <= 200) AS d, CAST(sum(finish) FILTER (bs = surface) AS DOUBLE) / count(*) FILTER (bs = surface) AS su,
  CAST(sum(finish) FILTER (bc = course) AS DOUBLE) / count(*) FILTER (bc = course) AS c, CAST(sum(popularity) AS DOUBLE) / count(popularity) AS p, CAST(sum(pass4) AS DOUBLE) / count(pass4) AS ap, avg(last3f) AS al,
  count(*) FILTER (finish <= 3) AS t3, count(finish) AS n, max(race_date) - max(bdate) AS gap, min(time) FILTER (time / bd BETWEEN 0.05::DOUBLE AND 0.09::DOUBLE) AS bt FROM j GROUP BY ALL)
SELECT race_id, runner_no, round(CASE WHEN d IS NULL OR isnan(d) THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (d - 1.0::DOUBLE) / 17.0::DOUBLE)) END, 9) AS dist_apt,
  round(CASE WHEN su IS NULL OR isnan(su) THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (su - 1.0::DOUBLE) / 17.0::DOUBLE)) END, 9) AS surf_apt,
  round(CASE WHEN c IS NULL OR isnan(c) THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (c - 1.0::DOUBLE) / 17.0::DOUBLE)) END, 9) AS course_apt,
  round(CASE WHEN n = 0 THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (p - 1.0::DOUBLE) / 17.0::DOUBLE)) END, 9) AS pop_score,
  round(al, 6) AS avg_last3f, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE CAST(t3 AS DOUBLE) / n END AS place_rate, CAST(CASE WHEN n = 0 THEN 30 ELSE greatest(gap, 1) END AS BIGINT) AS interval_days,
  round(bt, 6) AS best_time, CAST(CASE WHEN n = 0 THEN 0 WHEN ap <= 2 THEN 1 WHEN ap <= 5 THEN 2 WHEN ap <= 10 THEN 3 ELSE 4 END AS BIGINT) AS running_style FROM g
""")
def wn13(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf).withColumns({
        "popularity": I.min_rank(["race_id"], F.asc("odds")), "time": F.col("distance").cast("double") * 0.06 + F.col("runner_no").cast("double"),
    })
    out = H.recent_profile(e)
    near = lambda c, k=9: F.round(c, k).alias(c)
    return out.select(
        *ROW, near("dist_apt"), near("surf_apt"), near("course_apt"), near("pop_score"), near("avg_last3f", 6), "place_rate",
        F.col("interval_days").cast("bigint").alias("interval_days"), near("best_time", 6), "running_style",
    )


@query("wn14_drawdown", with_views(LEDGER) + """
, c AS (SELECT *, sum(payout - 100) OVER (PARTITION BY cond_key ORDER BY day, ts, race_id ROWS UNBOUNDED PRECEDING) AS cum, sum(hit) OVER (PARTITION BY cond_key ORDER BY day, ts, race_id ROWS UNBOUNDED PRECEDING) AS island FROM ledger),
p AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY cond_key ORDER BY day, ts, race_id ROWS UNBOUNDED PRECEDING)) AS peak FROM c),
r AS (SELECT *, sum(CASE WHEN cum >= peak THEN 1 ELSE 0 END) OVER (PARTITION BY cond_key ORDER BY day, ts, race_id ROWS UNBOUNDED PRECEDING) AS top FROM p),
s AS (SELECT cond_key, island, count(*) AS len FROM c WHERE hit = 0 GROUP BY ALL), q AS (SELECT cond_key, top, count(*) AS len FROM r WHERE cum < peak GROUP BY ALL)
SELECT p.cond_key, count(*) AS rows, CAST(arg_max(cum, (day, ts, race_id)) AS BIGINT) AS final_profit, CAST(max(peak) AS BIGINT) AS peak, CAST(max(peak - cum) AS BIGINT) AS max_drawdown, count(*) FILTER (cum < peak) AS rows_below_peak,
  (SELECT max(len) FROM s WHERE s.cond_key = p.cond_key) AS longest_streak, (SELECT avg(len) FROM s WHERE s.cond_key = p.cond_key) AS mean_streak, (SELECT count(*) FROM s WHERE s.cond_key = p.cond_key) AS streaks,
  (SELECT max(len) FROM q WHERE q.cond_key = p.cond_key) AS longest_recovery FROM p GROUP BY p.cond_key
""")
def wn14(spark: SparkSession, sf: str) -> DataFrame:
    rows = ledger(spark, sf).withColumn("profit", F.col("payout") - 100)
    return I.ledger_runs(rows, ["cond_key"], ["day", "ts", "race_id"], "profit", "hit")


@query("wn15_previous_races_of_day", E + """
, r AS (SELECT course, race_date, race_id, sum(CASE WHEN pass4 <= 3 THEN is_top3 ELSE 0 END) AS front, sum(finish) AS finishes, count(*) AS runners FROM entries GROUP BY ALL)
SELECT course, race_date, race_id, CAST(coalesce(sum(front) OVER w, 0) AS BIGINT) AS prev_front, CAST(coalesce(sum(finishes) OVER w, 0) AS BIGINT) AS prev_finishes, CAST(coalesce(sum(runners) OVER w, 0) AS BIGINT) AS prev_runners, count(*) OVER w AS prev_races
FROM r WINDOW w AS (PARTITION BY course, race_date ORDER BY race_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
""")
def wn15(spark: SparkSession, sf: str) -> DataFrame:
    sums = {"front": F.when(F.col("pass4") <= 3, F.col("is_top3")).otherwise(0), "finishes": F.col("finish"), "runners": F.lit(1).cast("bigint")}
    # A real venue-day has a dozen races; here its size grows with the data, so it is cut by the race number.
    return G.previous_races(entries(spark, sf), ["course", "race_date"], ["race_id"], sums, chunk=F.floor(F.col("race_id") / 1000))


@query("wn16_best_time_score", E + """
, t AS (SELECT race_id, runner_no, CASE WHEN runner_no % 4 = 0 THEN 0.0::DOUBLE ELSE last3f END AS x FROM entries),
m AS (SELECT *, count(CASE WHEN x > 0 THEN x END) OVER w AS n, min(CASE WHEN x > 0 THEN x END) OVER w AS lo, max(CASE WHEN x > 0 THEN x END) OVER w AS hi FROM t WINDOW w AS (PARTITION BY race_id))
SELECT race_id, runner_no, round(CASE WHEN n < 2 THEN 0.5::DOUBLE WHEN hi > lo THEN CASE WHEN x > 0 THEN 1.0::DOUBLE - (x - lo) / (hi - lo) ELSE 0.5::DOUBLE END WHEN x > 0 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END, 9) AS time_score FROM m
""")
def wn16(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(F.col("runner_no") % 4 == 0, 0.0).otherwise(F.col("last3f"))
    return entries(spark, sf).select(*ROW, F.round(I.best_time_score(["race_id"], x), 9).alias("time_score"))


@query("wn17_score_share", E + """
SELECT race_id, runner_no, round(score / sum(score) OVER (PARTITION BY race_id), 6) AS share FROM entries
""")
def wn17(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select(*ROW, F.round(I.share(["race_id"], "score"), 6).alias("share"))
