"""Return reports (AG13-AG17, AG20, AG22-AG32, AG41, AG45, AG46) and top-k lists (SR1-SR3, SR6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline import constants as K
from formline.functions import bets as B
from formline.functions import columns as C
from formline.operators import joins as J
from formline.operators import roi as Q
from formline.plans.betting import EV_SQL, race_values
from formline.plans.joining import GRID_DISTANCE, GRID_FIELD, GRID_GOING, GRID_SQL, SEASONS
from formline.plans.registry import query
from formline.plans.views import LEDGER, RR, E, R, entries, ledger, races, ranked, with_views

D = "::DOUBLE"


def _sums_sql(tickets: dict[str, tuple[str, str]]) -> str:
    return "count(*) AS n, " + ", ".join(
        f"CAST(sum({h}) AS BIGINT) AS {t}_hits, CAST(sum({p}) AS DOUBLE) AS {t}_paid" for t, (h, p) in tickets.items()
    )


def _rates_sql(tickets) -> str:
    return ", ".join(
        f"CAST({t}_hits AS DOUBLE) / n * 100.0{D} AS {t}_hit_rate, {t}_paid / CAST(n * 700 AS DOUBLE) * 100.0{D} AS {t}_roi" for t in tickets
    )


def report_sql(source: str, keys: str, tickets, where: str = "true", min_n: int = 1) -> str:
    order = " ".join(f"WHEN {t}_roi = best_roi THEN '{t}'" for t in tickets)
    best = ", ".join(f"{t}_roi" for t in tickets)
    return f"""
SELECT *, CASE {order} END AS best_bet, CAST(CASE WHEN best_roi >= 120 THEN 3 WHEN best_roi >= 100 THEN 2 WHEN best_roi >= 80 THEN 1 ELSE 0 END AS BIGINT) AS stars, best_roi >= 80 AS recommended
FROM (SELECT *, greatest({best}) AS best_roi FROM (SELECT *, {_rates_sql(tickets)} FROM (SELECT {keys}, {_sums_sql(tickets)} FROM {source} WHERE {where} GROUP BY ALL HAVING count(*) >= {min_n})))
"""


@query("ag13_roi_estimated", RR + report_sql("races", "cond_key", Q.TICKETS, min_n=30))
def ag13(spark: SparkSession, sf: str) -> DataFrame:
    return Q.report(races(spark, sf), ["cond_key"], Q.TICKETS, min_n=30)


@query("ag14_roi_actual", RR + f"""
SELECT a.*, b.est_trio_roi, a.best_roi >= 100 AS profitable FROM ({report_sql("races", "cond_key", Q.ACTUAL, "has_payout = 1")}) a
JOIN (SELECT cond_key, CAST(sum(est_trio_return) AS DOUBLE) / CAST(count(*) * 700 AS DOUBLE) * 100.0::DOUBLE AS est_trio_roi FROM races WHERE has_payout = 1 GROUP BY 1) b USING (cond_key)
""")
def ag14(spark: SparkSession, sf: str) -> DataFrame:
    paid = races(spark, sf).filter("has_payout = 1")
    sums = [*Q.sums(Q.ACTUAL), F.sum("est_trio_return").alias("__est")]
    out = Q.best_ticket(Q.rates(paid.groupBy("cond_key").agg(*sums), list(Q.ACTUAL)), list(Q.ACTUAL))
    return out.withColumns({"est_trio_roi": Q.roi_percent(F.col("__est"), F.col("n")), "profitable": F.col("best_roi") >= 100}).drop("__est")


AXES = ("cond_key", "dist", "nh", "cond", "course_name", "class", "season", "surface")
CROSS = (("cond_key", "surface"), ("dist", "cond"), ("course_name", "dist"), ("surface", "dist"))
LONG_SQL = ", axes AS (" + " UNION ALL ".join(
    [f"SELECT '{a.replace('course_name', 'course')}' AS axis, {a} AS label, * FROM races" for a in AXES]
    + [f"SELECT '{a.replace('course_name', 'course')}_x_{b}' AS axis, {a} || '_' || {b} AS label, * FROM races" for a, b in CROSS]
) + ")"


@query("ag15_multi_axis_roi", RR + LONG_SQL + report_sql("axes", "axis, label", Q.TICKETS, min_n=30))
def ag15(spark: SparkSession, sf: str) -> DataFrame:
    return Q.report(Q.by_axes(races(spark, sf), Q.standard_axes()), ["axis", "label"], Q.TICKETS, min_n=30)


@query("ag16_roi_by_year", RR + """
, y AS (SELECT cond_key, year, count(*) AS n, CAST(sum(trio_hit) AS BIGINT) AS hits, sum(trio_return) / CAST(count(*) * 700 AS DOUBLE) * 100.0::DOUBLE AS roi FROM races WHERE has_payout = 1 GROUP BY ROLLUP (cond_key, year))
SELECT coalesce(cond_key, 'ALL') AS cond_key, coalesce(year, 0) AS year, n, hits, roi FROM y
""")
def ag16(spark: SparkSession, sf: str) -> DataFrame:
    rows = races(spark, sf).filter("has_payout = 1").rollup("cond_key", "year").agg(
        F.count("*").alias("n"), F.sum("trio_hit").alias("hits"), F.sum("trio_return").alias("paid")
    )
    return rows.select(
        F.coalesce("cond_key", F.lit("ALL")).alias("cond_key"), F.coalesce("year", F.lit(0)).alias("year"), "n", "hits",
        Q.roi_percent(F.col("paid"), F.col("n")).alias("roi"),
    )


@query("ag16_yearly_pivot", RR + f"SELECT cond_key, year, sum(trio_return) / CAST(count(*) * 700 AS DOUBLE) * 100.0{D} AS roi FROM races GROUP BY 1, 2")
def ag16_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """One row per class and year, for all years that the table holds."""
    return races(spark, sf).groupBy("cond_key", "year").agg((F.sum("trio_return") / (F.count("race_id") * 700).cast("double") * 100.0).alias("roi"))


@query("ag17_roi_by_calendar_and_class", RR + """
, x AS (
  SELECT 'month' AS axis, CAST(month AS VARCHAR) AS label, trio_hit, trio_return FROM races UNION ALL SELECT 'season', season, trio_hit, trio_return FROM races
  UNION ALL SELECT 'course', course_name, trio_hit, trio_return FROM races UNION ALL SELECT 'class', class, trio_hit, trio_return FROM races
  UNION ALL SELECT 'surface', surface, trio_hit, trio_return FROM races UNION ALL SELECT 'cond_surface', cond_key || '_' || surface, trio_hit, trio_return FROM races
  UNION ALL SELECT 'favourite', CASE WHEN top_odds < 4 THEN 'short' WHEN top_odds < 7 THEN 'middle' ELSE 'long' END, trio_hit, trio_return FROM races
  UNION ALL SELECT 'sprint_slice', CASE WHEN cond_key <> 'D' THEN 'none' WHEN distance <= 1000 THEN '1000' WHEN distance <= 1200 THEN '1200' ELSE '1400' END, trio_hit, trio_return FROM races
)
SELECT axis, label, count(*) AS n, CAST(sum(trio_hit) AS BIGINT) AS hits, sum(trio_return) / CAST(count(*) * 700 AS DOUBLE) * 100.0::DOUBLE AS roi FROM x GROUP BY ALL HAVING count(*) >= 20
""")
def ag17(spark: SparkSession, sf: str) -> DataFrame:
    odds, dist = F.col("top_odds"), F.col("distance")
    axes = {
        "month": F.col("month"), "season": F.col("season"), "course": F.col("course_name"), "class": F.col("class"),
        "surface": F.col("surface"), "cond_surface": F.concat_ws("_", "cond_key", "surface"),
        "favourite": F.when(odds < 4, "short").when(odds < 7, "middle").otherwise("long"),
        "sprint_slice": F.when(F.col("cond_key") != "D", "none").when(dist <= 1000, "1000").when(dist <= 1200, "1200").otherwise("1400"),
    }
    out = Q.by_axes(races(spark, sf), axes).groupBy("axis", "label").agg(
        F.count("*").alias("n"), F.sum("trio_hit").alias("hits"), F.sum("trio_return").alias("paid")
    )
    return out.filter("n >= 20").select("axis", "label", "n", "hits", Q.roi_percent(F.col("paid"), F.col("n")).alias("roi"))


@query("ag22_ticket_matrix", RR + """
, t AS (""" + " UNION ALL ".join(f"SELECT cond_key, '{t}' AS ticket, {t}_hit AS hit, CAST({t}_return AS DOUBLE) AS paid FROM races" for t in Q.FIVE) + """),
m AS (SELECT coalesce(cond_key, 'ALL') AS cond_key, ticket, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, sum(paid) AS paid, CAST(sum(hit) AS DOUBLE) / count(*) * 100.0::DOUBLE AS hit_rate, sum(paid) / CAST(count(*) * 700 AS DOUBLE) * 100.0::DOUBLE AS roi
  FROM t GROUP BY GROUPING SETS ((cond_key, ticket), (ticket)))
SELECT *, row_number() OVER (PARTITION BY cond_key ORDER BY roi DESC, ticket) = 1 AS best FROM m
""")
def ag22(spark: SparkSession, sf: str) -> DataFrame:
    out = Q.with_total(races(spark, sf), "cond_key", Q.FIVE)
    # Five rows per class.
    w = Window.partitionBy("cond_key").orderBy(F.desc("roi"), "ticket")
    return out.withColumn("best", F.row_number().over(w) == 1)


THRESHOLDS = [0.0, 5.0, 10.0, 15.0, 20.0, 30.0, 40.0]


@query("ag23_threshold_sweep", RR + EV_SQL.replace("\n, trio AS", ", trio AS", 1) + """
, th(t) AS (VALUES (0.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE), (15.0::DOUBLE), (20.0::DOUBLE), (30.0::DOUBLE), (40.0::DOUBLE)),
x AS (SELECT r.cond_key, t AS threshold, trio_hit, trio_return FROM races r JOIN ev USING (race_id) JOIN th ON ev.trio_ev >= t),
g AS (SELECT coalesce(cond_key, 'ALL') AS cond_key, threshold, count(*) AS n, CAST(sum(trio_hit) AS BIGINT) AS hits, sum(trio_return) / CAST(count(*) * 700 AS DOUBLE) * 100.0::DOUBLE AS roi FROM x GROUP BY GROUPING SETS ((cond_key, threshold), (threshold)))
SELECT * FROM g WHERE n >= 10
""")
def ag23(spark: SparkSession, sf: str) -> DataFrame:
    r = races(spark, sf).select("race_id", "cond_key", "trio_hit", "trio_return").join(race_values(spark, sf), "race_id")
    # A race counts for every threshold it reaches: seven rows at most.
    levels = F.array(*[F.when(F.col("trio_ev") >= t, F.lit(t)) for t in THRESHOLDS])
    x = r.withColumn("threshold", F.explode(F.filter(levels, lambda v: v.isNotNull())))
    g = x.groupingSets([["threshold", "cond_key"], ["threshold"]], "threshold", "cond_key").agg(
        F.grouping("cond_key").alias("g"), F.count("*").alias("n"), F.sum("trio_hit").alias("hits"), F.sum("trio_return").alias("paid")
    )
    return g.filter("n >= 10").select(
        F.when(F.col("g") == 1, "ALL").otherwise(F.col("cond_key")).alias("cond_key"), "threshold", "n", "hits", Q.roi_percent(F.col("paid"), F.col("n")).alias("roi")
    )


GRID = ["f_distance", "f_field", "f_going", "f_season"]


def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Races summed per distinct (distance, field, going, season, year) and spread over the filter grid."""
    r = races(spark, sf).withColumn("random", Q.random_rate(F.col("field"), "trio", F.size("trio_bets")))
    cells = r.groupBy("distance", "num_horses", "going", "season", "year").agg(
        F.count("*").alias("n"), F.sum("trio_hit").alias("hits"), F.sum("trio_return").alias("paid"), F.sum("random").alias("random_hits")
    )
    return J.filter_grid(cells, GRID_DISTANCE, GRID_FIELD, GRID_GOING, SEASONS)


YEARLY_SQL = GRID_SQL + """
, yr AS (SELECT f_distance, f_field, f_going, f_season, year, count(*) AS n, sum(trio_hit) AS hits, sum(trio_return) AS paid,
  sum(least(1.0::DOUBLE, CASE field WHEN 3 THEN 1 WHEN 4 THEN 3 WHEN 5 THEN 5 ELSE 7 END / (field * (field - 1) * (field - 2) / 6.0::DOUBLE))) AS rnd FROM grid GROUP BY ALL)
"""


@query("ag24_grid_search", RR + YEARLY_SQL + """
SELECT f_distance, f_field, f_going, f_season, CAST(sum(n) AS BIGINT) AS n, CAST(sum(hits) AS BIGINT) AS hits, sum(paid) AS paid, NOT bool_or(n >= 3 AND paid / CAST(n * 700 AS DOUBLE) * 100.0::DOUBLE < 50) AS stable, count(*) AS years,
  sum(paid) / CAST(sum(n) * 700 AS DOUBLE) * 100.0::DOUBLE AS roi, CAST(sum(hits) AS DOUBLE) / CAST(sum(n) AS DOUBLE) * 100.0::DOUBLE AS hit_rate
FROM yr GROUP BY ALL HAVING sum(n) >= 30 AND sum(paid) / CAST(sum(n) * 700 AS DOUBLE) * 100.0::DOUBLE >= 110
""")
def ag24(spark: SparkSession, sf: str) -> DataFrame:
    return Q.stable_grid(grid_cells(spark, sf), GRID, 30, 110.0)


EDGE_SQL = YEARLY_SQL + """
, e AS (SELECT f_distance, f_field, f_going, f_season, CAST(sum(n) AS BIGINT) AS n, CAST(sum(hits) AS BIGINT) AS hits,
  round((CAST(sum(hits) AS DOUBLE) - sum(rnd)) / CAST(sum(n) AS DOUBLE) * 100.0::DOUBLE, 6) AS edge, sum(paid) / CAST(sum(n) * 700 AS DOUBLE) * 100.0::DOUBLE AS roi,
  round(CASE WHEN count(CASE WHEN n >= 5 THEN 1 END) >= 2 THEN stddev_pop(CASE WHEN n >= 5 THEN (CAST(hits AS DOUBLE) - rnd) / n * 100.0::DOUBLE END) ELSE 999.0::DOUBLE END, 6) AS stability FROM yr GROUP BY ALL)
"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    out = Q.edge_grid(grid_cells(spark, sf), GRID)
    return out.select(*GRID, "n", "hits", F.round("edge", 6).alias("edge"), "roi", F.round("stability", 6).alias("stability"))


@query("ag25_grid_edge_over_random", RR + EDGE_SQL + "SELECT *, n >= 30 AND stability < 20 AS strong FROM e WHERE edge >= 5 OR roi >= 100")
def ag25(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).filter("edge >= 5 OR roi >= 100").withColumn("strong", F.expr("n >= 30 AND stability < 20"))


FOLDS_SQL = RR + """
, fo AS (SELECT dist, nh, year, count(*) AS n, CAST(sum(trio_hit) AS DOUBLE) / count(*) AS hit FROM races GROUP BY ALL),
st AS (SELECT dist, nh, count(*) AS folds, round(avg(hit), 9) AS avg_hit, min(hit) AS min_hit, CAST(sum(n) AS BIGINT) AS n FROM fo GROUP BY ALL)
"""


def fold_stability(spark: SparkSession, sf: str) -> DataFrame:
    folds = races(spark, sf).groupBy("dist", "nh", "year").agg(F.count("*").alias("n"), (F.sum("trio_hit") / F.count("*")).alias("hit"))
    out = folds.groupBy("dist", "nh").agg(
        F.count("*").alias("folds"), F.round(F.avg("hit"), 9).alias("avg_hit"), F.min("hit").alias("min_hit"), F.sum("n").alias("n")
    )
    return out.filter("folds >= 2 AND min_hit / avg_hit >= 0.5D AND avg_hit * 100 >= 30")


@query("ag26_fold_stability", FOLDS_SQL + "SELECT * FROM st WHERE folds >= 2 AND min_hit / avg_hit >= 0.5 AND avg_hit * 100 >= 30")
def ag26(spark: SparkSession, sf: str) -> DataFrame:
    return fold_stability(spark, sf)


@query("ag27_calendar_weeks", with_views(LEDGER) + """
, w AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week, count(*) AS races, CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(payout) AS BIGINT) AS paid FROM ledger GROUP BY 1)
SELECT week, races, hits, races * 100 AS investment, paid, CAST(paid AS DOUBLE) / CAST(races * 100 AS DOUBLE) * 100.0::DOUBLE AS roi FROM w WHERE week > (SELECT max(week) FROM w) - 28
""")
def ag27(spark: SparkSession, sf: str) -> DataFrame:
    weeks = ledger(spark, sf).groupBy(F.to_date(F.date_trunc("week", "day")).alias("week")).agg(
        F.count("*").alias("races"), F.sum("hit").alias("hits"), F.sum("payout").alias("paid")
    )
    last = weeks.select(F.max("week").alias("w")).scalar()
    return weeks.filter(F.col("week") > F.date_sub(last, 28)).select(
        "week", "races", "hits", (F.col("races") * 100).alias("investment"), "paid", Q.roi_percent(F.col("paid"), F.col("races"), 100).alias("roi")
    )


@query("ag28_ledger_dashboard", RR + """
, x AS (SELECT 'total' AS axis, 'all' AS label, * FROM races UNION ALL SELECT 'region', CASE WHEN course >= 5 THEN 'nar' ELSE 'jra' END, * FROM races UNION ALL SELECT 'course', course_name, * FROM races
  UNION ALL SELECT 'distance', CASE WHEN distance <= 1400 THEN 'short' WHEN distance <= 1800 THEN 'mile' WHEN distance <= 2200 THEN 'middle' ELSE 'long' END, * FROM races
  UNION ALL SELECT 'going', cond, * FROM races UNION ALL SELECT 'field', nh, * FROM races)
SELECT axis, label, count(*) AS total, CAST(sum(has_payout) AS BIGINT) AS settled, CAST(sum(has_payout * trio_hit) AS BIGINT) AS hits, CAST(sum(trio_return) - 700 * sum(has_payout) AS DOUBLE) AS profit,
  sum(trio_return) / CAST(700 * sum(has_payout) AS DOUBLE) * 100.0::DOUBLE AS roi FROM x GROUP BY ALL
""")
def ag28(spark: SparkSession, sf: str) -> DataFrame:
    dist = F.col("distance")
    axes = {
        "total": F.lit("all"), "region": F.when(F.col("course") >= 5, "nar").otherwise("jra"), "course": F.col("course_name"),
        "distance": F.when(dist <= 1400, "short").when(dist <= 1800, "mile").when(dist <= 2200, "middle").otherwise("long"),
        "going": F.col("cond"), "field": F.col("nh"),
    }
    out = Q.by_axes(races(spark, sf), axes).groupBy("axis", "label").agg(
        F.count("*").alias("total"), F.sum("has_payout").alias("settled"), F.sum(F.col("has_payout") * F.col("trio_hit")).alias("hits"), F.sum("trio_return").alias("paid")
    )
    return out.select(
        "axis", "label", "total", "settled", "hits", (F.col("paid") - F.col("settled") * 700).alias("profit"), Q.roi_percent(F.col("paid"), F.col("settled")).alias("roi")
    )


EXPECTED = "VALUES " + ", ".join(f"('{k}', {v[1]}{D}, {v[2]}{D})" for k, v in K.CLASS_PROFILE.items())


@query("ag29_weekly_report", RR + f"""
, p(cond_key, expected_hit, expected_roi) AS ({EXPECTED}),
s AS (SELECT *, CAST(trio_hit = 1 OR umaren_hit = 1 AS BIGINT) AS hit FROM races WHERE has_payout = 1),
g AS (SELECT CAST(date_trunc('week', race_date) AS DATE) AS week, 'class' AS axis, cond_key AS label, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, sum(trio_return) + sum(umaren_return) AS paid FROM s GROUP BY 1, 3
  UNION ALL SELECT CAST(date_trunc('week', race_date) AS DATE), 'day', CAST(race_date AS VARCHAR), count(*), CAST(sum(hit) AS BIGINT), sum(trio_return) + sum(umaren_return) FROM s GROUP BY 1, 3)
SELECT week, axis, label, n, hits, CAST(hits AS DOUBLE) / n * 100.0::DOUBLE AS hit_rate, paid / CAST(n * 700 AS DOUBLE) * 100.0::DOUBLE AS roi, expected_roi,
  CASE WHEN n < 5 THEN 'N/A' WHEN expected_hit IS NOT NULL AND CAST(hits AS DOUBLE) / n * 100.0::DOUBLE < expected_hit * 0.5::DOUBLE THEN 'WARN' ELSE 'OK' END AS verdict FROM g LEFT JOIN p ON g.label = p.cond_key
""")
def ag29(spark: SparkSession, sf: str) -> DataFrame:
    expected = spark.createDataFrame([(k, v[1], v[2]) for k, v in K.CLASS_PROFILE.items()], "label string, expected_hit double, expected_roi double")
    s = races(spark, sf).filter("has_payout = 1").withColumns({
        "hit": F.expr("CAST(trio_hit = 1 OR umaren_hit = 1 AS BIGINT)"), "week": F.to_date(F.date_trunc("week", "race_date")),
    })
    out = Q.by_axes(s, {"class": F.col("cond_key"), "day": F.col("race_date")}).groupBy("week", "axis", "label").agg(
        F.count("*").alias("n"), F.sum("hit").alias("hits"), (F.sum("trio_return") + F.sum("umaren_return")).alias("paid")
    )
    rate = F.col("hits") / F.col("n") * 100.0
    # Six rows of fixed expectations.
    return out.join(F.broadcast(expected), "label", "left").select(
        "week", "axis", "label", "n", "hits", rate.alias("hit_rate"), Q.roi_percent(F.col("paid"), F.col("n")).alias("roi"), "expected_roi",
        F.when(F.col("n") < 5, "N/A").when(rate < F.col("expected_hit") * 0.5, "WARN").otherwise("OK").alias("verdict"),
    )


@query("ag30_result_summary", RR + """
, x AS (SELECT 'class' AS axis, cond_key AS label, * FROM races UNION ALL SELECT 'ticket', CASE WHEN cond_key = 'E' THEN 'umaren' ELSE 'trio' END, * FROM races UNION ALL SELECT 'day', CAST(race_date AS VARCHAR), * FROM races UNION ALL SELECT 'region', CASE WHEN course >= 5 THEN 'nar' ELSE 'jra' END, * FROM races)
SELECT axis, label, count(*) AS n, CAST(sum(CASE WHEN cond_key = 'E' THEN umaren_hit ELSE trio_hit END) AS BIGINT) AS hits, sum(CASE WHEN cond_key = 'E' THEN umaren_return ELSE trio_return END) AS paid FROM x WHERE has_payout = 1 GROUP BY ALL
""")
def ag30(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.col("cond_key") == "E"
    axes = {"class": F.col("cond_key"), "ticket": F.when(pair, "umaren").otherwise("trio"), "day": F.col("race_date"), "region": F.when(F.col("course") >= 5, "nar").otherwise("jra")}
    return Q.by_axes(races(spark, sf).filter("has_payout = 1"), axes).groupBy("axis", "label").agg(
        F.count("*").alias("n"), F.sum(F.when(pair, F.col("umaren_hit")).otherwise(F.col("trio_hit"))).alias("hits"),
        F.sum(F.when(pair, F.col("umaren_return")).otherwise(F.col("trio_return"))).alias("paid"),
    )


@query("ag31_wins_and_losses", RR + """
, x AS (SELECT 'field' AS axis, nh AS label, trio_hit FROM races UNION ALL SELECT 'distance', dist, trio_hit FROM races UNION ALL SELECT 'surface', surface, trio_hit FROM races UNION ALL SELECT 'going', cond, trio_hit FROM races)
SELECT axis, label, CAST(sum(trio_hit) AS BIGINT) AS wins, CAST(count(*) - sum(trio_hit) AS BIGINT) AS losses, CAST(sum(trio_hit) AS DOUBLE) / count(*) AS hit_rate FROM x GROUP BY ALL
""")
def ag31(spark: SparkSession, sf: str) -> DataFrame:
    axes = {"field": F.col("nh"), "distance": F.col("dist"), "surface": F.col("surface"), "going": F.col("cond")}
    hits = F.sum("trio_hit")
    return Q.by_axes(races(spark, sf), axes).groupBy("axis", "label").agg(
        hits.alias("wins"), (F.count("*") - hits).alias("losses"), (hits / F.count("*")).alias("hit_rate")
    )


@query("ag32_bet_level_totals", R + """
, k AS (SELECT race_id, runner_no, finish, field, odds, pred_rank AS r_new, row_number() OVER (PARTITION BY race_id ORDER BY odds, runner_no) AS r_old FROM ranked WHERE field >= 3),
v AS (SELECT race_id, 'new' AS version, r_new AS r, finish, field FROM k UNION ALL SELECT race_id, 'old', r_old, finish, field FROM k),
g AS (SELECT race_id, version, max(CASE field WHEN 3 THEN 1 WHEN 4 THEN 3 WHEN 5 THEN 5 ELSE 7 END) AS bets, max(CASE WHEN finish = 1 THEN r END) AS a, max(CASE WHEN finish = 2 THEN r END) AS b, max(CASE WHEN finish = 3 THEN r END) AS c FROM v GROUP BY ALL)
SELECT version, count(*) AS races, CAST(sum(bets) AS BIGINT) AS bets, CAST(sum(bets) * 100 AS BIGINT) AS investment, CAST(sum(CASE WHEN least(a, b, c) = 1 AND greatest(a, b, c) <= 6 AND a + b + c - least(a, b, c) - greatest(a, b, c) <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM g GROUP BY 1
""")
def ag32(spark: SparkSession, sf: str) -> DataFrame:
    old = F.row_number().over(Window.partitionBy("race_id").orderBy("odds", "runner_no"))
    k = ranked(entries(spark, sf)).filter("field >= 3").withColumn("old_rank", old)
    pick = lambda rank, n: F.expr(f"transform(sort_array(collect_list(CASE WHEN {rank} <= {n} THEN struct({rank} AS r, runner_no AS u) END)), x -> x.u)")
    race = k.groupBy("race_id").agg(pick("pred_rank", 6).alias("new"), pick("old_rank", 6).alias("old"), F.array_sort(pick("finish", 3)).alias("top3"))
    long = race.select("top3", F.explode(F.array(F.struct(F.lit("new").alias("version"), F.col("new").alias("p")), F.struct(F.lit("old").alias("version"), F.col("old").alias("p")))).alias("x"))
    long = long.select("top3", "x.version", B.trio_bets(F.col("x.p")).alias("bets"))
    return long.groupBy("version").agg(
        F.count("*").alias("races"), F.sum(F.size("bets")).alias("bets"), (F.sum(F.size("bets")) * 100).alias("investment"),
        F.sum(B.has_hit(F.col("bets"), F.col("top3"), "equal").cast("bigint")).alias("hits"),
    )


@query("ag41_payout_coverage", RR + """
SELECT coalesce(CAST(year AS VARCHAR), 'ALL') AS year, count(*) AS n, CAST(sum(has_payout) AS BIGINT) AS matched, CAST(sum(has_payout) AS DOUBLE) / count(*) AS coverage FROM races GROUP BY ROLLUP (year)
""")
def ag41(spark: SparkSession, sf: str) -> DataFrame:
    g = races(spark, sf).rollup("year").agg(F.count("*").alias("n"), F.sum("has_payout").alias("matched"))
    return g.select(F.coalesce(F.col("year").cast("string"), F.lit("ALL")).alias("year"), "n", "matched", (F.col("matched") / F.col("n")).alias("coverage"))


@query("ag45_near_misses", R + """
SELECT CASE WHEN num_horses <= 7 THEN 'small' WHEN num_horses <= 14 THEN 'medium' ELSE 'large' END AS nh, pred_rank, count(*) AS n, min(race_id) AS first_race FROM ranked WHERE pred_rank <= 3 AND finish = 4 GROUP BY ALL
""")
def ag45(spark: SparkSession, sf: str) -> DataFrame:
    missed = ranked(entries(spark, sf)).filter("pred_rank <= 3 AND finish = 4")
    return missed.groupBy(C.field_label(F.col("num_horses")).alias("nh"), "pred_rank").agg(F.count("*").alias("n"), F.min("race_id").alias("first_race"))


@query("ag46_season_rate", E + """
, s AS (SELECT horse_id, year, count(*) AS rides, sum(is_win) AS wins FROM entries GROUP BY ALL),
p AS (SELECT horse_id, max(CASE WHEN year = 1998 AND rides >= 10 AND wins > 0 THEN CAST(wins AS DOUBLE) / rides END) AS l, max(CASE WHEN year = 1999 AND rides >= 10 AND wins > 0 THEN CAST(wins AS DOUBLE) / rides END) AS c, CAST(sum(wins) AS DOUBLE) / CAST(sum(rides) AS DOUBLE) AS t FROM s GROUP BY 1)
SELECT horse_id, coalesce(l, c, CASE WHEN t > 0 THEN t END) AS rate FROM p WHERE coalesce(l, c, CASE WHEN t > 0 THEN t END) IS NOT NULL
""")
def ag46(spark: SparkSession, sf: str) -> DataFrame:
    seasons = entries(spark, sf).groupBy("horse_id", "year").agg(F.count("*").alias("rides"), F.sum("is_win").alias("wins"))
    return Q.season_rate(seasons, "horse_id", 1999)


@query("sr1_sorted_output", """
SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS race_date FROM orders ORDER BY o_orderdate, o_custkey, o_orderkey
""")
def sr1(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.orderBy("o_orderdate", "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("race_date"))


@query("sr2_top_k_per_race", R + """
SELECT race_id, string_agg(CASE WHEN pred_rank <= 6 THEN CAST(runner_no AS VARCHAR) END, '-' ORDER BY pred_rank) AS picks, string_agg(CASE WHEN finish <= 3 THEN CAST(runner_no AS VARCHAR) END, '-' ORDER BY finish) AS top3 FROM ranked WHERE field >= 3 GROUP BY 1
""")
def sr2(spark: SparkSession, sf: str) -> DataFrame:
    return races(spark, sf).select("race_id", F.array_join("picks", "-").alias("picks"), F.array_join("order3", "-").alias("top3"))


@query("sr3_top_findings", RR + EDGE_SQL + """
, d AS (SELECT *, row_number() OVER (PARTITION BY f_field, f_season, edge ORDER BY stability, n DESC, f_distance, f_going) AS k FROM e WHERE n >= 30 AND stability < 20)
SELECT * EXCLUDE (k) FROM d WHERE k = 1 ORDER BY edge DESC, stability, f_distance, f_field, f_going, f_season LIMIT 30
""")
def sr3(spark: SparkSession, sf: str) -> DataFrame:
    # The grid has 400 entries whatever the data size.
    w = Window.partitionBy("f_field", "f_season", "edge").orderBy("stability", F.desc("n"), "f_distance", "f_going")
    kept = edges(spark, sf).filter("n >= 30 AND stability < 20").withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
    return kept.orderBy(F.desc("edge"), "stability", *GRID).limit(30)


@query("sr6_latest_rows", with_views(LEDGER) + "SELECT race_id, entity, ts, kind, payout FROM ledger ORDER BY ts DESC, race_id LIMIT 10")
def sr6(spark: SparkSession, sf: str) -> DataFrame:
    return ledger(spark, sf).orderBy(F.desc("ts"), "race_id").limit(10).select("race_id", "entity", "ts", "kind", "payout")


@query("st5_best_per_band", FOLDS_SQL + """
, ok AS (SELECT * FROM st WHERE folds >= 2 AND min_hit / avg_hit >= 0.5 AND avg_hit * 100 >= 30),
b AS (SELECT *, row_number() OVER (PARTITION BY dist ORDER BY avg_hit DESC, n DESC, nh) AS k, row_number() OVER (PARTITION BY nh ORDER BY avg_hit DESC, n DESC, dist) AS h FROM ok)
SELECT dist, nh, avg_hit, n FROM b WHERE k = 1 OR (h = 1 AND avg_hit > 0.5)
""")
def st5(spark: SparkSession, sf: str) -> DataFrame:
    # One row per (distance band, field band): twelve at most.
    band = Window.partitionBy("dist").orderBy(F.desc("avg_hit"), F.desc("n"), "nh")
    heads = Window.partitionBy("nh").orderBy(F.desc("avg_hit"), F.desc("n"), "dist")
    ok = fold_stability(spark, sf).withColumns({"k": F.row_number().over(band), "h": F.row_number().over(heads)})
    return ok.filter("k = 1 OR (h = 1 AND avg_hit > 0.5D)").select("dist", "nh", "avg_hit", "n")
