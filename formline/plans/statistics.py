"""Statistics (AG18-AG21, AG33-AG37, AG44, SR4, SR5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline import constants as K
from formline.functions import bets as B
from formline.functions import columns as C
from formline.operators import inrace as I
from formline.operators import roi as Q
from formline.operators import statistics as S
from formline.operators.chunked import percentiles
from formline.plans.registry import query
from formline.plans.views import RR, E, entries, races, table

HITS_SQL = RR + ", w AS (SELECT cond_key, race_id, CASE WHEN cond_key = 'E' THEN umaren_return ELSE trio_return END AS yen FROM races WHERE has_payout = 1 AND CASE WHEN cond_key = 'E' THEN umaren_hit ELSE trio_hit END = 1)"


def hit_payouts(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.col("cond_key") == "E"
    r = races(spark, sf).filter("has_payout = 1")
    return r.filter(F.when(pair, F.col("umaren_hit")).otherwise(F.col("trio_hit")) == 1).select(
        "cond_key", "race_id", F.when(pair, F.col("umaren_return")).otherwise(F.col("trio_return")).alias("yen")
    )


@query("ag18_payout_distribution", HITS_SQL + """
SELECT cond_key, count(*) AS n, round(avg(yen), 6) AS mean, min(yen) AS min, max(yen) AS max, round(stddev_pop(yen), 5) AS std, CAST(count(*) FILTER (yen >= 2000) AS DOUBLE) / count(*) AS large_share,
       quantile_cont(yen, 0.25) AS p25, quantile_cont(yen, 0.5) AS median, quantile_cont(yen, 0.75) AS p75 FROM w GROUP BY 1
""")
def ag18(spark: SparkSession, sf: str) -> DataFrame:
    out = S.value_distribution(hit_payouts(spark, sf), ["cond_key"], "yen", 2000.0)
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 5)})


@query("ag19_concentration", HITS_SQL + """
, k AS (SELECT *, row_number() OVER (PARTITION BY cond_key ORDER BY yen DESC, race_id) AS r, count(*) OVER (PARTITION BY cond_key) AS c FROM w)
SELECT cond_key, count(*) AS n, sum(yen) AS total, sum(CASE WHEN r <= 5 THEN yen ELSE 0 END) / sum(yen) AS top5, sum(CASE WHEN r <= 10 THEN yen ELSE 0 END) / sum(yen) AS top10,
       sum(CASE WHEN r <= 50 THEN yen ELSE 0 END) / sum(yen) AS top50, sum(CASE WHEN r <= greatest(1, c // 10) THEN yen ELSE 0 END) / sum(yen) AS top_tenth FROM k GROUP BY 1
""")
def ag19(spark: SparkSession, sf: str) -> DataFrame:
    return S.top_share(hit_payouts(spark, sf), ["cond_key"], "yen", {"top5": 5, "top10": 10, "top50": 50, "top_tenth": 0.1})


@query("ag20_stress", RR + """
, x AS (SELECT *, CASE WHEN trio_hit = 1 THEN row_number() OVER (PARTITION BY cond_key, trio_hit ORDER BY md5(CAST(race_id AS VARCHAR)), race_id) END AS k, sum(trio_hit) OVER (PARTITION BY cond_key) AS hits FROM races WHERE has_payout = 1),
d AS (SELECT *, CASE WHEN trio_hit = 1 AND k <= floor(hits * 0.2::DOUBLE) THEN 0.0::DOUBLE ELSE trio_return END AS kept FROM x)
SELECT cond_key, round(sum(trio_return) / CAST(count(*) * 700 AS DOUBLE) * 100.0::DOUBLE, 6) AS baseline, round(sum(trio_return) * (70.0::DOUBLE / 75.0::DOUBLE) / CAST(count(*) * 700 AS DOUBLE) * 100.0::DOUBLE, 6) AS higher_take,
       round(sum(kept) / CAST(count(*) * 700 AS DOUBLE) * 100.0::DOUBLE, 6) AS fewer_hits, round(sum(kept) * (70.0::DOUBLE / 75.0::DOUBLE) / CAST(count(*) * 700 AS DOUBLE) * 100.0::DOUBLE, 6) AS both FROM d GROUP BY 1
""")
def ag20(spark: SparkSession, sf: str) -> DataFrame:
    r = races(spark, sf).filter("has_payout = 1").select("race_id", "cond_key", "trio_hit", "trio_return")
    d = S.drop_fraction(r, ["cond_key"], "race_id", "trio_hit", 0.2)
    g = d.groupBy("cond_key").agg(F.count("*").alias("n"), F.sum("trio_return").alias("a"), F.sum(F.when(F.col("dropped") == 0, F.col("trio_return")).otherwise(0.0)).alias("b"))
    take = 70.0 / 75.0
    rate = lambda paid: F.round(Q.roi_percent(paid, F.col("n")), 6)
    return g.select(
        "cond_key", rate(F.col("a")).alias("baseline"), rate(F.col("a") * take).alias("higher_take"), rate(F.col("b")).alias("fewer_hits"), rate(F.col("b") * take).alias("both")
    )


@query("ag21_odds_statistics", E + """
, p AS (SELECT *, rank() OVER (PARTITION BY race_id ORDER BY odds) AS pop FROM entries WHERE odds > 0),
g AS (SELECT 'pop' || pop AS kind, count(*) AS n, avg(odds) AS mean, stddev_samp(odds) AS std, avg(CAST(is_win AS DOUBLE)) AS win FROM p WHERE pop <= 10 GROUP BY 1 HAVING count(*) >= 100
  UNION ALL SELECT 'all', count(*), avg(odds), stddev_samp(odds), avg(CAST(is_win AS DOUBLE)) FROM p),
c AS (SELECT stddev_samp(odds) / avg(odds) * 100.0::DOUBLE AS cv FROM p GROUP BY race_id)
SELECT kind, n, round(mean, 6) AS mean, round(std, 6) AS std, round(std / mean * 100.0::DOUBLE, 5) AS cv, round(win, 9) AS win_rate, CAST(NULL AS DOUBLE) AS median FROM g
UNION ALL SELECT 'race_cv', count(cv), round(avg(cv), 6), NULL, NULL, NULL, round(quantile_cont(cv, 0.5), 6) FROM c
""")
def ag21(spark: SparkSession, sf: str) -> DataFrame:
    p = entries(spark, sf).filter("odds > 0").withColumn("pop", I.min_rank(["race_id"], F.asc("odds")))
    stats = [F.count("*").alias("n"), F.avg("odds").alias("mean"), F.stddev_samp("odds").alias("std"), F.avg("is_win").alias("win_rate")]
    kinds = F.filter(F.array(F.lit("all"), F.when(F.col("pop") <= 10, F.concat(F.lit("pop"), F.col("pop").cast("string")))), lambda x: x.isNotNull())
    g = p.select("odds", "is_win", F.explode(kinds).alias("kind")).groupBy("kind").agg(*stats).filter("n >= 100 OR kind = 'all'")
    near = lambda c, k: F.round(c, k)
    g = g.select("kind", "n", near("mean", 6).alias("mean"), near("std", 6).alias("std"), near(F.col("std") / F.col("mean") * 100.0, 5).alias("cv"), near("win_rate", 9).alias("win_rate"), F.lit(None).cast("double").alias("median"))
    cv = p.groupBy("race_id").agg((F.stddev_samp("odds") / F.avg("odds") * 100.0).alias("cv")).filter("cv IS NOT NULL AND NOT isnan(cv)")
    median = percentiles(cv, [], "cv", {"m": 0.5}).select("m").scalar()
    none = F.lit(None).cast("double")
    race = cv.agg(F.count("cv").alias("n"), F.avg("cv").alias("a")).select(
        F.lit("race_cv").alias("kind"), "n", near("a", 6).alias("mean"), none.alias("std"), none.alias("cv"), none.alias("win_rate"), near(median, 6).alias("median")
    )
    return g.unionByName(race)


AUC_SQL = """
, k AS (SELECT seg, y, rank() OVER (PARTITION BY seg ORDER BY s) + (count(*) OVER (PARTITION BY seg, s) - 1) / 2.0::DOUBLE AS rk FROM scored),
a AS (SELECT seg, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives, sum(rk * y) AS rs FROM k GROUP BY seg),
au AS (SELECT seg, positives, negatives, round((rs - CAST(positives AS DOUBLE) * (positives + 1) / 2.0::DOUBLE) / (CAST(positives AS DOUBLE) * negatives), 9) AS auc FROM a WHERE positives > 0 AND negatives > 0)
"""


@query("ag33_auc_by_segment", E + """
, scored AS (SELECT 'all' AS seg, score AS s, is_top3 AS y FROM entries UNION ALL SELECT 'course' || course, score, is_top3 FROM entries UNION ALL SELECT 'dist' || CAST(distance AS VARCHAR), score, is_top3 FROM entries UNION ALL SELECT 'cross' || course || '_' || CAST(distance AS VARCHAR), score, is_top3 FROM entries)
""" + AUC_SQL + """
SELECT *, round(auc - (SELECT auc FROM au WHERE seg = 'all'), 9) AS delta FROM au WHERE seg NOT LIKE 'cross%' OR positives + negatives >= 200
""")
def ag33(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    course, dist = F.col("course").cast("string"), F.col("distance").cast("string")
    segs = F.array(F.lit("all"), F.concat(F.lit("course"), course), F.concat(F.lit("dist"), dist), F.concat(F.lit("cross"), course, F.lit("_"), dist))
    out = S.auc(e.select(F.explode(segs).alias("seg"), "score", "is_top3"), ["seg"], "score", "is_top3")
    # One row per segment, a few hundred at most: this window is over the finished table.
    base = F.max(F.when(F.col("seg") == "all", F.col("auc"))).over(Window.partitionBy())
    out = out.withColumn("auc", F.round("auc", 9)).withColumn("delta", F.round(F.col("auc") - base, 9))
    return out.filter("seg NOT LIKE 'cross%' OR positives + negatives >= 200")


@query("ag33_auc_with_gaps", E + """
, scored AS (SELECT course AS seg, score AS s, is_top3 AS y FROM entries WHERE runner_no % 3 <> 0 AND race_id % 5 <> 0)
""" + AUC_SQL + "SELECT * FROM au")
def ag33_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Scores that are NULL or NaN have no rank."""
    gap = F.when(F.col("runner_no") % 3 == 0, F.lit(float("nan"))).when(F.col("race_id") % 5 != 0, F.col("score"))
    rows = entries(spark, sf).select(F.col("course").alias("seg"), gap.alias("s"), "is_top3")
    return S.auc(rows, ["seg"], "s", "is_top3").withColumn("auc", F.round("auc", 9))


@query("ag33_auc_of_labels", """
WITH scored AS (SELECT lang AS seg, CAST(n_chars AS DOUBLE) AS s, CAST(quality AS BIGINT) AS y FROM documents JOIN labels USING (doc_id))
""" + AUC_SQL + "SELECT * FROM au")
def ag33_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("seg"), F.col("n_chars").cast("double").alias("s"))
    rows = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return S.auc(rows, ["seg"], "s", "quality").withColumn("auc", F.round("auc", 9))


@query("ag34_yearly_anomalies", E + """
, scored AS (SELECT year AS seg, score AS s, is_top3 AS y FROM entries)
""" + AUC_SQL + """
SELECT seg AS year, auc, CASE WHEN auc < m - 2 * sd THEN 'low' WHEN auc > m + 2 * sd THEN 'high' ELSE 'normal' END AS flag,
       CASE WHEN sd < 0.005 THEN 'stable' WHEN last > first THEN 'improving' ELSE 'declining' END AS trend
FROM au, (SELECT avg(auc) AS m, stddev_pop(auc) AS sd, arg_max(auc, seg) AS last, arg_min(auc, seg) AS first FROM au)
""")
def ag34(spark: SparkSession, sf: str) -> DataFrame:
    yearly = S.auc(entries(spark, sf), ["year"], "score", "is_top3").select("year", F.round("auc", 9).alias("auc"))
    # One row per year.
    years = Window.partitionBy()
    mean, sd = F.avg("auc").over(years), F.stddev_pop("auc").over(years)
    last, first = F.max_by("auc", "year").over(years), F.min_by("auc", "year").over(years)
    flag = F.when(F.col("auc") < mean - sd * 2.0, "low").when(F.col("auc") > mean + sd * 2.0, "high").otherwise("normal")
    trend = F.when(sd < 0.005, "stable").when(last > first, "improving").otherwise("declining")
    return yearly.select("year", "auc", flag.alias("flag"), trend.alias("trend"))


@query("ag35_intervals", RR + """
, g AS (SELECT cond_key, count(*) AS n, CAST(sum(trio_hit) AS DOUBLE) AS h, sum(trio_return) / CAST(count(*) * 700 AS DOUBLE) * 100.0::DOUBLE AS roi FROM races GROUP BY 1),
z AS (SELECT *, 1.959964::DOUBLE AS z FROM g)
SELECT cond_key, n, roi, round(greatest(0.0::DOUBLE, ((h / n + z * z / (2 * n)) - z * sqrt((h / n * (1 - h / n) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 9) AS hit_low,
  round(least(1.0::DOUBLE, ((h / n + z * z / (2 * n)) + z * sqrt((h / n * (1 - h / n) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 9) AS hit_high,
  round(greatest(0.0::DOUBLE, roi - 1.96::DOUBLE * roi / sqrt(greatest(h, 1))), 6) AS roi_low, round(roi + 1.96::DOUBLE * roi / sqrt(greatest(h, 1)), 6) AS roi_high,
  CASE WHEN n >= 5000 THEN 'HIGH' WHEN n >= 1000 THEN 'MEDIUM' ELSE 'LOW' END AS reliability FROM z
""")
def ag35(spark: SparkSession, sf: str) -> DataFrame:
    g = races(spark, sf).groupBy("cond_key").agg(F.count("*").alias("n"), F.sum("trio_hit").alias("h"), F.sum("trio_return").alias("paid"))
    g = g.withColumn("roi", Q.roi_percent(F.col("paid"), F.col("n")))
    low, high = B.wilson(F.col("h"), F.col("n"))
    rlow, rhigh = B.roi_interval(F.col("roi"), F.col("h"))
    grade = F.when(F.col("n") >= 5000, "HIGH").when(F.col("n") >= 1000, "MEDIUM").otherwise("LOW")
    return g.select(
        "cond_key", "n", "roi", F.round(low, 9).alias("hit_low"), F.round(high, 9).alias("hit_high"), F.round(rlow, 6).alias("roi_low"),
        F.round(rhigh, 6).alias("roi_high"), grade.alias("reliability"),
    )


RESAMPLES = 10_000
P = S.PRIME


def _uniform(stream: int) -> str:
    first, second = S.factors(stream)
    return f"((((h + b * 1000003) % {P}) * {first} + {stream}) % {S.BETWEEN} * {second} + 1) % {P}"


SMALL = " + ".join(f"CASE WHEN n & {1 << j} > 0 THEN " + " + ".join(f"CAST({_uniform(j)} >= {e} AS BIGINT)" for e in S.poisson_thresholds(1 << j)) + " ELSE 0 END" for j in range(8))
TWELVE = " + ".join(f"({_uniform(20 + i)})" for i in range(12))


@query("ag36_bootstrap_interval", RR + f"""
, c AS (SELECT cond_key, CAST(trio_return AS BIGINT) AS x, count(*) AS n FROM races GROUP BY 1, 2),
d AS (SELECT cond_key, x, n, b, h FROM (SELECT *, CAST('0x' || substr(md5(concat_ws('|', '42', cond_key, CAST(x AS VARCHAR))), 1, 7) AS BIGINT) AS h FROM c), range(1, {RESAMPLES + 1}) t(b)),
s AS (SELECT cond_key, b, x, CASE WHEN n < {S.NORMAL_FROM} THEN {SMALL} ELSE greatest(0, CAST(floor(n + sqrt(CAST(n AS DOUBLE)) * (CAST({TWELVE} AS DOUBLE) / {float(P)}::DOUBLE - 6.0::DOUBLE) + 0.5::DOUBLE) AS BIGINT)) END AS k FROM d),
r AS (SELECT cond_key, CAST(sum(x * k) AS DOUBLE) / (CAST(sum(k) AS DOUBLE) * {float(K.STAKE)}::DOUBLE) * 100.0::DOUBLE AS roi FROM s GROUP BY cond_key, b HAVING sum(k) > 0)
SELECT cond_key, round(avg(roi), 6) AS mean_roi, round(stddev_pop(roi), 6) AS std_roi, round(quantile_cont(roi, 0.025), 6) AS ci_lower, round(quantile_cont(roi, 0.975), 6) AS ci_upper FROM r GROUP BY 1
""")
def ag36(spark: SparkSession, sf: str) -> DataFrame:
    out = S.bootstrap(races(spark, sf).select("cond_key", "trio_return"), ["cond_key"], "trio_return", RESAMPLES, float(K.STAKE))
    return out.select("cond_key", *[F.round(c, 6).alias(c) for c in ("mean_roi", "std_roi", "ci_lower", "ci_upper")])


PROFILE = ", ".join(f"('{k}', {v[3]})" for k, v in K.CLASS_PROFILE.items())


@query("ag37_conservative_roi", RR + f"""
, p(cond_key, monthly) AS (VALUES {PROFILE}),
g AS (SELECT cond_key, count(*) AS n, sum(trio_return) / CAST(count(*) * 700 AS DOUBLE) * 100.0::DOUBLE AS roi FROM races WHERE has_payout = 1 GROUP BY 1),
x AS (SELECT cond_key, n, roi, round(roi * 0.7::DOUBLE, 1) AS careful FROM g UNION ALL SELECT 'ALL', CAST(sum(n) AS BIGINT), sum(roi * n) / sum(n), round(sum(roi * n) / sum(n) * 0.7::DOUBLE, 1) FROM g)
SELECT cond_key, n, round(roi, 6) AS roi, careful AS conservative_roi, CASE WHEN careful > 100 THEN 'PROFIT' WHEN careful > 90 THEN 'BREAK-EVEN' ELSE 'LOSS' END AS verdict,
  CAST(trunc(700 * monthly * (careful / 100.0::DOUBLE - 1.0::DOUBLE)) AS BIGINT) AS monthly_profit FROM x LEFT JOIN p USING (cond_key)
""")
def ag37(spark: SparkSession, sf: str) -> DataFrame:
    g = races(spark, sf).filter("has_payout = 1").groupBy("cond_key").agg(F.count("*").alias("n"), F.sum("trio_return").alias("paid"))
    g = g.select("cond_key", "n", Q.roi_percent(F.col("paid"), F.col("n")).alias("roi"))
    total = g.agg(F.sum("n").alias("n"), (F.sum(F.col("roi") * F.col("n")) / F.sum("n")).alias("roi")).select(F.lit("ALL").alias("cond_key"), "n", "roi")
    x = g.unionByName(total).withColumn("conservative_roi", F.round(F.col("roi") * 0.7, 1))
    monthly = C.map_lookup(F.col("cond_key"), {k: v[3] for k, v in K.CLASS_PROFILE.items()}, 0)
    careful = F.col("conservative_roi")
    profit = (monthly * 700 * (careful / 100.0 - 1.0)).cast("bigint")
    return x.select(
        "cond_key", "n", F.round("roi", 6).alias("roi"), "conservative_roi",
        F.when(careful > 100, "PROFIT").when(careful > 90, "BREAK-EVEN").otherwise("LOSS").alias("verdict"),
        F.when(F.col("cond_key") != "ALL", profit).alias("monthly_profit"),
    )


@query("ag44_reported_and_random", RR + """
, b AS (SELECT *, CASE field WHEN 3 THEN 1 WHEN 4 THEN 3 WHEN 5 THEN 5 ELSE 7 END AS nb, field * (field - 1) * (field - 2) / 6.0::DOUBLE AS c3, field * (field - 1) / 2.0::DOUBLE AS c2 FROM races)
SELECT cond_key, CAST(sum(trio_hit) AS DOUBLE) / count(*) AS trio_rate, round(avg(least(nb / c3, 1.0::DOUBLE)), 9) AS trio_random, round(avg(least(2 / c2, 1.0::DOUBLE)), 9) AS umaren_random,
  round(avg(1 - pow(1 - 3 / c2, 2)), 9) AS wide_random, round(avg(1 - (1 - least(2 / c2, 1.0::DOUBLE)) * pow(1 - 3 / c2, 2)), 9) AS combo_random FROM b GROUP BY 1
""")
def ag44(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("field")
    mean = lambda ticket, bets: F.round(F.avg(Q.random_rate(n, ticket, bets)), 9)
    return races(spark, sf).groupBy("cond_key").agg(
        (F.sum("trio_hit") / F.count("*")).alias("trio_rate"), mean("trio", F.size("trio_bets")).alias("trio_random"), mean("umaren", 2).alias("umaren_random"),
        mean("wide", 2).alias("wide_random"), mean("combo", 2).alias("combo_random"),
    )


@query("sr4_split_by_date_quantile", E + """
, q AS (SELECT quantile_cont(CAST(strftime(race_date, '%Y%m%d') AS DOUBLE), 0.85) AS c FROM entries)
SELECT CASE WHEN CAST(strftime(race_date, '%Y%m%d') AS DOUBLE) < (SELECT c FROM q) THEN 'train' ELSE 'valid' END AS role, count(*) AS n, min(race_date) AS first_day, max(race_date) AS last_day FROM entries GROUP BY 1
""")
def sr4(spark: SparkSession, sf: str) -> DataFrame:
    out = S.split_by_date(entries(spark, sf), "race_date", 0.85)
    return out.groupBy("role").agg(F.count("*").alias("n"), F.min("race_date").alias("first_day"), F.max("race_date").alias("last_day"))


@query("sr5_folds", E + """
, f(y) AS (VALUES (1997), (1998), (1999)), b AS (SELECT least((row_number() OVER (ORDER BY race_date, race_id, runner_no) - 1) // greatest((SELECT count(*) FROM entries) // 5, 1), 4) AS block, is_win FROM entries)
SELECT 'year' AS kind, CAST(y AS BIGINT) AS fold, CASE WHEN year < y THEN 'train' ELSE 'valid' END AS role, count(*) AS n, CAST(sum(is_win) AS BIGINT) AS wins FROM entries JOIN f ON year < y + 2 GROUP BY ALL
UNION ALL SELECT 'block', block, 'block', count(*), CAST(sum(is_win) AS BIGINT) FROM b GROUP BY block
""")
def sr5(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf).select("race_date", "race_id", "runner_no", "year", "is_win")
    years = S.year_folds(e, [1997, 1998, 1999], window=2).groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("is_win").alias("wins"))
    blocks = S.positional_folds(e, ["race_date"], ["race_id", "runner_no"], 4).groupBy("block").agg(F.count("*").alias("n"), F.sum("is_win").alias("wins"))
    return years.select(F.lit("year").alias("kind"), F.col("fold").cast("bigint").alias("fold"), "role", "n", "wins").unionByName(
        blocks.select(F.lit("block").alias("kind"), F.col("block").alias("fold"), F.lit("block").alias("role"), "n", "wins")
    )
