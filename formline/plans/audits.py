"""Leak and quality audits (LK*, AG40, AG42, AG43)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.operators import audit as A
from formline.operators import history as H
from formline.operators import roi as Q
from formline.constants import FEATURE_STATUS
from formline.plans.registry import query
from formline.plans.views import RR, E, entries, races, table


KNOWN = [(n, k) for k, names in FEATURE_STATUS.items() for n in names]
KNOWN_SQL = ", ".join(f"({i}, '{n}', '{k}')" for i, (n, k) in enumerate(KNOWN))


@query("lk1_classify_features", f"""
WITH known(i, name, kind) AS (VALUES {KNOWN_SQL}),
n AS (SELECT coalesce(name, 'colour_' || p_name) AS feature, coalesce(kind, 'UNKNOWN') AS status FROM part LEFT JOIN known ON p_partkey % {len(KNOWN) + 1} = i)
SELECT status, count(*) AS n, count(DISTINCT feature) AS features FROM n GROUP BY 1
""")
def lk1(spark: SparkSession, sf: str) -> DataFrame:
    """Parts stand for features: every known name in turn, then an invented one."""
    names = F.array(*[F.lit(n) for n, _ in KNOWN])
    at = (F.col("p_partkey") % (len(KNOWN) + 1)).cast("int")
    features = table(spark, sf, "part").select(F.when(at < len(KNOWN), F.get(names, at)).otherwise(F.concat(F.lit("colour_"), "p_name")).alias("feature"))
    return A.classify_features(features).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("feature").alias("features"))


@query("lk2_leak_test", "SELECT 'day' AS mode, CAST(0 AS BIGINT) AS leaking_rows UNION ALL SELECT 'race', CAST(0 AS BIGINT)")
def lk2(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf).select("race_id", "race_date", "runner_no", "jockey_id", "is_win")

    def test(mode: str) -> DataFrame:
        # A fixed prior: the mean of the whole table would see the future by design.
        feature = lambda df: H.expanding_rate(df, ["jockey_id"], F.col("is_win"), 30.0, "rate", prior=0.08, mode=mode)
        # Race mode sees earlier races of the same day, so only whole days before the cut are compared there.
        cut = "1998-03-01"
        found = A.leaks(e, feature, ["race_id", "runner_no", "race_date"], {"is_win": F.lit(0).cast("bigint")}, "race_date", cut)
        if mode == "race":
            found = found.filter(F.col("race_date") < F.lit(cut).cast("date"))
        return found.agg(F.count("*").alias("leaking_rows")).select(F.lit(mode).alias("mode"), "leaking_rows")

    return test("day").unionByName(test("race"))


@query("lk3_repair_finish", E + """
, b AS (SELECT race_id, runner_no, CASE WHEN race_id % 5 = 0 THEN 0 WHEN runner_no % 4 = 0 THEN NULL ELSE finish END AS f, CASE WHEN runner_no % 7 = 0 THEN NULL ELSE last3f + runner_no END AS t FROM entries),
r AS (SELECT *, rank() OVER (PARTITION BY race_id ORDER BY t ASC NULLS LAST) AS k FROM b)
SELECT race_id, runner_no, CASE WHEN (f IS NULL OR f = 0) AND t > 0 THEN k ELSE f END AS finish FROM r
""")
def lk3(spark: SparkSession, sf: str) -> DataFrame:
    b = entries(spark, sf).selectExpr(
        "race_id", "runner_no", "CASE WHEN race_id % 5 = 0 THEN 0 WHEN runner_no % 4 = 0 THEN NULL ELSE finish END AS finish",
        "CASE WHEN runner_no % 7 = 0 THEN NULL ELSE last3f + runner_no END AS t",
    )
    return A.repair_finish(b, ["race_id"], "finish", "t").select("race_id", "runner_no", "finish")


@query("lk4_verdicts", RR + """
SELECT 'payout_coverage' AS check, CAST(1 AS BIGINT) AS rows, CASE WHEN avg(has_payout) >= 0.95 THEN 'PASS' ELSE 'WARN' END AS verdict FROM races
UNION ALL SELECT 'hits_need_three', count(*), CASE WHEN bool_and(field >= 3) THEN 'PASS' ELSE 'WARN' END FROM races
UNION ALL SELECT 'classes_above_100', count(*), CASE WHEN bool_and(roi >= 100) THEN 'PASS' ELSE 'WARN' END FROM (SELECT cond_key, sum(trio_return) / CAST(count(*) * 700 AS DOUBLE) * 100.0::DOUBLE AS roi FROM races GROUP BY 1)
""")
def lk4(spark: SparkSession, sf: str) -> DataFrame:
    r = races(spark, sf)
    by_class = r.groupBy("cond_key").agg(Q.roi_percent(F.sum("trio_return"), F.count("*")).alias("roi"))
    return A.verdicts([
        ("payout_coverage", r.agg(F.avg("has_payout").alias("c")), F.col("c") >= 0.95),
        ("hits_need_three", r, F.col("field") >= 3),
        ("classes_above_100", by_class, F.col("roi") >= 100),
    ])


@query("lk5_date_from_key", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS race_date FROM orders
""")
def lk5(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    known = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, "")
    key = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", A.date_from_key(known, key).alias("race_date"))


PROFILE_COLUMNS = ["event_id", "user_id", "event_type", "value", "flag"]


@query("ag40_profile", "WITH p AS (SELECT *, CASE WHEN event_type = 'view' THEN ' ' WHEN event_type = 'click' THEN NULL ELSE 'x' END AS flag FROM events) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) AS rows, CAST(count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS DOUBLE) / count(*) AS missing, CAST(min({c}) AS VARCHAR) AS lowest, CAST(max({c}) AS VARCHAR) AS highest FROM p" for c in PROFILE_COLUMNS
))
def ag40(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("flag", F.when(F.col("event_type") == "view", " ").when(F.col("event_type") != "click", "x"))
    return A.profile(rows, PROFILE_COLUMNS)


@query("ag42_integrity", RR + """
, g AS (SELECT cond_key, count(*) AS n, sum(trio_return) AS paid, round(sum(trio_return) / CAST(count(*) * 700 AS DOUBLE) * 100.0::DOUBLE, 1) + CASE WHEN cond_key = 'B' THEN 1 ELSE 0 END AS reported FROM races GROUP BY 1)
SELECT cond_key, reported, round(paid / CAST(n * 700 AS DOUBLE) * 100.0::DOUBLE, 6) AS recomputed, CASE WHEN abs(paid / CAST(n * 700 AS DOUBLE) * 100.0::DOUBLE - reported) <= 0.2 THEN 'OK' ELSE 'MISMATCH' END AS verdict FROM g
""")
def ag42(spark: SparkSession, sf: str) -> DataFrame:
    roi = Q.roi_percent(F.sum("trio_return"), F.count("*"))
    g = races(spark, sf).groupBy("cond_key").agg(roi.alias("roi"))
    reported = F.round("roi", 1) + F.when(F.col("cond_key") == "B", 1).otherwise(0)
    return g.select(
        "cond_key", reported.alias("reported"), F.round("roi", 6).alias("recomputed"), F.when(F.abs(F.col("roi") - reported) <= 0.2, "OK").otherwise("MISMATCH").alias("verdict")
    )


@query("ag43_acquisition", """
SELECT * FROM (VALUES ('l_quantity', 'acquired'), ('l_tax_zero', 'all_zero'), ('l_none', 'all_null'), ('is_regional', 'acquired'), ('wind_speed', 'absent')) t(feature, state) WHERE (SELECT count(*) FROM lineitem) > 0
""")
def ag43(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr("l_quantity", "l_tax * 0 AS l_tax_zero", "CAST(NULL AS DOUBLE) AS l_none", "l_linenumber * 0 AS is_regional")
    return A.acquisition(rows, ["l_quantity", "l_tax_zero", "l_none", "is_regional", "wind_speed"], may_be_zero=["is_regional"])


SUSPECTS = {
    "l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "l_linenumber": "l_linenumber", "l_quantity": "l_quantity",
    "pace": "CASE WHEN l_orderkey % 5 = 0 THEN l_partkey ELSE 0 END", "best_4f": "CASE WHEN l_orderkey % 10 < 6 THEN 49.1 ELSE l_quantity END",
    "unseen": "CASE WHEN l_orderkey % 3 > 0 THEN NULL ELSE l_suppkey END", "flag": "0", "cushion": "0",
}
SUSPECT_SQL = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({e} AS VARCHAR) AS value FROM lineitem" for f, e in SUSPECTS.items() if f != "cushion")


@query("ag43_default_suspects", f"""
WITH v AS ({SUSPECT_SQL}), t AS (SELECT count(*) AS rows FROM lineitem)
SELECT feature, value, count(*) AS n, round(count(*) / CAST(any_value(rows) AS DOUBLE), 9) AS share FROM v, t GROUP BY feature, value HAVING count(*) > 0.4 * any_value(rows)
""")
def ag43_suspects(spark: SparkSession, sf: str) -> DataFrame:
    """Columns filled with 0, a mean or nothing; `cushion` is known to be 0."""
    rows = table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {f}" for f, e in SUSPECTS.items()])
    found = A.default_suspects(rows, list(SUSPECTS), 0.4, may_repeat=["cushion"])
    return found.select("feature", "value", "n", F.round("share", 9).alias("share"))


@query("lk2_row_order_leaks", E + """
, e AS (SELECT race_id, race_date, runner_no, jockey_id, is_win, sum(is_win) OVER (PARTITION BY jockey_id, race_date ORDER BY race_id, runner_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM entries)
SELECT CAST(race_date AS VARCHAR) AS day, count(*) AS leaking_rows FROM e WHERE race_date = DATE '1996-06-01' AND earlier > 0 GROUP BY 1
""")
def lk2_row(spark: SparkSession, sf: str) -> DataFrame:
    """Rates in row order see the winners of the same day: the test must find just the rows after one."""
    e = entries(spark, sf).select("race_id", "race_date", "runner_no", "jockey_id", "is_win")
    feature = lambda df: H.expanding_rate(df, ["jockey_id"], F.col("is_win"), 30.0, "rate", prior=0.08, mode="row")
    found = A.leaks(e, feature, ["race_id", "runner_no", "race_date"], {"is_win": F.lit(0).cast("bigint")}, "race_date", "1996-06-01")
    return found.groupBy(F.col("race_date").cast("string").alias("day")).agg(F.count("*").alias("leaking_rows"))
