"""Race-like views over the given tables, and the same views as SQL for the comparison.

A race is one order with its lines as runners. A race has a bounded number of runners (18 in the data model, 17 lines
at most here), so windows per race are small. Everything keyed by horse, jockey, trainer, sire, course or day can
grow without bound and goes through cells or chunks (formline.operators).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.functions import bets as B
from formline.functions import columns as C
from formline.operators.chunked import parts_for


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def entries(spark: SparkSession, sf: str, pedigree: bool = False) -> DataFrame:
    """One row per runner. `pedigree` adds the columns that come from the part table."""
    lines = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"
    )
    # The count comes from the file footers. Lines of an order meet here for the join and both windows.
    lines = lines.repartition(parts_for(lines.count()), "l_orderkey")
    nations = table(spark, sf, "customer").selectExpr("c_custkey AS o_custkey", "CAST(c_nationkey AS BIGINT) AS nation")
    heads = table(spark, sf, "orders").join(nations, "o_custkey").selectExpr(
        "o_orderkey AS l_orderkey", "to_date(o_orderdate) AS race_date", "nation", "o_custkey % 17 AS class_code",
        "CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END AS BIGINT) AS going",
    )
    rows = (
        lines.join(heads, "l_orderkey")
        .selectExpr("*", "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS runner_no")
        .selectExpr(
            "*", "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, runner_no) AS BIGINT) AS finish",
            "count(*) OVER (PARTITION BY l_orderkey) AS field",
        )
    )
    out = rows.selectExpr(
        "l_orderkey AS race_id", "race_date", "CAST(year(race_date) AS BIGINT) AS year", "CAST(month(race_date) AS BIGINT) AS month",
        "runner_no", "finish", "field", "field * 2 + l_orderkey % 5 AS num_horses", "l_partkey AS horse_id", "l_suppkey AS jockey_id",
        "nation * 100 + l_suppkey % 7 AS trainer_id", "l_orderkey % 17 * 100 + 1000 AS distance", "l_orderkey % 2 AS surface",
        "going", "class_code", "nation % 10 AS course", "CAST(l_linenumber AS BIGINT) AS pass4", "l_quantity AS carry",
        "l_extendedprice AS prize", "33.0D + l_tax * 100.0D AS last3f", "1.0D + l_discount * 50.0D + l_quantity / 10.0D AS odds",
        "0.2D + l_quantity * 0.01D + l_discount * 2.0D - l_tax AS score",
        "CAST(finish = 1 AS BIGINT) AS is_win", "CAST(finish <= 3 AS BIGINT) AS is_top3",
    )
    if pedigree:
        parts = table(spark, sf, "part").selectExpr(
            "p_partkey AS horse_id", "p_brand AS father", "p_type AS bms", "p_name AS horse_name",
            "CAST(p_size % 7 + 2 AS BIGINT) AS age", "p_size * 3.0D + 400.0D AS weight",
        )
        out = out.join(parts, "horse_id")
    return out


ENTRIES = """
entries_raw AS (
  SELECT l.*, CAST(o.o_orderdate AS DATE) AS race_date, CAST(c.c_nationkey AS BIGINT) AS nation, o.o_custkey,
         CAST(CASE o.o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END AS BIGINT) AS going,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS runner_no,
         count(*) OVER (PARTITION BY l_orderkey) AS field
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
),
entries_fin AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, runner_no) AS finish FROM entries_raw
),
entries AS (
  SELECT l_orderkey AS race_id, race_date, CAST(year(race_date) AS BIGINT) AS year, CAST(month(race_date) AS BIGINT) AS month,
         runner_no, finish, field, 2 * field + l_orderkey % 5 AS num_horses, l_partkey AS horse_id, l_suppkey AS jockey_id,
         nation * 100 + l_suppkey % 7 AS trainer_id, l_orderkey % 17 * 100 + 1000 AS distance, l_orderkey % 2 AS surface,
         going, o_custkey % 17 AS class_code, nation % 10 AS course, CAST(l_linenumber AS BIGINT) AS pass4,
         l_quantity AS carry, l_extendedprice AS prize, CAST(33.0 AS DOUBLE) + l_tax * 100.0::DOUBLE AS last3f,
         1.0::DOUBLE + l_discount * 50.0::DOUBLE + l_quantity / 10.0::DOUBLE AS odds,
         0.2::DOUBLE + l_quantity * 0.01::DOUBLE + l_discount * 2.0::DOUBLE - l_tax AS score,
         CAST(finish = 1 AS BIGINT) AS is_win, CAST(finish <= 3 AS BIGINT) AS is_top3,
         p.p_brand AS father, p.p_type AS bms, p.p_name AS horse_name, CAST(p.p_size % 7 + 2 AS BIGINT) AS age,
         p.p_size * 3.0::DOUBLE + 400.0::DOUBLE AS weight
  FROM entries_fin e JOIN part p ON e.l_partkey = p.p_partkey
)"""


def ranked(df: DataFrame) -> DataFrame:
    """Add pred_rank: place of each runner by score inside its race."""
    w = Window.partitionBy("race_id").orderBy(F.desc("score"), "runner_no")
    return df.withColumn("pred_rank", F.row_number().over(w).cast("bigint"))


RANKED = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY score DESC, runner_no) AS pred_rank FROM entries
)"""

RACE_COLUMNS = ["race_date", "year", "month", "course", "distance", "surface", "going", "class_code", "field", "num_horses"]


def races(spark: SparkSession, sf: str, min_field: int = 3) -> DataFrame:
    return race_rows(entries(spark, sf), min_field)


def race_rows(runners: DataFrame, min_field: int = 3) -> DataFrame:
    """One row per race of at least `min_field` runners: picks (top six by score), actual top three, bets, hits,
    estimated and real returns. The arrays hold six and three elements at most."""
    rows = ranked(runners).filter(f"field >= {min_field}")
    top = lambda rank, k: f"sort_array(collect_list(CASE WHEN {rank} <= {k} THEN struct({rank} AS r, runner_no AS u, odds AS o) END))"
    out = rows.groupBy("race_id").agg(
        *[F.first(c).alias(c) for c in RACE_COLUMNS], F.expr(top("pred_rank", 6)).alias("_p"), F.expr(top("finish", 3)).alias("_f")
    )
    out = out.selectExpr(
        "race_id", *RACE_COLUMNS, "_p.u AS picks", "_f.u AS order3", "array_sort(_f.u) AS top3", "_p[0].o AS top_odds",
        "_f[0].o AS o1", "_f[1].o AS o2", "_f[2].o AS o3",
    )
    return settle(out)


def settle(out: DataFrame) -> DataFrame:
    """Bets, hits, payouts and returns of a race row."""
    f1, f2, f3 = (F.element_at("order3", k) for k in (1, 2, 3))
    out = out.withColumns({
        "trio_bets": B.trio_bets(F.col("picks")), "pair_bets": B.pair_bets(F.col("picks")),
        "top2": F.array_sort(F.array(f1, f2)),
        **C.race_axes(*[F.col(c) for c in ("num_horses", "distance", "going", "course", "class_code", "month", "surface")])
        | {"course_name": F.concat(F.lit("c"), F.col("course").cast("string"))},
    } | {"course": F.col("course")})
    hits = lambda bets, target, name: f"CAST(exists({bets}, b -> b = {target}) AS BIGINT) AS {name}"
    out = out.selectExpr(
        "*", hits("trio_bets", "top3", "trio_hit"), hits("pair_bets", "top2", "umaren_hit"), hits("pair_bets", "top2", "w0"),
        hits("pair_bets", "array_sort(array(order3[0], order3[2]))", "w1"),
        hits("pair_bets", "array_sort(array(order3[1], order3[2]))", "w2"),
        "CAST(picks[0] = order3[0] AS BIGINT) AS tansho_hit", "CAST(slice(picks, 1, 3) = order3 AS BIGINT) AS tierce_hit",
        # Real payouts per 100 yen; some races have none.
        "CAST(race_id % 50 != 0 AS BIGINT) AS has_payout", "floor((o1 + o2 + o3) * 100.0D) AS trio_yen",
        "floor((o1 + o2) * 60.0D) AS umaren_yen", "floor(o1 * 100.0D) AS tansho_yen",
        "floor((o1 * 3.0D + o2 * 2.0D + o3) * 100.0D) AS tierce_yen", "floor((o1 + o2) * 25.0D) AS wide0",
        "floor((o1 + o3) * 25.0D) AS wide1", "floor((o2 + o3) * 25.0D) AS wide2",
    )
    o1, o2, o3 = F.col("o1"), F.col("o2"), F.col("o3")
    out = out.withColumns({
        "est_trio": B.estimate_trio(o1, o2, o3), "est_umaren": B.estimate_umaren(o1, o2),
        "est_wide0": B.estimate_wide(o1, o2), "est_wide1": B.estimate_wide(o1, o3), "est_wide2": B.estimate_wide(o2, o3),
    })
    return out.selectExpr(
        "*", "w0 + w1 + w2 AS wide_hits", "CAST(w0 + w1 + w2 > 0 AS BIGINT) AS wide_hit",
        "trio_hit * est_trio AS est_trio_return", "umaren_hit * est_umaren AS est_umaren_return",
        "w0 * est_wide0 + w1 * est_wide1 + w2 * est_wide2 AS est_wide_return",
        "CAST(has_payout * trio_hit * trio_yen AS DOUBLE) AS trio_return",
        "has_payout * umaren_hit * umaren_yen * 3.5D AS umaren_return",
        "has_payout * (w0 * wide0 + w1 * wide1 + w2 * wide2) * 3.5D AS wide_return",
        "has_payout * tansho_hit * tansho_yen * 7.0D AS tansho_return",
        "has_payout * tierce_hit * tierce_yen * 7.0D AS tierce_return",
    )


def _axes_sql() -> str:
    return """
         CASE WHEN num_horses <= 7 THEN 'E' WHEN distance <= 1400 THEN 'D'
              WHEN num_horses BETWEEN 8 AND 14 AND distance >= 1600 AND going < 2 THEN 'A'
              WHEN num_horses BETWEEN 8 AND 14 AND distance >= 1600 THEN 'B'
              WHEN num_horses >= 15 AND distance >= 1600 AND going < 2 THEN 'C' ELSE 'X' END AS cond_key,
         CASE WHEN distance <= 1200 THEN 'sprint' WHEN distance <= 1600 THEN 'mile' WHEN distance <= 2200 THEN 'middle' ELSE 'long' END AS dist,
         CASE WHEN num_horses <= 7 THEN 'small' WHEN num_horses <= 14 THEN 'medium' ELSE 'large' END AS nh,
         CASE WHEN going <= 1 THEN 'good' ELSE 'heavy' END AS cond,
         'c' || course AS course_name, 'cls' || class_code AS class,
         CASE WHEN month BETWEEN 3 AND 5 THEN 'spring' WHEN month BETWEEN 6 AND 8 THEN 'summer'
              WHEN month BETWEEN 9 AND 11 THEN 'autumn' ELSE 'winter' END AS season"""


AXES_SQL = _axes_sql()

# Settlement in SQL is written from joins of ranked runners, not from array functions.
RACES = f"""
heads AS (
  SELECT race_id, any_value(race_date) AS race_date, any_value(year) AS year, any_value(month) AS month,
         any_value(course) AS course, any_value(distance) AS distance, any_value(surface) AS surface_code,
         any_value(going) AS going, any_value(class_code) AS class_code, any_value(field) AS field,
         any_value(num_horses) AS num_horses,
         max(CASE WHEN pred_rank = 1 THEN odds END) AS top_odds,
         max(CASE WHEN finish = 1 THEN runner_no END) AS f1, max(CASE WHEN finish = 2 THEN runner_no END) AS f2,
         max(CASE WHEN finish = 3 THEN runner_no END) AS f3,
         max(CASE WHEN finish = 1 THEN odds END) AS o1, max(CASE WHEN finish = 2 THEN odds END) AS o2,
         max(CASE WHEN finish = 3 THEN odds END) AS o3,
         max(CASE WHEN pred_rank = 1 THEN finish END) AS q1, max(CASE WHEN pred_rank = 2 THEN finish END) AS q2,
         max(CASE WHEN pred_rank = 3 THEN finish END) AS q3,
         max(CASE WHEN finish = 1 THEN pred_rank END) AS r1, max(CASE WHEN finish = 2 THEN pred_rank END) AS r2,
         max(CASE WHEN finish = 3 THEN pred_rank END) AS r3
  FROM ranked WHERE field >= 3 GROUP BY race_id
),
hit_flags AS (
  SELECT *,
    -- a triple {{1, s, t}} with s in ranks 2-3 and t in ranks 2-6 is the top three
    CAST(least(r1, r2, r3) = 1 AND greatest(r1, r2, r3) <= 6 AND (r1 + r2 + r3 - least(r1, r2, r3) - greatest(r1, r2, r3)) <= 3 AS BIGINT) AS trio_hit,
    CAST(least(r1, r2) = 1 AND greatest(r1, r2) <= 3 AS BIGINT) AS umaren_hit,
    CAST(least(r1, r2) = 1 AND greatest(r1, r2) <= 3 AS BIGINT) AS w0,
    CAST(least(r1, r3) = 1 AND greatest(r1, r3) <= 3 AS BIGINT) AS w1,
    CAST(least(r2, r3) = 1 AND greatest(r2, r3) <= 3 AS BIGINT) AS w2,
    CAST(q1 = 1 AS BIGINT) AS tansho_hit,
    CAST(q1 = 1 AND q2 = 2 AND q3 = 3 AS BIGINT) AS tierce_hit,
    CAST(race_id % 50 <> 0 AS BIGINT) AS has_payout,
    CAST(floor((o1 + o2 + o3) * 100.0::DOUBLE) AS BIGINT) AS trio_yen,
    CAST(floor((o1 + o2) * 60.0::DOUBLE) AS BIGINT) AS umaren_yen,
    CAST(floor(o1 * 100.0::DOUBLE) AS BIGINT) AS tansho_yen,
    CAST(floor((o1 * 3.0::DOUBLE + o2 * 2.0::DOUBLE + o3) * 100.0::DOUBLE) AS BIGINT) AS tierce_yen,
    CAST(floor((o1 + o2) * 25.0::DOUBLE) AS BIGINT) AS wide0, CAST(floor((o1 + o3) * 25.0::DOUBLE) AS BIGINT) AS wide1,
    CAST(floor((o2 + o3) * 25.0::DOUBLE) AS BIGINT) AS wide2,
    greatest(100, CAST(floor(o1 * o2 * o3 * 20.0::DOUBLE) AS BIGINT)) AS est_trio,
    greatest(100, CAST(floor(o1 * o2 * 50.0::DOUBLE) AS BIGINT)) AS est_umaren,
    greatest(100, CAST(floor(o1 * o2 * 15.0::DOUBLE) AS BIGINT)) AS est_wide0,
    greatest(100, CAST(floor(o1 * o3 * 15.0::DOUBLE) AS BIGINT)) AS est_wide1,
    greatest(100, CAST(floor(o2 * o3 * 15.0::DOUBLE) AS BIGINT)) AS est_wide2
  FROM heads
),
races AS (
  SELECT *, {AXES_SQL}, CASE surface_code WHEN 0 THEN 'turf' ELSE 'dirt' END AS surface,
    w0 + w1 + w2 AS wide_hits, CAST(w0 + w1 + w2 > 0 AS BIGINT) AS wide_hit,
    trio_hit * est_trio AS est_trio_return, umaren_hit * est_umaren AS est_umaren_return,
    w0 * est_wide0 + w1 * est_wide1 + w2 * est_wide2 AS est_wide_return,
    CAST(has_payout * trio_hit * trio_yen AS DOUBLE) AS trio_return,
    CAST(has_payout * umaren_hit * umaren_yen AS DOUBLE) * 3.5::DOUBLE AS umaren_return,
    CAST(has_payout * (w0 * wide0 + w1 * wide1 + w2 * wide2) AS DOUBLE) * 3.5::DOUBLE AS wide_return,
    CAST(has_payout * tansho_hit * tansho_yen AS DOUBLE) * 7.0::DOUBLE AS tansho_return,
    CAST(has_payout * tierce_hit * tierce_yen AS DOUBLE) * 7.0::DOUBLE AS tierce_return
  FROM hit_flags
)"""


def workouts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("horse_id"), F.to_date("l_shipdate").alias("work_date"),
        (F.lit(48.0) + F.col("l_tax") * 40.0).alias("time_4f"), (F.lit(36.0) + F.col("l_discount") * 30.0).alias("time_3f"),
        F.col("l_returnflag").alias("kind"),
    )


WORKOUTS = """
workouts AS (
  SELECT l_partkey AS horse_id, CAST(l_shipdate AS DATE) AS work_date, 48.0::DOUBLE + l_tax * 40.0::DOUBLE AS time_4f,
         36.0::DOUBLE + l_discount * 30.0::DOUBLE AS time_3f, l_returnflag AS kind
  FROM lineitem
)"""


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """One settled row per event: stake 100, returned = value when it hit."""
    hit = F.col("event_type") == "purchase"
    return table(spark, sf, "events").select(
        F.col("event_id").alias("race_id"), F.col("user_id").alias("entity"), "ts", F.to_date("ts").alias("day"),
        F.col("event_type").alias("kind"), hit.cast("bigint").alias("hit"),
        F.floor(F.when(hit, F.col("value") * 100.0).otherwise(0.0)).cast("bigint").alias("payout"),
        F.element_at(F.array(*[F.lit(k) for k in "ABCDEX"]), (F.col("user_id") % 6 + 1).cast("int")).alias("cond_key"),
        F.try_element_at(F.from_json("props", "map<string,bigint>"), F.lit("k")).alias("k"),
    )


LEDGER = """
ledger AS (
  SELECT event_id AS race_id, user_id AS entity, ts, CAST(ts AS DATE) AS day, event_type AS kind,
         CAST(event_type = 'purchase' AS BIGINT) AS hit,
         CAST(floor(CASE WHEN event_type = 'purchase' THEN value * 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS BIGINT) AS payout,
         substr('ABCDEX', CAST(user_id % 6 + 1 AS INTEGER), 1) AS cond_key,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
)"""


def with_views(*parts: str) -> str:
    return "WITH " + ",".join(parts)


E = with_views(ENTRIES)
R = with_views(ENTRIES, RANKED)
RR = with_views(ENTRIES, RANKED, RACES)
L = with_views(LEDGER)
