"""The end-to-end query: features → ranking → bets → settlement → return per race class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.functions import bets as B
from formline.functions import columns as C
from formline.operators.history import expanding_rate
from formline.plans.registry import query
from formline.plans.views import E, entries


@query("flagship_roi_by_class", E + """,
cells AS (
  SELECT jockey_id, race_date, count(*) AS n, sum(is_win) AS h FROM entries GROUP BY ALL
),
state AS (
  SELECT jockey_id, race_date, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(h) OVER w, 0) AS h FROM cells
  WINDOW w AS (PARTITION BY jockey_id ORDER BY race_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
rated AS (
  SELECT e.*, (CAST(s.h AS DOUBLE) + (SELECT avg(CAST(is_win AS DOUBLE)) FROM entries) * 30.0::DOUBLE) / (CAST(s.n AS DOUBLE) + 30.0::DOUBLE) AS rate
  FROM entries e JOIN state s USING (jockey_id, race_date)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY rate DESC, runner_no) AS pr FROM rated WHERE field >= 3
),
picks AS (
  SELECT race_id, any_value(num_horses) AS num_horses, any_value(distance) AS distance, any_value(going) AS going,
         max(CASE WHEN finish = 1 THEN pr END) AS r1, max(CASE WHEN finish = 2 THEN pr END) AS r2, max(CASE WHEN finish = 3 THEN pr END) AS r3,
         CAST(floor((max(CASE WHEN finish = 1 THEN odds END) + max(CASE WHEN finish = 2 THEN odds END)
                     + max(CASE WHEN finish = 3 THEN odds END)) * 100.0::DOUBLE) AS BIGINT) AS yen
  FROM placed GROUP BY race_id
),
settled AS (
  SELECT CASE WHEN num_horses <= 7 THEN 'E' WHEN distance <= 1400 THEN 'D'
              WHEN num_horses <= 14 AND distance >= 1600 AND going < 2 THEN 'A'
              WHEN num_horses <= 14 AND distance >= 1600 THEN 'B'
              WHEN num_horses >= 15 AND distance >= 1600 AND going < 2 THEN 'C' ELSE 'X' END AS cond_key,
         CAST(least(r1, r2, r3) = 1 AND greatest(r1, r2, r3) <= 6 AND r1 + r2 + r3 - least(r1, r2, r3) - greatest(r1, r2, r3) <= 3 AS BIGINT) AS hit,
         CASE WHEN race_id % 50 <> 0 THEN yen ELSE 0 END AS yen
  FROM picks
)
SELECT cond_key, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(hit * yen) AS BIGINT) AS payout,
       CAST(sum(hit * yen) AS DOUBLE) / CAST(count(*) * 700 AS DOUBLE) * 100.0::DOUBLE AS roi
FROM settled GROUP BY cond_key
""")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    rated = expanding_rate(entries(spark, sf), ["jockey_id"], F.col("is_win"), 30.0, "rate").filter(F.col("field") >= 3)
    place = F.row_number().over(Window.partitionBy("race_id").orderBy(F.desc("rate"), "runner_no"))
    chosen = lambda rank, k: F.transform(
        F.sort_array(F.collect_list(F.when(F.col(rank) <= k, F.struct(F.col(rank), F.col("runner_no"))))), lambda x: x["runner_no"]
    )
    odds_of = lambda k: F.max(F.when(F.col("finish") == k, F.col("odds")))
    by_race = rated.withColumn("pr", place).groupBy("race_id").agg(
        *[F.first(c).alias(c) for c in ("num_horses", "distance", "going")],
        chosen("pr", 6).alias("picks"), F.array_sort(chosen("finish", 3)).alias("top3"),
        F.floor((odds_of(1) + odds_of(2) + odds_of(3)) * 100.0).alias("yen"),
    )
    settled = by_race.select(
        C.classify_race(F.col("num_horses"), F.col("distance"), F.col("going") >= 2).alias("cond_key"),
        B.has_hit(B.trio_bets(F.col("picks")), F.col("top3")).cast("bigint").alias("hit"),
        F.when(F.col("race_id") % 50 != 0, F.col("yen")).otherwise(0).alias("yen"),
    )
    paid = F.sum(F.col("hit") * F.col("yen"))
    return settled.groupBy("cond_key").agg(
        F.count("*").alias("n"), F.sum("hit").alias("hits"), paid.alias("payout"),
        (paid.cast("double") / (F.count("*") * 700).cast("double") * 100.0).alias("roi"),
    )
