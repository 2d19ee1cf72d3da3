"""Streaming jobs (STR*) over the events table, each compared with the batch result of the same rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.plans.registry import ORACLES, query
from formline.plans.views import LEDGER, ledger, table, with_views
from formline.session import scratch_path
from formline.sources.snapshots import SnapshotTable, upsert_stream
from formline.streaming import ledger as T

# A window is final when it ends at or before the last event minus the delay of one hour.
CLOSED = with_views(LEDGER) + ", top AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM ledger)"


LEDGER_SQL = with_views(LEDGER) + "SELECT race_id % 500 AS slot, count(*) AS n, CAST(sum(payout) AS BIGINT) AS paid FROM ledger GROUP BY 1"


def slots(table: SnapshotTable) -> DataFrame:
    return table.read().groupBy((F.col("race_id") % 500).alias("slot")).agg(F.count("*").alias("n"), F.sum("payout").alias("paid"))


@query("str1_upsert_ledger", LEDGER_SQL)
def str1(spark: SparkSession, sf: str) -> DataFrame:
    jobs = T.Jobs(spark)
    ledger = SnapshotTable(spark, jobs.path("ledger"), "day")
    rows = T.event_stream(spark, sf).withColumn("day", F.to_date("ts"))
    # Twice, as two streams: the second one must replace, not add.
    for name in ("first", "again"):
        upsert_stream(rows, ledger, ["race_id"], name, jobs.checkpoint(name), ["ts"])
    return slots(ledger)


@query("str1_repeated_batch", LEDGER_SQL)
def str1_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """A stream fails after its batch was committed and before that was noted: the batch comes again and changes nothing,
    not even where its rows are others by now."""
    jobs = T.Jobs(spark)
    ledger = SnapshotTable(spark, jobs.path("ledger"), "day")
    rows = T.event_stream(spark, sf).withColumn("day", F.to_date("ts"))
    upsert_stream(rows, ledger, ["race_id"], "results", jobs.checkpoint("one"), ["ts"])
    # A lost checkpoint sends the batches again under the same numbers.
    upsert_stream(rows.withColumn("payout", F.col("payout") + 1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")), ledger, ["race_id"], "results", jobs.checkpoint("two"), ["ts"])
    return slots(ledger)


@query("str2_window_report", CLOSED + """
SELECT CAST(day AS VARCHAR) AS day, cond_key, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(payout) AS BIGINT) AS paid FROM ledger, top WHERE CAST(day + 1 AS TIMESTAMP) <= mark GROUP BY 1, 2
""")
def str2(spark: SparkSession, sf: str) -> DataFrame:
    return day_report(T.Jobs(spark), T.event_stream(spark, sf))


def day_report(jobs: T.Jobs, events: DataFrame) -> DataFrame:
    out = jobs.run(T.window_report(events, "ts", ["cond_key"], "1 day", "1 hour", {"hits": F.col("hit"), "paid": F.col("payout")}), "day-report")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "cond_key", "n", "hits", "paid")


@query("str3_settle_stream", with_views(LEDGER) + """
, p AS (SELECT race_id, ts FROM ledger), r AS (SELECT race_id - 1 AS race_id, ts AS r_ts, payout FROM ledger WHERE hit = 1),
top AS (SELECT least((SELECT max(ts) FROM p), (SELECT max(r_ts) FROM r)) - INTERVAL 1 HOUR AS mark)
SELECT p.race_id, CASE WHEN r.race_id IS NULL THEN 'pending' ELSE 'settled' END AS status, payout FROM top, p LEFT JOIN r ON r.race_id = p.race_id AND r_ts >= ts AND r_ts <= ts + INTERVAL 2 HOUR WHERE r.race_id IS NOT NULL OR ts + INTERVAL 2 HOUR < mark
""")
def str3(spark: SparkSession, sf: str) -> DataFrame:
    events = T.event_stream(spark, sf)
    predictions = events.selectExpr("race_id", "ts")
    results = T.event_stream(spark, sf).filter("hit = 1").selectExpr("race_id - 1 AS race_id", "ts AS r_ts", "payout")
    out = T.settle_stream(predictions, results, "race_id", "ts", "r_ts", "2 HOURS", "1 hour")
    return T.run_to_table(out, "settled").select("race_id", "status", "payout")


@query("str4_running_rate", CLOSED + """
, c AS (SELECT entity, day, count(*) AS n, sum(hit) AS h FROM ledger, top WHERE CAST(day + 1 AS TIMESTAMP) <= mark GROUP BY 1, 2)
SELECT entity, CAST(day AS VARCHAR) AS day, n, CAST(h AS BIGINT) AS hits, (CAST(coalesce(sum(h) OVER w, 0) AS DOUBLE) + 30.0::DOUBLE * 0.1::DOUBLE) / (CAST(coalesce(sum(n) OVER w, 0) AS DOUBLE) + 30.0::DOUBLE) AS rate
FROM c WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def str4(spark: SparkSession, sf: str) -> DataFrame:
    return rates(T.Jobs(spark), T.event_stream(spark, sf))


def rates(jobs: T.Jobs, events: DataFrame) -> DataFrame:
    cells = T.window_report(events, "ts", ["entity"], "1 day", "1 hour", {"hits": F.col("hit")})
    out = jobs.run(T.running_rate_stream(jobs.follow(cells, "day-cells"), "entity", 30.0, 0.1), "rates")
    return out.select("entity", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "hits", "rate")


@query("str5_rolling_context", CLOSED + """
, c AS (SELECT cond_key, date_trunc('hour', ts) AS hr, count(*) AS n, sum(hit) AS h FROM ledger, top WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2)
SELECT cond_key, strftime(hr, '%Y-%m-%d %H') AS hour, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS prev_n, CAST(coalesce(sum(h) OVER w, 0) AS BIGINT) AS prev_hits, count(*) OVER w AS prev_windows
FROM c WINDOW w AS (PARTITION BY cond_key ORDER BY hr ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
""")
def str5(spark: SparkSession, sf: str) -> DataFrame:
    return contexts(T.Jobs(spark), T.event_stream(spark, sf))


def contexts(jobs: T.Jobs, events: DataFrame) -> DataFrame:
    cells = T.window_report(events, "ts", ["cond_key"], "1 hour", "1 hour", {"hits": F.col("hit")})
    out = jobs.run(T.rolling_context_stream(jobs.follow(cells, "hour-cells"), "cond_key"), "context")
    return out.select("cond_key", F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "prev_n", "prev_hits", "prev_windows")


@query("str6_distinct_stream", with_views(LEDGER) + "SELECT race_id, payout FROM ledger")
def str6(spark: SparkSession, sf: str) -> DataFrame:
    doubled = T.event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return T.run_to_table(T.distinct_stream(doubled, "ts", ["race_id"], "1 day"), "distinct").select("race_id", "payout")


def in_two_runs(spark: SparkSession, sf: str, job: Callable[[T.Jobs, DataFrame], DataFrame]) -> DataFrame:
    """The job over the earlier half of the events; then, as later events have come, once more with the same folder."""
    jobs = T.Jobs(spark)
    events, feed = table(spark, sf, "events"), scratch_path(spark, "feed")
    middle = events.select(F.timestamp_micros(((F.min(micros()) + F.max(micros())) / 2).cast("bigint")).cast("timestamp_ntz")).first()[0]
    out = None
    for half in (F.col("ts") < F.lit(middle), F.col("ts") >= F.lit(middle)):
        events.filter(half).write.mode("append").parquet(feed)
        out = job(jobs, T.events_of(spark.readStream.schema(events.schema).parquet(feed)))
    return out


def micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


@query("str2_two_runs", ORACLES["str2_window_report"])
def str2_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    return in_two_runs(spark, sf, day_report)


@query("str4_two_runs", ORACLES["str4_running_rate"])
def str4_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    return in_two_runs(spark, sf, rates)


@query("str5_two_runs", ORACLES["str5_rolling_context"])
def str5_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    return in_two_runs(spark, sf, contexts)


@query("str6_two_runs", ORACLES["str6_distinct_stream"])
def str6_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every event comes twice in each run."""

    def job(jobs: T.Jobs, events: DataFrame) -> DataFrame:
        doubled = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
        return jobs.run(T.distinct_stream(doubled, "ts", ["race_id"], "1 day"), "distinct").select("race_id", "payout")

    return in_two_runs(spark, sf, job)


@query("str4_from_ledger", CLOSED + """
, c AS (SELECT entity, day, count(*) AS n, sum(hit) AS h FROM ledger, top WHERE CAST(day + 1 AS TIMESTAMP) <= mark GROUP BY 1, 2),
r AS (SELECT entity, CAST(day AS VARCHAR) AS day, n, CAST(h AS BIGINT) AS hits,
  (CAST(coalesce(sum(h) OVER w, 0) AS DOUBLE) + 30.0::DOUBLE * 0.1::DOUBLE) / (CAST(coalesce(sum(n) OVER w, 0) AS DOUBLE) + 30.0::DOUBLE) AS rate
  FROM c WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT * FROM r WHERE day >= '2024-01-15'
""")
def str4_from_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The stream begins in the middle of the month; a batch job has given the totals of the days before."""
    jobs = T.Jobs(spark)
    rows, first = ledger(spark, sf), "2024-01-15"
    before = rows.filter(F.col("day") < first).groupBy("entity").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    cells = T.window_report(T.event_stream(spark, sf).filter(F.col("ts") >= first), "ts", ["entity"], "1 day", "1 hour", {"hits": F.col("hit")})
    out = jobs.run(T.running_rate_stream(jobs.follow(cells, "day-cells"), "entity", 30.0, 0.1, before), "rates")
    return out.select("entity", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "hits", "rate")


@query("str5_idle_context", CLOSED + """
, c AS (SELECT entity, date_trunc('hour', ts) AS hr, count(*) AS n, sum(hit) AS h FROM ledger, top WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY hr) AS spell FROM (SELECT *, CASE WHEN hr - lag(hr) OVER (PARTITION BY entity ORDER BY hr) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM c))
SELECT entity, strftime(hr, '%Y-%m-%d %H') AS hour, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS prev_n, CAST(coalesce(sum(h) OVER w, 0) AS BIGINT) AS prev_hits, count(*) OVER w AS prev_windows
FROM g WINDOW w AS (PARTITION BY entity, spell ORDER BY hr ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
""")
def str5_idle(spark: SparkSession, sf: str) -> DataFrame:
    """Context of an entity; a rest of over twelve hours of event time ends it, and a timer drops its state."""

    def job(jobs: T.Jobs, events: DataFrame) -> DataFrame:
        cells = T.window_report(events, "ts", ["entity"], "1 hour", "1 hour", {"hits": F.col("hit")})
        out = jobs.run(T.rolling_context_stream(jobs.follow(cells, "hour-cells"), "entity", idle_ms=12 * 3_600_000), "context")
        return out.select("entity", F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "prev_n", "prev_hits", "prev_windows")

    return in_two_runs(spark, sf, job)
