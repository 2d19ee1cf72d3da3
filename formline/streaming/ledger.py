"""The daily jobs as streams. Event-time columns are timestamps; every job ends by itself with an availableNow trigger.

Rows are added up per (key, window) by the built-in aggregation first, so the state functions see one row per key and
window, whatever share of the rows a key has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from formline.session import scratch_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Keeps state of any size on the executors' disks; the state functions need it.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store for jobs that are started inside; a checkpoint keeps the one it began with."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Jobs:
    """The durable places of named jobs below one folder: each has a checkpoint, which holds how far its source was read
    and its state, and an output table, whose log takes every batch once. A job that is run again goes on where it
    stopped, also after a failure in the middle."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, (root or scratch_path(spark, "jobs")).rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}/table"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/{name}/checkpoint"

    def run(self, stream: DataFrame, name: str) -> DataFrame:
        """Append everything that is available and new to the job's table; the whole table."""
        writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        with rocksdb(self.spark):
            writer.option("path", self.path(name)).option("checkpointLocation", self.checkpoint(name)).start().awaitTermination()
        return self.spark.read.schema(stream.schema).parquet(self.path(name))

    def follow(self, stream: DataFrame, name: str) -> DataFrame:
        """Run the job and read its table as a stream. Spark allows no state function right after an aggregation, so
        windowed sums are a table of their own; final windows reach it in time order."""
        self.run(stream, name)
        return self.spark.readStream.schema(stream.schema).parquet(self.path(name))


def run_to_table(stream: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """One job's table; without `root` the job starts anew."""
    return Jobs(stream.sparkSession, root).run(stream, name)


def window_report(stream: DataFrame, ts: str, keys: Sequence[str], length: str, delay: str, sums: dict[str, Column], start: str = "0 days") -> DataFrame:
    """Tumbling windows per key with sums; a window is final once the watermark has passed it."""
    cells = stream.withWatermark(ts, delay).groupBy(F.window(ts, length, startTime=start).alias("w"), *keys)
    out = cells.agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", *sums)


def settle_stream(predictions: DataFrame, results: DataFrame, key: str, p_ts: str, r_ts: str, within: str, delay: str) -> DataFrame:
    """Predictions joined with results that arrive in time; without one they come out as pending after the watermark."""
    p = predictions.withWatermark(p_ts, delay)
    r = results.withColumnRenamed(key, "__key").withWatermark(r_ts, delay)
    same = (F.col(key) == F.col("__key")) & (F.col(r_ts) >= F.col(p_ts)) & (F.col(r_ts) <= F.col(p_ts) + F.expr(f"INTERVAL {within}"))
    out = p.join(r, same, "left_outer")
    return out.withColumn("status", F.when(F.col("__key").isNull(), "pending").otherwise("settled")).drop("__key")


def distinct_stream(stream: DataFrame, ts: str, keys: Sequence[str], horizon: str) -> DataFrame:
    """First row per key within the horizon."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(list(keys))


def expired(last: int | None, idle_ms: int | None, now: int) -> bool:
    """Whether a key rested for longer than `idle_ms` of event time."""
    return last is not None and idle_ms is not None and now - last > idle_ms


class WindowState(StatefulProcessor):
    """State of one key over its windows in time order. `idle_ms`: a key without a window for so much event time starts
    anew; a timer then drops its state, but what comes out does not depend on when it fires."""

    columns: Sequence[str]
    state_schema: str

    def __init__(self, key: str, idle_ms: int | None) -> None:
        self.key, self.idle_ms = key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("windows", f"{self.state_schema}, last bigint")

    def fresh(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, n: int, hits: int) -> tuple[tuple, tuple]:
        """What comes out for a window, and the state after it."""
        raise NotImplementedError

    def seeded(self, rows: pd.DataFrame) -> tuple:
        """State from a ledger's rows of the key."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *state, last = self.state.get() if self.state.exists() else (*self.fresh(), None)
        out = []
        table = pd.concat(list(rows)).sort_values("window_start")
        for start, n, hits in zip(table["window_start"], table["n"], table["hits"], strict=True):
            now = int(start.timestamp() * 1000)
            if expired(last, self.idle_ms, now):
                state = self.fresh()
            shown, state = self.step(tuple(state), int(n), int(hits))
            out.append((key[0], start, *shown))
            last = now
        self.state.update((*state, last))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.idle_ms + 1)
        yield pd.DataFrame(out, columns=[self.key, "window_start", *self.columns])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((*self.seeded(initialState), None))

    def close(self) -> None:
        pass


class RunningTotals(WindowState):
    columns, state_schema = ("n", "hits", "rate"), "n bigint, hits bigint"

    def __init__(self, key: str, idle_ms: int | None, alpha: float, prior: float) -> None:
        super().__init__(key, idle_ms)
        self.alpha, self.prior = alpha, prior

    def fresh(self) -> tuple:
        return 0, 0

    def step(self, state: tuple, n: int, hits: int) -> tuple[tuple, tuple]:
        before_n, before_hits = state
        return (n, hits, (before_hits + self.alpha * self.prior) / (before_n + self.alpha)), (before_n + n, before_hits + hits)

    def seeded(self, rows: pd.DataFrame) -> tuple:
        return int(rows["n"].sum()), int(rows["hits"].sum())


class LastWindows(WindowState):
    columns, state_schema = ("prev_n", "prev_hits", "prev_windows"), "n array<bigint>, hits array<bigint>"

    def __init__(self, key: str, idle_ms: int | None, depth: int) -> None:
        super().__init__(key, idle_ms)
        self.depth = depth

    def fresh(self) -> tuple:
        return [], []

    def step(self, state: tuple, n: int, hits: int) -> tuple[tuple, tuple]:
        past_n, past_hits = map(list, state)
        return (sum(past_n), sum(past_hits), len(past_n)), ([*past_n, n][-self.depth :], [*past_hits, hits][-self.depth :])

    def seeded(self, rows: pd.DataFrame) -> tuple:
        rows = rows.sort_values("window_start").tail(self.depth)
        return [int(x) for x in rows["n"]], [int(x) for x in rows["hits"]]


def with_state(cells: DataFrame, key: str, processor: WindowState, schema: str, ledger: DataFrame | None, watermark: str) -> DataFrame:
    seed = None if ledger is None else ledger.groupBy(key)
    timed = cells.withWatermark("window_start", watermark)
    return timed.groupBy(key).transformWithStateInPandas(processor, f"{key} {dict(cells.dtypes)[key]}, window_start timestamp, {schema}", "append", "EventTime", seed)


def running_rate_stream(cells: DataFrame, key: str, alpha: float, prior: float, ledger: DataFrame | None = None, idle_ms: int | None = None) -> DataFrame:
    """(hits + alpha * prior) / (n + alpha) of all earlier windows per key. Input: window_start, key, n, hits (final
    windows); state: the two totals of the key. `ledger` (key, n, hits) gives totals from before the stream's first run,
    any number of rows a key."""
    return with_state(cells, key, RunningTotals(key, idle_ms, alpha, prior), "n bigint, hits bigint, rate double", ledger, "0 seconds")


def rolling_context_stream(cells: DataFrame, venue: str, depth: int = 5, ledger: DataFrame | None = None, idle_ms: int | None = None) -> DataFrame:
    """Per race window of a venue: n and hits of the `depth` windows before it. State: the last `depth` windows. `ledger`
    (venue, window_start, n, hits) gives windows from before the stream's first run."""
    return with_state(cells, venue, LastWindows(venue, idle_ms, depth), "prev_n bigint, prev_hits bigint, prev_windows bigint", ledger, "0 seconds")


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a file stream, event time as a timestamp."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return events_of(spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet"))


def events_of(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "event_id AS race_id", "user_id AS entity", "CAST(ts AS TIMESTAMP) AS ts", "CAST(event_type = 'purchase' AS BIGINT) AS hit",
        "CAST(floor(CASE WHEN event_type = 'purchase' THEN value * 100.0D ELSE 0.0D END) AS BIGINT) AS payout",
        "element_at(array('A', 'B', 'C', 'D', 'E', 'X'), CAST(user_id % 6 + 1 AS INT)) AS cond_key",
    )
