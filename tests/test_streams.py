"""Streams: late rows, repeated runs, state across runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from formline.sources.snapshots import Overtaken, SnapshotTable, upsert_stream
from formline.streaming import ledger as T

SCHEMA = "race_id bigint, entity string, ts timestamp, hit bigint"
T0 = dt.datetime(2024, 1, 1, 12)


def feed(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).parquet(path)


def test_only_final_windows_come_out(spark, tmp_path):
    h = lambda n: T0 + dt.timedelta(hours=n)
    stream = feed(spark, str(tmp_path / "in"), [(1, "a", h(0), 1), (2, "a", h(1), 0), (3, "a", h(30), 1)])
    out = T.run_to_table(T.window_report(stream, "ts", ["entity"], "1 day", "1 hour", {"hits": F.col("hit")}), "w")
    assert [(r["n"], r["hits"]) for r in out.collect()] == [(2, 1)]


def test_rate_state_and_order(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    cells = [(day(3), "a", 2, 1), (day(1), "a", 4, 4), (day(2), "b", 1, 0)]
    path = str(tmp_path / "cells")
    schema = "window_start timestamp, entity string, n bigint, hits bigint"
    spark.createDataFrame(cells, schema).coalesce(1).write.parquet(path)
    out = T.run_to_table(T.running_rate_stream(spark.readStream.schema(schema).parquet(path), "entity", 2.0, 0.5), "r")
    got = {(r["entity"], r["window_start"].day): r["rate"] for r in out.collect()}
    assert got == {("a", 1): 0.5, ("a", 3): 5 / 6, ("b", 2): 0.5}


def test_context_keeps_five_windows(spark, tmp_path):
    cells = [(dt.datetime(2024, 1, 1, i), "v", 1, i) for i in range(8)]
    path = str(tmp_path / "cells")
    schema = "window_start timestamp, venue string, n bigint, hits bigint"
    spark.createDataFrame(cells, schema).coalesce(1).write.parquet(path)
    out = T.run_to_table(T.rolling_context_stream(spark.readStream.schema(schema).parquet(path), "venue"), "c")
    got = {r["window_start"].hour: (r["prev_windows"], r["prev_hits"]) for r in out.collect()}
    assert got[0] == (0, 0) and got[3] == (3, 3) and got[7] == (5, 20)


def test_duplicates_go(spark, tmp_path):
    stream = feed(spark, str(tmp_path / "in"), [(1, "a", T0, 1), (1, "a", T0, 1), (2, "a", T0, 0)])
    assert T.run_to_table(T.distinct_stream(stream, "ts", ["race_id"], "1 day"), "d").count() == 2


CELLS = "window_start timestamp, entity string, n bigint, hits bigint"
DAY = lambda n: dt.datetime(2024, 1, n)


def cells_of(spark, path, rows):
    spark.createDataFrame(rows, CELLS).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(CELLS).parquet(path)


def test_state_goes_on_after_a_failure_in_the_middle(spark, tmp_path):
    path, broken = str(tmp_path / "cells"), tmp_path / "broken"
    jobs = T.Jobs(spark, str(tmp_path / "jobs"))

    def shaky(batches):
        if broken.exists():
            raise RuntimeError("lost")
        yield from batches

    def run(rows):
        stream = cells_of(spark, path, rows) if rows else spark.readStream.schema(CELLS).parquet(path)
        return jobs.run(T.running_rate_stream(stream.mapInPandas(shaky, CELLS), "entity", 2.0, 0.5), "rates")

    run([(DAY(1), "a", 4, 4), (DAY(1), "b", 1, 0)])
    broken.touch()
    with pytest.raises(Exception, match="lost"):
        run([(DAY(2), "a", 2, 0)])
    broken.unlink()
    run([(DAY(3), "a", 1, 1), (DAY(3), "c", 1, 1)])
    got = sorted((r["entity"], r["window_start"].day, r["n"], r["rate"]) for r in run([]).collect())
    assert got == [("a", 1, 4, 0.5), ("a", 2, 2, 5 / 6), ("a", 3, 1, 5 / 8), ("b", 1, 1, 0.5), ("c", 3, 1, 0.5)]


def test_state_begins_with_the_ledger(spark, tmp_path):
    stream = cells_of(spark, str(tmp_path / "cells"), [(DAY(5), "a", 1, 1), (DAY(5), "b", 1, 1), (DAY(6), "a", 1, 0)])
    ledger = spark.createDataFrame([("a", 6, 3), ("a", 2, 1), ("x", 9, 9)], "entity string, n bigint, hits bigint")
    got = {(r["entity"], r["window_start"].day): r["rate"] for r in T.run_to_table(T.running_rate_stream(stream, "entity", 2.0, 0.5, ledger), "r").collect()}
    assert got == {("a", 5): 0.5, ("b", 5): 0.5, ("a", 6): 6 / 11}
    past = spark.createDataFrame([("a", DAY(i), 1, i) for i in range(1, 4)], "entity string, window_start timestamp, n bigint, hits bigint")
    got = {(r["entity"], r["window_start"].day): (r["prev_windows"], r["prev_hits"]) for r in T.run_to_table(T.rolling_context_stream(spark.readStream.schema(CELLS).parquet(str(tmp_path / "cells")), "entity", 2, past), "c").collect()}
    assert got == {("a", 5): (2, 5), ("b", 5): (0, 0), ("a", 6): (2, 4)}


def test_a_rest_ends_the_context(spark, tmp_path):
    path, day = str(tmp_path / "cells"), 86_400_000
    jobs = T.Jobs(spark, str(tmp_path / "jobs"))
    run = lambda rows: jobs.run(T.rolling_context_stream(cells_of(spark, path, rows), "entity", 5, idle_ms=3 * day), "c")
    run([(DAY(1), "a", 1, 1), (DAY(2), "a", 1, 1), (DAY(9), "b", 1, 1)])
    got = {(r["entity"], r["window_start"].day): r["prev_windows"] for r in run([(DAY(10), "a", 1, 1), (DAY(12), "b", 1, 1), (DAY(20), "b", 1, 1)]).collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("b", 9): 0, ("a", 10): 0, ("b", 12): 1, ("b", 20): 0}


ROW = "race_id bigint, day string, v bigint"


def content(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_a_crash_between_the_steps_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    table = SnapshotTable(spark, str(tmp_path / "t"), "day")
    rows = lambda xs: spark.createDataFrame(xs, ROW)
    table.replace(rows([(1, "a", 10), (2, "b", 20), (3, None, 30)]), ["race_id"], ["v"])
    moved = rows([(1, "b", 11), (2, "b", 19), (4, "c/d", 40)])
    commit = SnapshotTable.commit
    monkeypatch.setattr(SnapshotTable, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        table.replace(moved, ["race_id"], ["v"])
    assert content(table) == [(1, "a", 10), (2, "b", 20), (3, None, 30)]
    monkeypatch.setattr(SnapshotTable, "commit", commit)
    for _ in range(2):
        table.replace(moved, ["race_id"], ["v"])
        assert content(table) == [(1, "b", 11), (2, "b", 20), (3, None, 30), (4, "c/d", 40)]
    assert [tuple(r) for r in table.read(["c/d"]).collect()] == [(4, "c/d", 40)]
    assert table.expire(1) > 0 and len(content(table)) == 4


def test_of_two_writers_one_begins_again(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), "day")
    rows = lambda xs: spark.createDataFrame(xs, ROW)
    table.replace(rows([(1, "a", 1)]), ["race_id"])
    stale = table.replaced(table.manifest(), rows([(2, "a", 2)]), ["race_id"], [], None)
    table.replace(rows([(3, "a", 3)]), ["race_id"])
    with pytest.raises(Overtaken):
        table.commit(stale)
    assert content(table) == [(1, "a", 1), (3, "a", 3)]
    assert table.replace(rows([(4, "b", 4)]), ["race_id"], batch=("s", 3)) and not table.replace(rows([(5, "b", 5)]), ["race_id"], batch=("s", 3))
    assert content(table) == [(1, "a", 1), (3, "a", 3), (4, "b", 4)]


@pytest.mark.parametrize("after", [False, True])
def test_a_batch_sent_again_is_applied_once(spark, tmp_path, after):
    """The stream fails before or after its batch was committed, but before Spark notes that."""
    table = SnapshotTable(spark, str(tmp_path / "t"), "day")
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    spark.createDataFrame([(1, "a", 1), (2, "a", 2)], ROW).write.parquet(path)
    stream = lambda: spark.readStream.schema(ROW).parquet(path)

    def lost(number):
        if after:
            table.replace(spark.read.parquet(path), ["race_id"], (), ("s", number))
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        upsert_stream(stream(), table, ["race_id"], "s", checkpoint, fail=lost)
    assert table.manifest().version == int(after)
    upsert_stream(stream(), table, ["race_id"], "s", checkpoint)
    assert content(table) == [(1, "a", 1), (2, "a", 2)] and table.manifest().version == 1
    upsert_stream(stream(), table, ["race_id"], "s", checkpoint)
    assert table.manifest().version == 1
