"""Streams over several micro-batches, against the batch operators."""

import time

import pytest
from pyspark.sql import functions as F

from compare import spark_rows
from reelstate.operators import state
from reelstate.plans import standins
from reelstate.plans.states import FIELDS
from reelstate.session import scratch_path
from reelstate.sources import event_log, landing, state_levels
from reelstate.streaming import eviction, latest, progress

DRAIN = {"availableNow": True}
BATCHES = 3


@pytest.fixture(scope="module")
def log(spark, sf_dir):
    """Given events as one file per third, out of order between the files."""
    events = standins.task_events(spark, sf_dir)
    path = scratch_path(spark, "log")
    for n in (1, 0, 2):
        part = events.filter(F.expr(f"pmod(xxhash64(seq), {BATCHES})") == n)
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(left, right):
    assert spark_rows(left) == spark_rows(right)


def merged(spark, log):
    return state.merged_state(spark.read.parquet(log), FIELDS).select("task_id", "last_seq", *FIELDS)


def folded(spark, table):
    return state_levels.read_state(spark, table, FIELDS).select("task_id", "last_seq", *FIELDS)


def test_state_store_and_upsert_agree_with_batch(spark, log):
    stored, upserted = scratch_path(spark, "stored"), scratch_path(spark, "upserted")
    running = latest.latest_state_stream(stream(spark, log), FIELDS)
    query = latest.publish_state(running, stored, scratch_path(spark, "c"), FIELDS, trigger=DRAIN)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == BATCHES
    latest.upsert_stream(
        stream(spark, log), upserted, scratch_path(spark, "c"), FIELDS, trigger=DRAIN
    ).awaitTermination()
    same(folded(spark, stored), merged(spark, log))
    same(folded(spark, upserted), merged(spark, log))


def follow(spark, path):
    table = scratch_path(spark, "followed")
    changes = eviction.follow_tasks(stream(spark, path), late_milliseconds=None)
    with eviction.rocksdb_store(spark):
        latest.publish_changes(changes, table, scratch_path(spark, "c"), trigger=DRAIN).awaitTermination()
    return newest_changes(spark, table)


def newest_changes(spark, table):
    rows = state_levels.read_state(spark, table, ["row"])
    return rows.select("task_id", F.col("last_seq").alias("seq"), "row.status", "row.followed")


def test_finished_tasks_leave(spark, sf_dir):
    """Batches in order of time: followed are exactly the tasks whose last event is active."""
    events = standins.task_events(spark, sf_dir).select("task_id", "seq", "status")
    path = scratch_path(spark, "ordered")
    for low in (0, 400, 800):
        part = events.filter(F.col("seq").between(low, low + 399))
        part.coalesce(1).write.mode("append").parquet(path)
    last = follow(spark, path)
    known = events.filter("status IS NOT NULL")
    expected = state.latest_row(known).filter("status IN ('processing', 'uploading')")
    same(last.filter("followed").select("task_id", "seq", "status"), expected)


def test_newest_row_per_arrow_batch(spark):
    rows = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "key STRING, seq BIGINT, status STRING"
    ).coalesce(1)
    kept = rows.mapInArrow(eviction.newest_per_batch, rows.schema)
    assert {tuple(r) for r in kept.collect()} == {("a", 3, "y"), ("b", 2, "z")}


def test_arrivals_come_once(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    folder.mkdir()
    for n in range(2):
        (folder / f"123e4567-e89b-42d3-a456-42661417400{n}_v.mp4").write_bytes(b"abc")
        arrivals = landing.stream_landing(spark, str(folder)).select("task_id", "filename", "length")
        progress.append_stream(arrivals, out, checkpoint).awaitTermination()
    found = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert sorted(found) == [
        (f"123e4567-e89b-42d3-a456-42661417400{n}", "v.mp4", 3) for n in range(2)]


def test_answers_see_the_state_table(spark, tmp_path):
    path = str(tmp_path / "requests")
    spark.createDataFrame([(1, 5), (2, 6)], "request_id INT, task_id INT").write.parquet(path)
    table, out = str(tmp_path / "state"), str(tmp_path / "out")

    def known(*rows):
        spark.createDataFrame(rows, "task_id INT, status STRING").write.mode("append").parquet(table)

    def found():
        progress.answer_stream(
            stream(spark, path), lambda batch: spark.read.parquet(table), out, str(tmp_path / "c"), limit=1
        ).awaitTermination()
        return {(r.request_id, r.code, r.status, r.reply_message)
                for r in progress.read_answers(spark, out).collect()}

    known((5, "completed"))
    first = {(1, 200, "completed", None), (2, 404, None, "任务不存在")}
    assert found() == first
    known((6, "uploading"))
    spark.createDataFrame([(3, 6)], "request_id INT, task_id INT").write.mode("append").parquet(path)
    assert found() == first | {(3, 200, "uploading", None)}


def test_event_log_as_a_stream(spark, sf_dir, tmp_path):
    events = standins.task_events(spark, sf_dir)
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    event_log.append_events(events, path)
    source = event_log.stream_events(spark, path, schema=events.schema)
    latest.upsert_stream(source, out, str(tmp_path / "c"), FIELDS, trigger=DRAIN).awaitTermination()
    expected = state.merged_state(events, FIELDS).select("task_id", "last_seq", *FIELDS)
    same(folded(spark, out), expected)


def test_tombstone_stops_a_late_event(spark):
    """The end of a task, then a straggler in the next batch."""
    path, table = scratch_path(spark, "late"), scratch_path(spark, "kept")
    schema = "task_id STRING, seq BIGINT, status STRING"
    for row in (("a", 5, "completed"), ("a", 3, "processing")):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # the file source goes by modification time
    changes = eviction.follow_tasks(stream(spark, path), late_milliseconds=600_000)
    with eviction.rocksdb_store(spark):
        query = latest.publish_changes(
            changes, table, scratch_path(spark, "c"), trigger={"processingTime": "1 second"})
    try:
        give_up = time.time() + 60
        while query.isActive and time.time() < give_up:
            if sum(p["numInputRows"] for p in query.recentProgress) >= 2:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    found = newest_changes(spark, table).collect()
    assert {(r.task_id, r.seq, r.followed) for r in found} == {("a", 5, False)}
