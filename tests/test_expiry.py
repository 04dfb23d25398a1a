"""State that ends and starts again, and polls answered by event time."""

import datetime as dt
import random
import time
from types import SimpleNamespace

from pyspark.sql import functions as F

from compare import spark_rows
from reelstate.operators import lookup
from reelstate.session import scratch_path
from reelstate.sources.state_levels import read_state
from reelstate.streaming import eviction, expiry, latest, timeline

EVENTS = "task_id STRING, seq BIGINT, status STRING, progress INT"
FIELDS = ["status", "progress"]


def add(spark, path, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def publish(spark, path, table, first=0, initial=None, stay=None, trigger=None):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    running = expiry.expiring_state_stream(stream, FIELDS, initial=initial, stay=stay)
    return latest.publish_state(running, table, scratch_path(spark, "c"), FIELDS, first_batch=first,
                                trigger=trigger or {"availableNow": True})


def stored(spark, table):
    return {r.task_id: (r.status, r.progress, r.last_seq) for r in read_state(spark, table, FIELDS).collect()}


def until(done, seconds=60):
    end = time.time() + seconds
    while time.time() < end and not done():
        time.sleep(0.3)
    assert done()




def test_finished_tasks_leave_the_store_and_late_events_count(spark):
    """A task ends, its record goes, and a late event still finds its place in the table."""
    path, table = scratch_path(spark, "in"), scratch_path(spark, "state")
    add(spark, path, [("a", 1, "uploading", 0), ("a", 5, "completed", 100), ("b", 2, "processing", 10)])
    with eviction.rocksdb_store(spark):
        query = publish(spark, path, table, stay=200, trigger={"processingTime": "300 milliseconds"})
        try:
            until(lambda: any(p["stateOperators"] and p["stateOperators"][0]["numRowsRemoved"] > 0
                              for p in query.recentProgress))
            assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 2
            add(spark, path, [("a", 3, "processing", 40), ("b", 4, None, 20)])
            until(lambda: sum(p["numInputRows"] for p in query.recentProgress) >= 5)
            until(lambda: stored(spark, table).get("b") == ("processing", 20, 4))
        finally:
            query.stop()
    assert stored(spark, table) == {"a": ("completed", 100, 5), "b": ("processing", 20, 4)}


def test_a_new_start_takes_active_tasks_from_the_table(spark):
    first, second, table = (scratch_path(spark, name) for name in ("one", "two", "state"))
    add(spark, first, [("a", 1, "processing", 10), ("b", 2, "completed", 100), ("c", 3, "uploading", 0)])
    add(spark, second, [("a", 4, None, 30), ("b", 1, "processing", 50), ("d", 9, "idle", None), ("a", 2, "error", None)])
    with eviction.rocksdb_store(spark):
        publish(spark, first, table).awaitTermination()
        known = read_state(spark, table, FIELDS)
        query = publish(spark, second, table, first=100, initial=known)
        query.awaitTermination()
    # of the stored tasks the two active ones are taken up; d is new, b comes again with its late event
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 4
    assert stored(spark, table) == {"a": ("error", 30, 4), "b": ("completed", 100, 2), "c": ("uploading", 0, 3),
                                    "d": ("idle", None, 9)}


def test_polls_on_a_stream_equal_the_batch_form(spark):
    """Rows out of order by up to a minute, over ten files of each side."""
    dice, start = random.Random(4), dt.datetime(2026, 3, 1)
    log = "task_id STRING, event_time TIMESTAMP, seq BIGINT, status STRING, progress INT"
    ask = "task_id STRING, event_time TIMESTAMP, request_id BIGINT"

    def moment(n):
        return start + dt.timedelta(seconds=n, milliseconds=dice.randrange(3))

    events = [(dice.choice("abc"), moment(n // 2), n, dice.choice(["uploading", "processing", None]),
               dice.choice([None, n])) for n in range(300)]
    polls = [(dice.choice("abcd"), moment(n), n) for n in range(150)]
    folders = {name: scratch_path(spark, name) for name in ("polls", "log")}
    far = start + dt.timedelta(days=1)
    for name, rows, schema, end in (("polls", polls, ask, (None, far, None)),
                                    ("log", events, log, (None, far, None, None, None))):
        for part in range(6):
            some = rows[part * len(rows) // 6:(part + 1) * len(rows) // 6]
            add(spark, folders[name], dice.sample(some, len(some)), schema)
        add(spark, folders[name], [end], schema)
    streams = [spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folders[name])
               for name, schema in (("polls", ask), ("log", log))]
    answers = timeline.as_of_stream(*streams, FIELDS, delay="60 seconds")
    out = scratch_path(spark, "out")
    with eviction.rocksdb_store(spark):
        query = answers.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", scratch_path(spark, "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.parquet(out).where("task_id IS NOT NULL")
    frames = [spark.createDataFrame(rows, schema).withColumn("at", F.unix_micros("event_time")).drop("event_time")
              for rows, schema in ((polls, ask), (events, log))]
    want = lookup.state_as_of(*frames, FIELDS)
    columns = ["task_id", "request_id", *FIELDS]
    assert spark_rows(found.select(columns)) == spark_rows(want.select(columns))
    # answered as the watermark goes, and what is held stays far below all rows
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len([p for p in query.recentProgress if p["stateOperators"] and p["sink"]["numOutputRows"]]) > 2
    assert sizes[-1] < 100, sizes


class Store:
    """Stands in for a task's state and timers, and counts the calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self._state(get=lambda: self.value, update=lambda row: setattr(self, "value", row),
                           exists=lambda: self.value is not None)

    def getListState(self, name, schema):
        held = []
        return self._state(get=lambda: iter(list(held)), exists=lambda: bool(held), appendValue=held.append,
                           appendList=held.extend, put=lambda rows: held.__setitem__(slice(None), rows), clear=held.clear)

    def _state(self, **calls):
        return SimpleNamespace(**{name: self._counted(call) for name, call in calls.items()})

    def _counted(self, call):
        def counted(*values):
            self.calls += 1
            return call(*values)
        return counted

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))

    def pass_by(self, processor, watermark):
        """What a watermark, in milliseconds, brings."""
        times, found = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), []
        for at in sorted(at for at in self.timers if at <= watermark):
            expired = SimpleNamespace(getExpiryTimeInMs=lambda: at)
            found += processor.handleExpiredTimer(("a",), times, expired)
            self.timers.discard(at)
        return [(row["_at"], row["_id"], row["status"]) for row in found]


def test_a_task_is_folded_once_for_all_rows_that_the_watermark_passes():
    """The calls to the state's store do not grow with the rows of a task, and some rows stay for the next watermark."""
    store = Store()
    processor = timeline.AnswerAsOf(["status"], ["string"], "bigint")
    processor.init(store)
    rows = [{"_at": n * 1_000_000, "_is_poll": n % 4 == 3, "_id": n, "_seq": n, "status": None if n % 4 == 1 else f"s{n}"}
            for n in range(4_000)]
    for some in (rows[1::2], rows[::2]):
        list(processor.handleInputRows(("a",), iter(some), None))
    first, last = store.pass_by(processor, 2_002_000), store.pass_by(processor, 5_000_000)
    assert first + last == [(n * 1_000_000, n, f"s{n - 1}") for n in range(3, 4_000, 4)]
    assert first[-1][1] == 1_999 and not store.timers
    assert store.calls < 40
