"""Days of the log compacted while others read and write."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reelstate import schemas as S
from reelstate.sources import compaction, event_log, files

DAYS = [dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 2, 12)]


def add(spark, path, batch, days=(0, 1)):
    rows = [(f"t{batch}", n, DAYS[n], "uploading") for n in days]
    events = spark.createDataFrame(rows, "task_id STRING, seq BIGINT, event_time TIMESTAMP, status STRING")
    missing = {f.name: F.lit(None).cast(f.dataType) for f in S.TASK_EVENTS if f.name not in events.columns}
    event_log.append_events(events.withColumns(missing), path, batch=f"b{batch}")


def rows(log):
    return sorted((r.task_id, r.seq) for r in log.select("task_id", "seq").collect())


def wanted(batches, days=(0, 1)):
    return sorted((f"t{b}", n) for b in batches for n in days)


def folders(path, day):
    return sorted(p.name.removeprefix("event_batch=") for p in (path / f"event_date=2024-01-0{day + 1}").iterdir()
                  if p.name.startswith("event_batch="))


def test_readers_lose_and_double_nothing(spark, tmp_path):
    """A reader before, one between write and switch, appends meanwhile, and one after."""
    path = str(tmp_path / "log")
    for n in range(3):
        add(spark, path, n)
    add(spark, path, 3, days=(1,))
    before = event_log.read_events(spark, path)
    assert event_log.compact_days(spark, path, most=3) == ["2024-01-02"]
    assert rows(before) == wanted(range(3)) + [("t3", 1)]
    assert rows(event_log.read_events(spark, path)) == wanted(range(3)) + [("t3", 1)]
    assert folders(tmp_path / "log", 1) == ["b0", "b1", "b2", "b3", "compact-000000000001"]
    add(spark, path, 4)
    assert event_log.compact_days(spark, path, most=1) == ["2024-01-01", "2024-01-02"]
    assert rows(event_log.read_events(spark, path)) == sorted(wanted([0, 1, 2, 4]) + [("t3", 1)])
    assert rows(event_log.read_events(spark, path, days=("2024-01-01", "2024-01-01"))) == wanted([0, 1, 2, 4], [0])
    assert event_log.compact_days(spark, path, most=1) == []


def test_a_failed_compaction_counts_for_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    for n in range(2):
        add(spark, path, n)

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(files, "write_text", lost)
        with pytest.raises(OSError):
            event_log.compact_days(spark, path, most=1)
    assert "compact-000000000001" in folders(tmp_path / "log", 0)
    assert rows(event_log.read_events(spark, path)) == wanted(range(2))
    add(spark, path, 2)
    event_log.compact_days(spark, path, most=1)
    assert rows(event_log.read_events(spark, path)) == wanted(range(3))


def test_replaced_batches_go_in_time(spark, tmp_path):
    """The number of folders of a day stays bounded, and so does what the marker names."""
    path = str(tmp_path / "log")
    add(spark, path, 0)
    for n in range(1, 7):
        add(spark, path, n)
        event_log.compact_days(spark, path, most=1, keep=2)
        assert rows(event_log.read_events(spark, path)) == wanted(range(n + 1))
        assert len(folders(tmp_path / "log", 0)) <= 2 * 2 + 1
    assert len(compaction._state(spark, path)["replaced"]) <= 2 * 2 * 2
    assert len(files.names(spark, f"{path}/_compactions")) <= 2


def test_a_stream_reads_each_event_once(spark, tmp_path):
    path, out, checkpoint = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "c")
    for n in range(2):
        for m in range(2):
            add(spark, path, 2 * n + m)
        event_log.stream_events(spark, path).select("task_id", "seq").writeStream.format("parquet").option(
            "path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        event_log.compact_days(spark, path, most=1)
    assert rows(spark.read.parquet(out)) == wanted(range(4))
