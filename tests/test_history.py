"""History extended day by day, against one run over the whole log."""

import pytest
from pyspark.sql import functions as F

from compare import spark_rows
from reelstate.operators import state
from reelstate.sources import history
from reelstate.sources.state_levels import Layout

FIELDS = ["status", "progress"]


def reset():
    return F.col("status") == "uploading"


SMALL = Layout(buckets=4, fan=2, levels=2, keep=1)


@pytest.fixture(scope="module")
def events(spark):
    rows = [(f"t{n * n % 11}", n, [None, "uploading", "processing", "completed"][n * 7 % 4], n if n % 3 else None)
            for n in range(400)]
    return spark.createDataFrame(rows, "task_id STRING, seq BIGINT, status STRING, progress INT").cache()


def whole(events):
    numbered = state.number_attempts(events, reset()).select("seq", "attempt")
    return state.state_history(events, FIELDS).join(numbered, "seq").select("task_id", "seq", *FIELDS, "attempt")


def found(spark, path):
    return history.read_history(spark, path).select("task_id", "seq", *FIELDS, "attempt")


@pytest.mark.parametrize("limit", [None, 10])
def test_days_equal_one_run(spark, events, tmp_path, limit):
    path = str(tmp_path)
    for day in range(4):
        part = events.where((F.col("seq") / 100).cast("int") == day)
        history.extend(part, path, day, FIELDS, reset(), layout=SMALL, limit=limit)
        if day == 2:  # again: left out
            history.extend(events, path, day, FIELDS, reset())
    assert spark_rows(found(spark, path)) == spark_rows(whole(events))
    assert history.read_late(spark, path).count() == 0


def test_a_failed_day_is_written_again(spark, events, tmp_path, monkeypatch):
    path = str(tmp_path)
    history.extend(events.where("seq < 200"), path, 0, FIELDS, reset())
    with monkeypatch.context() as broken:
        broken.setattr(history, "store_batch", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            history.extend(events.where("seq >= 200"), path, 1, FIELDS, reset())
    history.extend(events.where("seq >= 200"), path, 1, FIELDS, reset())
    assert spark_rows(found(spark, path)) == spark_rows(whole(events))


def test_late_events_are_set_aside(spark, events, tmp_path):
    path = str(tmp_path)
    history.extend(events.where("seq < 300 AND seq <> 150"), path, 0, FIELDS, reset())
    history.extend(events.where("seq >= 300 OR seq = 150"), path, 1, FIELDS, reset())
    assert [r.seq for r in history.read_late(spark, path).collect()] == [150]
    assert spark_rows(found(spark, path)) == spark_rows(whole(events.where("seq <> 150")))


def test_a_day_reads_its_own_tasks(spark, events, tmp_path):
    """The snapshot's buckets of other tasks are not opened."""
    path = str(tmp_path)
    history.extend(events.where("seq < 300"), path, 0, FIELDS, reset(), layout=Layout(buckets=64))
    read = history.read_state(spark, f"{path}/snapshot", [*FIELDS, history.RESETS],
                              asked=events.where("task_id = 't1'"))
    assert len({f.split("bucket=")[1].split("/")[0] for f in read.inputFiles()}) == 1
    history.extend(events.where("seq >= 300 AND task_id = 't1'"), path, 1, FIELDS, reset())
    want = whole(events.where("seq < 300 OR task_id = 't1'"))
    assert spark_rows(found(spark, path)) == spark_rows(want)
