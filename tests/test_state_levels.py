"""The levelled state table: merges by turns, replays, readers in between, point reads."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from compare import spark_rows
from reelstate.operators import state
from reelstate.plans import standins
from reelstate.plans.states import FIELDS
from reelstate.sources import files, state_levels
from reelstate.sources.state_levels import Commit, Layout, merge_events, read_state, store_batch

SMALL = Layout(buckets=4, fan=2, levels=3, keep=2)


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return standins.task_events(spark, sf_dir).cache()


def add(events, table, batch, part, layout=SMALL, **options):
    store_batch(merge_events(events.filter(part), FIELDS), table, batch, FIELDS, layout=layout, **options)


def same(spark, table, events, **options):
    found = read_state(spark, table, FIELDS, **options).select("task_id", "last_seq", *FIELDS)
    want = state.merged_state(events, FIELDS).select("task_id", "last_seq", *FIELDS)
    assert spark_rows(found) == spark_rows(want)


def parts(table):
    """Live and dead parts: ``bucket, level, until``."""
    return [tuple(int(x.split("=")[1]) for x in p.relative_to(table).parts)
            for p in Path(table).glob("bucket=*/level=*/until=*")]


def test_every_batch_keeps_the_state_and_merges_few_buckets(spark, events, tmp_path):
    """Some batches come again: the state is right after each, and no batch writes more than it is due."""
    table = str(tmp_path / "state")
    for batch in range(12):
        before = set(parts(table))
        add(events, table, batch, F.col("seq") % 12 == batch)
        new = set(parts(table)) - before
        assert {until for _, _, until in new} == {batch}
        levels = {bucket: level for bucket, level, _ in new}
        due = SMALL.due(batch)
        assert all(levels[b] == due.get(b, 0) for b in levels)
        # the last level, which holds most rows, is written for one bucket at most
        assert sum(level == SMALL.levels for level in levels.values()) <= 1
        if batch in (4, 11):
            same(spark, table, events.filter(F.col("seq") % 12 <= batch))
        if batch == 7:
            add(events, table, 7, "true")   # comes again, with other rows: left out
    # live parts, and those merged in the last batches
    assert len(parts(table)) <= SMALL.buckets * (SMALL.fan * SMALL.levels + SMALL.keep)
    assert len(files.names(spark, f"{table}/_commits")) <= SMALL.keep + 1


def test_a_failed_batch_is_written_again(spark, events, tmp_path, monkeypatch):
    """Its parts are there, the marker is not: readers go on with the batch before."""
    table = str(tmp_path / "state")
    for batch in range(5):
        add(events, table, batch, F.col("seq") % 8 == batch)

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(files, "mark", lost)
        with pytest.raises(OSError):
            add(events, table, 5, F.col("seq") % 8 == 5)
    assert any(until == 5 for _, _, until in parts(table))
    same(spark, table, events.filter(F.col("seq") % 8 <= 4))
    for batch in (5, 6, 7):
        add(events, table, batch, F.col("seq") % 8 == batch)
    same(spark, table, events)


def test_a_reader_sees_one_batch_while_others_follow(spark, events, tmp_path):
    table = str(tmp_path / "state")
    for batch in range(6):
        add(events, table, batch, F.col("seq") % 8 == batch)
    reader = read_state(spark, table, FIELDS).select("task_id", "last_seq", *FIELDS)
    for batch in (6, 7):
        add(events, table, batch, F.col("seq") % 8 == batch)
    want = state.merged_state(events.filter(F.col("seq") % 8 <= 5), FIELDS)
    assert spark_rows(reader) == spark_rows(want.select("task_id", "last_seq", *FIELDS))


def test_batches_without_rows_and_a_layout_that_stays(spark, events, tmp_path):
    table = str(tmp_path / "state")
    add(events, table, 0, "true")
    for batch in (3, 4, 9, 12):   # ids may leave gaps
        add(events, table, batch, "false", layout=Layout(buckets=7))
    same(spark, table, events)
    assert Commit.last(spark, table) == Commit(4, 12, SMALL)
    with pytest.raises(ValueError):
        read_state(spark, str(tmp_path / "none"), FIELDS)


def test_ended_rows_go(spark, tmp_path):
    """Rows that are dropped at the last level, where nothing older can hold their key."""
    table = str(tmp_path / "state")
    for batch in range(24):
        rows = spark.createDataFrame([(batch, batch, batch, batch % 10 == 0, batch)],
                                     "task_id LONG, last_seq LONG, open_seq LONG, open BOOLEAN, seq LONG")
        store_batch(rows.select("task_id", "open", "open_seq", "last_seq"), table, batch, ["open"],
                    layout=SMALL, drop="NOT open")
    found = {r.task_id: r.open for r in read_state(spark, table, ["open"]).collect()}
    assert {k for k, v in found.items() if v} == {0, 10, 20}
    assert len(found) < 17
    assert len(parts(table)) <= SMALL.buckets * (SMALL.fan * SMALL.levels + SMALL.keep)


def files_of(df):
    return {Path(f).parent.parent.parent.name for f in df.inputFiles()}


@pytest.mark.parametrize("many", [1, 6])
def test_point_reads(spark, events, tmp_path, many, monkeypatch):
    """The rows asked for are right, and only their buckets are read."""
    monkeypatch.setattr(state_levels, "POINTS", 2)  # fewer than the buckets
    table, layout = str(tmp_path / "state"), Layout(buckets=16, fan=4, levels=2, keep=2)
    for batch in range(3):
        add(events, table, batch, F.col("seq") % 3 == batch, layout=layout)
    asked = events.select("task_id").distinct().orderBy("task_id").limit(many)
    unknown = spark.createDataFrame([(None,), (-5,)], "task_id LONG")
    found = read_state(spark, table, FIELDS, asked=asked.unionByName(unknown)).join(asked, "task_id", "left_semi")
    want = state.merged_state(events.join(asked, "task_id", "left_semi"), FIELDS)
    columns = ["task_id", "last_seq", *FIELDS]
    assert spark_rows(found.select(*columns)) == spark_rows(want.select(*columns))
    buckets = {f"bucket={r[0]}" for r in asked.unionByName(unknown).where("task_id is not null").select(
        state_levels.bucket_of("task_id", layout)).collect()}
    assert len(buckets) < 16
    read = read_state(spark, table, FIELDS, asked=asked.unionByName(unknown))
    assert files_of(read) <= buckets
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert ("In(task_id" in plan or "EqualTo(task_id" in plan) == (many + 1 <= 2)


def test_keys_without_a_bucket(spark, events, tmp_path):
    table = str(tmp_path / "state")
    add(events, table, 0, "task_id = 1", layout=Layout(buckets=64))
    asked = spark.createDataFrame([(2,), (3,)], "task_id INT")
    assert read_state(spark, table, FIELDS, asked=asked).count() == 0
    asked = spark.createDataFrame([(1,)], "task_id INT")   # a key of another integer type
    assert read_state(spark, table, FIELDS, asked=asked).count() == 1
