import json

import pytest
from pyspark.sql import functions as F

from reelstate import schemas as S
from reelstate.operators import lookup, records, selection
from reelstate.session import scratch_root
from reelstate.sources import event_log, landing, replies
from reelstate.sources.state_table import write_state_table

ID = "123e4567-e89b-42d3-a456-42661417400"
FILES = {
    f"{ID}0_a_b.mp4": 3, f"{ID}1_clip.MOV": 7, f"{ID}3_empty.mp4": 0, f"{ID}2_notes.txt": 5,
    "stray.avi": 1,
}


@pytest.fixture
def landing_folder(tmp_path):
    for name, size in FILES.items():
        (tmp_path / name).write_bytes(b"x" * size)
    return str(tmp_path)


def test_manifest(spark, landing_folder):
    """All but empty files, which no Spark file source lists."""
    manifest = landing.read_landing(spark, landing_folder)
    assert manifest.columns == S.UPLOAD_MANIFEST.names
    found = {(r.task_id, r.filename, r.length) for r in manifest.collect()}
    assert found == {(f"{ID}0", "a_b.mp4", 3), (f"{ID}1", "clip.MOV", 7),
                     (f"{ID}2", "notes.txt", 5), (None, "stray.avi", 1)}


def test_manifest_reads_no_content(spark, landing_folder):
    plan = landing.read_landing(spark, landing_folder)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan


def test_media_files(spark, landing_folder):
    manifest = landing.only_media(landing.read_landing(spark, landing_folder))
    assert {r.filename for r in manifest.collect()} == {"a_b.mp4", "clip.MOV", "stray.avi"}
    globbed = landing.read_landing(spark, landing_folder, glob="*.{mp4,avi,mov}")
    assert {r.filename for r in globbed.collect()} == {"a_b.mp4", "stray.avi"}


def some_events(spark, *rows):
    events = spark.createDataFrame(
        rows, "task_id STRING, seq BIGINT, event_time TIMESTAMP_NTZ, status STRING")
    missing = {f.name: F.lit(None).cast(f.dataType)
               for f in S.TASK_EVENTS if f.name not in events.columns}
    return events.withColumn("event_time", F.col("event_time").cast("timestamp")).withColumns(missing)


def test_log_appends_and_prunes_days(spark, tmp_path):
    import datetime as dt

    path = str(tmp_path / "log")
    first, second = dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 1)
    event_log.append_events(some_events(spark, ("a", 0, first, "uploading")), path)
    event_log.append_events(some_events(spark, ("a", 1, second, None)), path)
    assert event_log.read_events(spark, path).count() == 2
    one_day = event_log.read_events(spark, path, days=("2024-01-02", "2024-01-05"))
    assert [r.seq for r in one_day.collect()] == [1]
    assert "PartitionFilters: [isnotnull(event_date" in (
        one_day._jdf.queryExecution().executedPlan().toString())


def test_reading_the_log_leaves_the_schema_as_it_is(spark, tmp_path):
    """The schema is shared by every reader and writer of the process."""
    import datetime as dt

    path, before = str(tmp_path / "log"), S.TASK_EVENTS.names[:]
    event_log.append_events(some_events(spark, ("a", 0, dt.datetime(2024, 1, 1), "uploading")), path)
    for _ in range(2):
        assert event_log.read_events(spark, path).count() == 1
        event_log.stream_events(spark, path)
    assert S.TASK_EVENTS.names == before and len(S.TASK_EVENTS.fields) == len(before)


def test_log_refuses_unknown_status(spark, tmp_path):
    import datetime as dt

    events = some_events(spark, ("a", 0, dt.datetime(2024, 1, 1), "paused"))
    with pytest.raises(Exception, match="paused"):
        event_log.append_events(events, str(tmp_path / "log"))


def test_replies_survive_malformed_text(spark, tmp_path):
    good = json.dumps({"code": 200, "data": {"status": "processing", "progress": 45}})
    (tmp_path / "r.json").write_text(f"{good}\nnot json\n", encoding="utf-8")
    rows = replies.read_replies(spark, str(tmp_path)).collect()
    assert sorted((r.code or 0, r.data.progress if r.data else None) for r in rows) == [
        (0, None), (200, 45)]
    texts = spark.createDataFrame([(1, good), (2, "{")], "id INT, value STRING")
    parsed = {r.id: r for r in replies.parse_replies(texts).collect()}
    assert parsed[1].data.progress == 45
    assert parsed[2].code is None


def test_reply_messages_have_key_and_value(spark):
    upload = spark.createDataFrame([("t1", "a.mp4")], "task_id STRING, filename STRING")
    row = replies.reply_messages(records.accepted_replies(upload)).first()
    assert (row.key, json.loads(row.value)["data"]) == ("t1", {"task_id": "t1"})


def test_replies_take_little_room(spark, tmp_path):
    """Files of replies hold a fraction of the text, and read back as the same lines."""
    uploads = spark.range(20_000).selectExpr("CAST(id AS STRING) AS task_id")
    sent = records.accepted_replies(uploads)
    lines = [r.value for r in replies.reply_messages(sent).collect()]
    path = tmp_path / "replies"
    replies.write_replies(sent, str(path))
    taken = sum(f.stat().st_size for f in path.iterdir() if f.name.startswith("part-"))
    assert taken < sum(len(line.encode()) + 1 for line in lines) / 5
    assert sorted(r.value for r in spark.read.text(str(path)).collect()) == sorted(lines)
    assert replies.read_replies(spark, str(path)).where("code = 200").select("data.task_id").distinct().count() == 20_000
    replies.write_replies(sent.limit(3), str(tmp_path / "plain"), compression="none")
    assert sum(len(f.read_text(encoding="utf-8").splitlines()) for f in (tmp_path / "plain").glob("part-*.txt")) == 3


def test_missing_steps(spark):
    rows = [("a", p) for p in (0, 10, 20, 45, 100)] + [("b", None)]
    gaps = records.missing_steps(spark.createDataFrame(rows, "task_id STRING, progress INT"))
    found = gaps.groupBy("task_id").agg(F.sort_array(F.collect_list("progress")).alias("p"))
    assert {r.task_id: r.p for r in found.collect()} == {
        "a": [30, 40, 50, 60, 70, 80, 90], "b": list(range(0, 101, 10))}


def test_first_of_selection(spark):
    rows = [("s", 1, "b"), ("s", 0, "a"), ("t", 4, "c")]
    files = spark.createDataFrame(rows, "sel STRING, pos INT, name STRING")
    first = selection.first_of_selection(files, "sel", "pos")
    assert {(r.sel, r.name) for r in first.collect()} == {("s", "a"), ("t", "c")}


class FakeSession:
    def __init__(self, master, **settings):
        self.conf, self.sparkContext, self.master = settings, self, master


def test_scratch_follows_the_setting():
    shared = {"spark.checkpoint.dir": "/shared/folder/"}
    assert scratch_root(FakeSession("yarn", **shared)) == "/shared/folder"
    assert scratch_root(FakeSession("local[2]", **shared)) == "/shared/folder"
    assert scratch_root(FakeSession("local[2]")) == scratch_root(FakeSession("local"))
    with pytest.raises(ValueError, match="share"):
        scratch_root(FakeSession("yarn"))


def test_lookup_leaves_a_bucketed_state_table_in_place(spark, tmp_path):
    state = spark.range(1000).selectExpr("id AS task_id", "'completed' AS status")
    write_state_table(state, "stored_state", 8, path=str(tmp_path / "state"))
    requests = spark.range(500, 1500).selectExpr("id AS request_id", "id AS task_id")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        answers = lookup.answer(requests, spark.table("stored_state"), unique=True)
        plan = answers._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert answers.filter("code = 200").count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        spark.sql("DROP TABLE stored_state")
