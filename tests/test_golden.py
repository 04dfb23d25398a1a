"""One task from upload to reply, against the documented records and replies."""

import json

import pytest
from pyspark.sql import functions as F

from reelstate import schemas as S
from reelstate.functions import documents
from reelstate.operators import lookup, records, results, state

ID = "123e4567-e89b-42d3-a456-426614174000"
DETECTIONS = [
    {"timestamp": "00:05", "horse_id": "H001", "person_name": "张三", "confidence": "0.98_0.95"},
    {"timestamp": "00:12", "horse_id": "H005", "person_name": "李四", "confidence": "0.92_0.88"},
    {"timestamp": "00:25", "horse_id": "H003", "person_name": "王五", "confidence": "0.95_0.91"},
]
FIELDS = list(S.STATE_FIELDS)


@pytest.fixture(scope="module")
def events(spark):
    """The 14 events of a task, made by the record operators."""
    upload = spark.createDataFrame([(ID, "a_b.mp4")], "task_id STRING, filename STRING")
    born = records.initial_records(upload, "/videos/upload").withColumn("seq", F.lit(0))
    started = upload.select("task_id", F.lit("processing").alias("status"), F.lit(1).alias("seq"))
    steps = records.step_grid(upload).withColumn("seq", (F.col("progress") / 10 + 2).cast("int"))
    rows = [(ID, n, d["timestamp"], d["horse_id"], d["person_name"], d["confidence"])
            for n, d in enumerate(DETECTIONS)]
    flat = spark.createDataFrame(
        rows[::-1], "task_id STRING, pos BIGINT, timestamp STRING, horse_id STRING, "
                    "person_name STRING, confidence STRING")
    finished = upload.join(results.assemble_results(flat), "task_id").withColumns(
        {"duration": F.lit("00:30"), "resolution": F.lit("1920x1080")})
    done = records.completions(
        finished, "http://localhost:8000/videos", F.lit("2026-03-06 14:00:00.9").cast("timestamp")
    ).withColumn("seq", F.lit(13))
    log = born
    for part in (started, steps, done):
        log = log.unionByName(part, allowMissingColumns=True)
    return log.orderBy(F.rand(3)).cache()


def state_of(events):
    return state.merged_state(events, FIELDS, enums={"status": S.STATUSES})


def reply_to(spark, events, task_id):
    requests = spark.createDataFrame([(1, task_id)], "request_id BIGINT, task_id STRING")
    served = records.served_records(state_of(events))
    answers = lookup.answer(requests, served)
    fields = ["status", "progress", "message", "processed_video_url", "result"]
    reply = records.reply_documents(answers, fields)
    return json.loads(reply.select(documents.compact_json(F.col("reply"))).first()[0])


def test_fourteen_events(events):
    assert events.count() == 14


def test_finished_task_keeps_its_last_message(spark, events):
    assert reply_to(spark, events, ID) == {
        "code": 200,
        "data": {
            "status": "completed",
            "progress": 100,
            "message": "正在进行 AI 识别... 100%",
            "processed_video_url": f"http://localhost:8000/videos/processed_{ID}_a_b.mp4",
            "result": {
                "filename": "a_b.mp4", "duration": "00:30", "resolution": "1920x1080",
                "processed_at": "2026-03-06 14:00:00", "detections": DETECTIONS,
            },
        },
    }


def test_running_task_has_no_result(spark, events):
    assert reply_to(spark, events.filter("seq <= 6"), ID) == {
        "code": 200,
        "data": {"status": "processing", "progress": 40, "message": "正在进行 AI 识别... 40%"},
    }


def test_unknown_task(spark, events):
    assert reply_to(spark, events, "nobody") == {"code": 404, "message": "任务不存在"}


def test_accepted_upload(spark):
    upload = spark.createDataFrame([(ID, "a.mp4")], "task_id STRING, filename STRING")
    reply = records.accepted_replies(upload).select(documents.compact_json(F.col("reply")))
    assert json.loads(reply.first()[0]) == {
        "code": 200, "message": "上传成功", "data": {"task_id": ID}}


def test_state_is_the_last_row_of_history(events):
    fields = ["status", "progress", "message", "file_path", "processed_video_url"]
    last = state.state_history(events, fields).filter("seq = 13").select(*fields).first()
    assert last == state.merged_state(events, fields).select(*fields).first()


def test_served_record_hides_the_path(events):
    assert "file_path" not in records.served_records(state_of(events)).columns
    assert "file_path" in records.served_records(state_of(events), with_path=True).columns


def test_reply_round_trip(spark, events):
    text = spark.createDataFrame([(json.dumps(reply_to(spark, events, ID)),)], "value STRING")
    parsed = text.select(documents.parse_reply(F.col("value")).alias("r")).first().r
    assert parsed.code == 200
    assert [d.asDict() for d in parsed.data.result.detections] == DETECTIONS


def test_pretty_json_parses_to_the_same_document(events):
    row = state_of(events).select(
        documents.compact_json(F.col("result")), documents.pretty_json(F.col("result"))
    ).first()
    assert json.loads(row[0]) == json.loads(row[1])
    assert '\n  "filename"' in row[1]


def test_progress_of_a_running_and_a_finished_task(spark, events):
    """Progress rows carry no status; the upload reports through its callbacks."""
    moves = spark.createDataFrame([(ID, 1, 50), (ID, 2, 100)], "task_id STRING, seq BIGINT, percent INT")
    for last, percent in ((6, 40), (13, 100)):
        row = state.phase_progress(moves, events.filter(F.col("seq") <= last)).first()
        assert (row.upload_percent, row.processing_percent) == (100, percent)


def test_late_result_stays_with_its_attempt(spark):
    """A second selection while the first runs; the first one's result arrives after it."""
    rows = [(1, "uploading", None), (2, "processing", None), (3, "uploading", None),
            (4, "completed", 1), (5, "processing", None)]
    log = spark.createDataFrame([(ID, *row) for row in rows],
                                "task_id STRING, seq BIGINT, status STRING, attempt BIGINT")
    found = state.number_attempts(log, F.col("status") == "uploading")
    assert {(r.seq, r.attempt) for r in found.collect()} == {(1, 1), (2, 1), (3, 2), (4, 1), (5, 2)}
    merged = state.merged_state(found, ["status"], keys=("task_id", "attempt"))
    assert {r.attempt: r.status for r in merged.collect()} == {1: "completed", 2: "processing"}
