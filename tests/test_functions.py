from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reelstate.functions import parsing, progress, status, text

ID = "123e4567-e89b-42d3-a456-426614174000"


@pytest.fixture
def evaluate(spark):
    one = spark.range(1)
    return lambda *columns: tuple(one.select(*columns).first())


@pytest.mark.parametrize("loaded, total, percent", [
    (8, None, 800), (8, 0, 800), (1, 8, 13), (1, 3, 33), (5, 5, 100), (0, 7, 0), (None, 5, None),
])
def test_transfer_percent(evaluate, loaded, total, percent):
    columns = F.lit(loaded).cast("long"), F.lit(total).cast("long")
    assert evaluate(progress.transfer_percent(*columns)) == (percent,)


@pytest.mark.parametrize("raw, parts", [
    ("0.98_0.95", ("0.98", "0.95")), ("0.98", (None, None)), ("a_0.5", (None, "0.5")),
    ("0.985_100.0", ("0.985", "100.0")), ("1.123456789_12345", ("1.123456789", "12345")),
    ("", (None, None)), (None, (None, None)), ("1_2_3", (None, None)),
])
def test_confidence_parts(evaluate, raw, parts):
    found = evaluate(*parsing.confidence_parts(F.lit(raw).cast("string")))
    assert found == tuple(None if v is None else Decimal(v) for v in parts)


@pytest.mark.parametrize("raw, size", [
    ("1920x1080", (1920, 1080)), ("1920", (None, None)), ("wxh", (None, None)),
    (None, (None, None)), ("99999999999x1", (None, 1)),
])
def test_resolution_parts(evaluate, raw, size):
    assert evaluate(*parsing.resolution_parts(F.lit(raw).cast("string"))) == size


@pytest.mark.parametrize("raw, seconds", [
    ("00:05", 5), ("75:10", 4510), ("1:60", None), ("-1:05", None), ("00:00:05", None),
    ("five", None), (None, None), ("1000000:00", 60_000_000), ("9000000000:01", 540_000_000_001),
    ("9223372036854775807:00", None),
])
def test_media_seconds(evaluate, raw, seconds):
    assert evaluate(parsing.media_seconds(F.lit(raw).cast("string"))) == (seconds,)


@pytest.mark.parametrize("seconds, raw", [
    (0, "00:00"), (65, "01:05"), (6000, "100:00"), (600_000_000_001, "10000000000:01"), (None, None),
])
def test_media_offset_is_never_cut(evaluate, seconds, raw):
    assert evaluate(parsing.media_offset(F.lit(seconds).cast("long"))) == (raw,)


def test_media_interval_beyond_its_type(evaluate):
    assert evaluate(parsing.media_interval(F.lit("9000000000000000:00"))) == (None,)


def test_media_interval(evaluate):
    assert evaluate(parsing.media_interval(F.lit("01:30")))[0].total_seconds() == 90


@pytest.mark.parametrize("name, stored", [
    ("a_b.mp4", "a_b.mp4"), ("../../etc/x.mp4", "x.mp4"), (r"C:\clips\y.mp4", "y.mp4"),
])
def test_storage_names(evaluate, name, stored):
    built = text.storage_name(F.lit(ID), F.lit(name))
    assert evaluate(
        built, text.stored_task_id(built), text.stored_filename(built),
        text.processed_name(F.lit(ID), F.lit(name)),
    ) == (f"{ID}_{stored}", ID, stored, f"processed_{ID}_{stored}")


def test_foreign_file_name_has_no_task(evaluate):
    name = F.lit("notes.txt")
    assert evaluate(text.stored_task_id(name), text.stored_filename(name)) == (None, "notes.txt")


@pytest.mark.parametrize("url, task", [
    ("http://h/api/status?task_id=a%2Db", "a-b"), ("http://h/api/status", None),
    ("http://h/api/status?other=1&task_id=7", "7"), ("not a url", None), (None, None),
])
def test_query_parameter(evaluate, url, task):
    assert evaluate(text.query_parameter(F.lit(url).cast("string"))) == (task,)


def test_derived_ids_tell_parts_apart(evaluate):
    none = F.lit(None).cast("string")
    many = [("a", none, "b"), ("a", "b"), ("a|b",), ("a|1:b",), ("a", "-", "b"), (none,), ("",)]
    ids = evaluate(*[text.derived_task_id(*[F.lit(p) if isinstance(p, str) else p for p in parts])
                     for parts in many])
    assert len(set(ids)) == len(many)


def test_derived_id_is_stable(evaluate):
    first, second, other = evaluate(*[
        text.derived_task_id(F.lit("p"), F.lit(n)) for n in (1, 1, 2)
    ])
    assert first == second != other
    assert [len(part) for part in first.split("-")] == [8, 4, 4, 4, 12]


@pytest.mark.parametrize("value, label, pane, action, caption", [
    ("idle", "等待提交", "empty", "start", "开始上传处理"),
    ("uploading", "正在上传", "loading", "start", "正在执行 AI 分析..."),
    ("processing", "AI 处理中", "loading", "start", "正在执行 AI 分析..."),
    ("completed", "分析完成", "result", "reset", "上传新视频"),
    ("error", "任务失败", "loading", "start", "正在执行 AI 分析..."),
    ("paused", "未知状态", "loading", "start", "正在执行 AI 分析..."),
    (None, "未知状态", "loading", "start", "正在执行 AI 分析..."),
])
def test_status_views(evaluate, value, label, pane, action, caption):
    column = F.lit(value).cast("string")
    assert evaluate(
        status.status_label(column), status.result_pane(column), status.next_action(column),
        status.action_caption(column),
    ) == (label, pane, action, caption)


def test_start_and_output_flags(evaluate):
    none = F.lit(None).cast("string")
    assert evaluate(
        status.may_start(F.lit("a"), F.lit("idle")), status.may_start(none, F.lit("idle")),
        status.may_start(F.lit("a"), F.lit("error")), status.may_start(F.lit("a"), none),
        status.has_output(F.lit("u")), status.has_output(F.lit("")), status.has_output(none),
        status.is_active(F.lit("uploading")), status.is_active(F.lit("error")),
        status.is_active(none),
    ) == (True, False, False, False, True, False, False, True, False, False)


def test_outcomes(evaluate):
    none, keep, done = F.lit(None).cast("int"), F.lit("processing"), F.lit("completed")
    assert evaluate(
        *[status.status_after_upload(F.lit("uploading"), c) for c in (F.lit(200), F.lit(500), none)],
        *[status.status_after_poll(keep, c, done) for c in (F.lit(200), F.lit(404), none)],
    ) == ("uploading", "error", "error", "completed", "processing", "error")
