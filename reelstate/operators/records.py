"""Task records: birth, progress, completion and what a client is served."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelstate import schemas as S
from reelstate.functions import documents, progress, status, text


def initial_records(uploads: DataFrame, upload_folder: str) -> DataFrame:
    """The record of a task at birth, from ``task_id`` and ``filename``."""
    name = text.storage_name(F.col("task_id"), F.col("filename"))
    return uploads.select(
        "task_id",
        F.lit(S.UPLOADING).alias("status"),
        F.lit(0).alias("progress"),
        F.lit(S.RECEIVED_MESSAGE).alias("message"),
        text.in_folder(upload_folder, name).alias("file_path"),
    )


def creation_events(manifest: DataFrame) -> DataFrame:
    """The first log event of each landed upload, as rows of ``TASK_EVENTS``.

    Files whose names hold no task id are no uploads.
    """
    known = {
        "task_id": F.col("task_id"), "seq": F.lit(0), "event_time": F.col("modificationTime"),
        "status": F.lit(S.UPLOADING), "progress": F.lit(0), "message": F.lit(S.RECEIVED_MESSAGE),
        "file_path": F.col("path"),
    }
    return manifest.filter("task_id IS NOT NULL").select(*[
        known.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
        for field in S.TASK_EVENTS
    ])


def accepted_replies(uploads: DataFrame) -> DataFrame:
    """The reply to each accepted upload."""
    reply = documents.envelope(
        F.lit(S.OK_CODE), F.lit(S.ACCEPTED_MESSAGE), F.struct("task_id")
    )
    return uploads.select("task_id", reply.alias("reply"))


def step_grid(tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """Every progress step a task should report, with its message."""
    grid = tasks.select(key, F.explode(progress.expected_steps()).alias("progress"))
    return grid.withColumn("message", text.progress_message(F.col("progress")))


def missing_steps(events: DataFrame, key: str = "task_id") -> DataFrame:
    """Steps that a task never reported.

    The reported steps of a task become one array of at most 11 values, so the gaps come
    from an array difference and need no join.
    """
    on_grid = F.array_contains(progress.expected_steps(), F.col("progress"))
    seen = events.groupBy(key).agg(
        F.collect_set(F.when(on_grid, F.col("progress"))).alias("_seen")
    )
    gaps = F.array_except(progress.expected_steps(), F.col("_seen"))
    return seen.select(key, F.explode(gaps).alias("progress"))


def completions(tasks: DataFrame, public_base: str, finished_at: Column) -> DataFrame:
    """Completion events, one for each task: URL and result in one row, so no reader sees half of them.

    ``tasks`` carries ``task_id``, ``filename``, ``duration`` and ``resolution``, and the result's ``detections`` or,
    for detections that are stored beside the log, their ``version``, ``parts`` and ``total``. Appended after
    its parts are written, the event makes them the task's result at once. The message is left untouched.
    """
    name = text.processed_name(F.col("task_id"), F.col("filename"))
    stored = "version" in tasks.columns
    numbers = {n: F.col(n) for n in ("version", "parts", "total")} if stored else {}
    none = F.lit(None).cast(S.RESULT["detections"].dataType)
    result = documents.result(
        F.col("filename"), F.col("duration"), F.col("resolution"), text.completion_text(finished_at),
        none if stored else F.col("detections"), **numbers,
    )
    return tasks.select(
        "task_id",
        F.lit(S.COMPLETED).alias("status"),
        F.lit(S.PROGRESS_LAST).alias("progress"),
        text.public_url(public_base, name).alias("processed_video_url"),
        result.alias("result"),
    )


def served_records(state: DataFrame, with_path: bool = False) -> DataFrame:
    """The record as clients get it; the storage path only on request."""
    hidden = {"last_seq", "updated_at"} | (set() if with_path else {"file_path"})
    return state.select(*[name for name in state.columns if name not in hidden])


def reply_documents(answers: DataFrame, fields: list[str]) -> DataFrame:
    """Answered requests as reply structs; an unknown task has no ``data``."""
    data = F.when(F.col("code") == S.OK_CODE, F.struct(*fields))
    reply = documents.envelope(F.col("code"), F.col("reply_message"), data)
    kept = [name for name in answers.columns if name not in {*fields, "code", "reply_message"}]
    return answers.select(*kept, reply.alias("reply"))


def ui_columns(state: DataFrame) -> DataFrame:
    """All display values of a task: ``status``, ``filename``, ``processed_video_url``."""
    value = F.col("status")
    return state.withColumns({
        "label": status.status_label(value),
        "may_start": status.may_start(F.col("filename"), value),
        "action": status.next_action(value),
        "caption": status.action_caption(value),
        "pane": status.result_pane(value),
        "loading_text": status.loading_text(value),
        "has_output": status.has_output(F.col("processed_video_url")),
        "view_mode": status.view_mode(value),
        "display_name": status.display_name(status.view_mode(value), F.col("filename")),
    })
