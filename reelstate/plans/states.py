"""State queries: latest values, merges, history, attempts, progress."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstate.operators import lookup, records, results, selection, state
from reelstate.plans import sql, standins
from reelstate.plans.catalog import query
from reelstate.schemas import STATUSES, TASK_EVENTS, UPLOADING
from reelstate.session import scratch_path
from reelstate.sources import event_log, history, replies, result_store, state_levels
from reelstate.streaming import latest, progress

FIELDS = ["status", "progress", "message", "processed_video_url"]
ENUMS = {"status": STATUSES}


@query(sql.with_tables(
    "SELECT task_id, max(seq) AS last_seq, arg_max_null(status, seq) AS status, "
    "arg_max_null(progress, seq) AS progress FROM task_events GROUP BY task_id",
    sql.TASK_EVENTS,
))
def a1_latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = standins.task_events(spark, sf_dir)
    return state.latest_value(events, ["status", "progress"], enums=ENUMS)


@query(sql.with_tables(
    "SELECT task_id, seq, status, progress, message, processed_video_url FROM task_events "
    "QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) = 1",
    sql.TASK_EVENTS,
))
def a1_latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_row(standins.task_events(spark, sf_dir).drop("event_time"))


@query(sql.with_tables(sql.merged_state(), sql.TASK_EVENTS))
def a2_field_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.merged_state(standins.task_events(spark, sf_dir), FIELDS, enums=ENUMS)


@query(sql.with_tables(
    sql.merged_state(fields=("status", "progress")), sql.TASK_EVENTS,
))
def a2_status_and_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields a poller needs; numbers only, so the aggregate hashes."""
    events = standins.task_events(spark, sf_dir)
    return state.merged_state(events, ["status", "progress"], enums=ENUMS)


@query(sql.with_tables(
    """SELECT task_id, CAST(pos // 10000 AS BIGINT) AS part, count(*) AS n_detections,
         md5(string_agg("timestamp" || ' ' || horse_id || ' ' || person_name || ' '
           || confidence, '|' ORDER BY pos)) AS digest
       FROM detections GROUP BY ALL""",
    sql.DETECTIONS,
))
def a3_result_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembled documents, shown as size and digest of the ordered array."""
    parts = results.assemble_results(standins.detections(spark, sf_dir))
    line = F.transform("detections", lambda d: F.concat_ws(
        " ", d["timestamp"], d["horse_id"], d["person_name"], d["confidence"]
    ))
    return parts.select(
        "task_id", "part", F.size("detections").cast("long").alias("n_detections"),
        F.md5(F.array_join(line, "|")).alias("digest"),
    )


@query(sql.with_tables(
    """SELECT task_id, max_by(upload, (seq, upload)) FILTER (WHERE upload IS NOT NULL)
           AS upload_percent,
         max_by(progress, seq) FILTER (WHERE progress IS NOT NULL) AS processing_percent
       FROM (
         SELECT task_id, seq, NULL AS upload, progress FROM task_events
         UNION ALL
         SELECT l_orderkey, l_partkey, CAST(floor(l_linenumber * 100.0 / CASE
             WHEN round(l_tax * 100) = 0 THEN 1 ELSE round(l_tax * 100) END + 0.5) AS BIGINT), NULL
         FROM lineitem)
       GROUP BY task_id""",
    sql.TASK_EVENTS,
))
def a4_two_phase_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload percent from transfers, processing percent from the log."""
    moves = progress.percent_stream(standins.transfers(standins.table(spark, sf_dir, "lineitem")))
    moves = moves.withColumnRenamed("part_id", "seq")
    return state.phase_progress(moves, standins.task_events(spark, sf_dir))


def _completed(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Completion events of all tasks, their detections stored in parts of two; one in five has a version before."""
    parts = results.assemble_results(standins.detections(spark, sf_dir), part_size=2)
    done = []
    for version, (seq, some) in {1: (5, parts.where("task_id % 5 = 0 AND part = 0")), 2: (9, parts)}.items():
        manifest = result_store.write_results(some, path, version)
        named = manifest.withColumns({
            "filename": F.concat(F.lit("clip_"), F.col("task_id").cast("string"), F.lit(".mp4")),
            "duration": F.lit("00:30"), "resolution": F.lit("1920x1080"),
        })
        finished = F.lit("2026-03-06 14:00:00").cast("timestamp")
        events = records.completions(named, standins.PUBLIC_BASE, finished)
        done.append(events.withColumns({"seq": F.lit(seq).cast("long"), "event_time": finished}))
    return done[0].unionByName(done[1])


_SERVED = sql.with_tables(
    """SELECT task_id, CAST(200 AS INTEGER) AS code, pos, "timestamp", horse_id, person_name, confidence
       FROM detections
       UNION ALL
       SELECT NULL, CAST(404 AS INTEGER), NULL, NULL, NULL, NULL, NULL FROM orders
       WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    sql.DETECTIONS,
)


def _served(spark: SparkSession, sf_dir: str, current: DataFrame, path: str) -> DataFrame:
    """Every order's request answered in JSON from a state and the stored parts, and the replies flattened."""
    documents = result_store.served_documents(current, result_store.read_results(spark, path))
    answers = lookup.answer_documents(standins.requests(spark, sf_dir), documents, unique=True)
    sent = records.reply_documents(answers.withColumn("key", F.col("task_id").cast("string")),
                                   ["task_id", "status", "result"])
    out = scratch_path(spark, "result-replies")
    replies.write_replies(sent, out, "key")
    read = replies.read_replies(spark, out).select(
        F.col("data.task_id").cast("long").alias("task_id"), "code", "data.result")
    return results.flatten_results(read, ["task_id", "code"], keep_empty=True)


@query(_SERVED)
def a3_result_through_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in up to four parts: stored, merged into state, served in replies, flattened again."""
    path = scratch_path(spark, "results")
    merged = state.merged_state(_completed(spark, sf_dir, path), ["status", "result"])
    return _served(spark, sf_dir, merged.drop("last_seq"), path)


@query(_SERVED)
def a3_result_through_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the event log, a stream from it, and the state table that the stream keeps."""
    path, log, table = (scratch_path(spark, name) for name in ("results", "result-log", "result-state"))
    done = _completed(spark, sf_dir, path).withColumn("task_id", F.col("task_id").cast("string"))
    missing = {f.name: F.lit(None).cast(f.dataType) for f in TASK_EVENTS if f.name not in done.columns}
    event_log.append_events(done.withColumns(missing), log)
    latest.upsert_stream(
        event_log.stream_events(spark, log), table, scratch_path(spark, "result-checkpoint"),
        ["status", "result"], trigger={"availableNow": True},
    ).awaitTermination()
    current = state_levels.read_state(spark, table, ["status", "result"])
    return _served(spark, sf_dir, current.select(
        F.col("task_id").cast("long").alias("task_id"), "status", "result"), path)


def _carried(field: str) -> str:
    return (f"last_value({field} IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY seq "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {field}")


@query(sql.with_tables(
    f"SELECT task_id, seq, {', '.join(_carried(field) for field in FIELDS)} FROM task_events",
    sql.TASK_EVENTS,
))
def w1_state_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = standins.task_events(spark, sf_dir).drop("event_time")
    return state.state_history(events, FIELDS)


_ATTEMPTS = """
attempts AS (
  SELECT task_id, seq, status, progress, message, processed_video_url,
    CAST(sum(CASE WHEN status = 'uploading' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id
      ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS attempt
  FROM task_events
)"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = standins.task_events(spark, sf_dir).drop("event_time")
    return state.number_attempts(events, F.col("status") == UPLOADING)


@query(sql.with_tables(
    "SELECT task_id, seq, status, attempt FROM attempts", sql.TASK_EVENTS, _ATTEMPTS,
))
def w2_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attempts(spark, sf_dir).select("task_id", "seq", "status", "attempt")


@query(sql.with_tables(
    sql.merged_state("attempts", "task_id, attempt"), sql.TASK_EVENTS, _ATTEMPTS,
))
def w2_attempt_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State per attempt: a late result stays on the attempt it belongs to."""
    return state.merged_state(
        _attempts(spark, sf_dir), FIELDS, keys=("task_id", "attempt"), enums=ENUMS
    )


@query(sql.with_tables(
    f"SELECT task_id, seq, {', '.join(_carried(field) for field in FIELDS)}, attempt FROM attempts",
    sql.TASK_EVENTS, _ATTEMPTS,
))
def w1_daily_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and attempts, three parts of the log one after the other, each from the snapshot of the one before."""
    events = standins.task_events(spark, sf_dir).drop("event_time")
    path, last = scratch_path(spark, "history"), events.agg(F.max("seq")).first()[0] or 0
    for day in range(3):
        part = events.where((F.col("seq") * 3 / (last + 1)).cast("int") == day)
        history.extend(part, path, day, FIELDS, F.col("status") == UPLOADING)
    return history.read_history(spark, path)


_LATE_ATTEMPTS = """
late AS (
  SELECT task_id, seq, status, progress,
    coalesce(CASE WHEN status = 'error' THEN 1 END, CAST(sum(CASE WHEN status = 'uploading'
      THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)) AS attempt
  FROM task_events
)"""


@query(sql.with_tables("SELECT * FROM late", sql.TASK_EVENTS, _LATE_ATTEMPTS))
def w2_late_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are stamped with the first attempt and stay there, whenever they arrive."""
    events = standins.task_events(spark, sf_dir).select("task_id", "seq", "status", "progress")
    stamped = events.withColumn("attempt", F.when(F.col("status") == "error", F.lit(1).cast("long")))
    return state.number_attempts(stamped, F.col("status") == UPLOADING)


@query("SELECT conv_id, turn, role FROM conversations "
       "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def l1_first_of_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = standins.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return selection.first_of_selection(files, "conv_id", "turn")


@query(sql.with_tables(
    "SELECT task_id, pos, \"timestamp\", horse_id FROM detections ORDER BY task_id, pos",
    sql.DETECTIONS,
))
def l2_display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = standins.detections(spark, sf_dir).select("task_id", "pos", "timestamp", "horse_id")
    return selection.in_display_order(flat)


@query("""
SELECT s_suppkey AS task_id, CAST(step AS INTEGER) AS progress,
  '正在进行 AI 识别... ' || step || '%' AS message
FROM supplier, range(0, 101, 10) AS steps(step)""")
def s_g1_step_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = standins.table(spark, sf_dir, "supplier")
    return records.step_grid(tasks.select(F.col("s_suppkey").alias("task_id")))


@query(sql.with_tables(
    """SELECT tasks.task_id, CAST(step AS INTEGER) AS progress
       FROM (SELECT DISTINCT task_id FROM task_events) AS tasks, range(0, 101, 10) AS steps(step)
       WHERE NOT EXISTS (SELECT 1 FROM task_events AS e
         WHERE e.task_id = tasks.task_id AND e.progress = step)""",
    sql.TASK_EVENTS,
))
def s_g1_missing_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.missing_steps(standins.task_events(spark, sf_dir))
