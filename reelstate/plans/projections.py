"""Row-wise queries: no shuffle beyond what their input needs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstate import schemas as S
from reelstate.functions import status
from reelstate.operators import records, results
from reelstate.plans import sql, standins
from reelstate.plans.catalog import query

LABEL = " ".join(f"WHEN '{value}' THEN '{text}'" for value, text in S.STATUS_LABELS.items())
LABEL = f"CASE status {LABEL} ELSE '{S.UNKNOWN_STATUS_LABEL}' END"


@query(sql.with_tables(
    'SELECT task_id, pos, "timestamp", horse_id, person_name, confidence FROM detections',
    sql.DETECTIONS,
))
def p1_detection_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detection table of assembled documents (assembly, then flattening)."""
    documents = results.assemble_results(standins.detections(spark, sf_dir))
    return results.detection_table(results.flatten_results(documents, ["task_id"]))


def completed_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every upload with a finished result without detections."""
    uploads = standins.uploads(spark, sf_dir).withColumns({
        "duration": F.lit("00:30"), "resolution": F.lit("1920x1080"),
        "detections": F.array().cast(S.RESULT["detections"].dataType),
    })
    finished = F.timestamp_seconds(F.col("n_chars") + 1_772_805_600)
    return records.completions(uploads, standins.PUBLIC_BASE, finished)


_FINISHED = "strftime(to_timestamp(n_chars + 1772805600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"


@query(sql.with_tables(
    f"SELECT task_id, filename, {_FINISHED} AS processed_at FROM uploads", sql.UPLOADS,
))
def p2_result_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.result_metadata(completed_uploads(spark, sf_dir))


@query(sql.with_tables(
    f"""SELECT task_id, '{S.UPLOADING}' AS status, CAST(0 AS INTEGER) AS progress,
          '{S.RECEIVED_MESSAGE}' AS message,
          '/videos/upload/' || task_id || '_' || basename AS file_path
        FROM uploads""",
    sql.UPLOADS,
))
def p3_initial_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.initial_records(standins.uploads(spark, sf_dir), standins.UPLOAD_FOLDER)


@query(sql.with_tables(
    f"SELECT task_id, status, {LABEL} AS label FROM selected_tasks", sql.SELECTED_TASKS,
))
def p4_status_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = standins.selected_tasks(spark, sf_dir).select("task_id", "status")
    return tasks.withColumn("label", status.status_label(F.col("status")))


@query(sql.with_tables(
    "SELECT task_id, status, filename FROM selected_tasks "
    "WHERE filename IS NOT NULL AND status IN ('idle', 'completed')",
    sql.SELECTED_TASKS,
))
def p5_startable(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = standins.selected_tasks(spark, sf_dir).select("task_id", "status", "filename")
    return tasks.filter(status.may_start(F.col("filename"), F.col("status")))


@query(sql.with_tables(
    "SELECT task_id, status FROM selected_tasks WHERE status IN ('processing', 'uploading')",
    sql.SELECTED_TASKS,
))
def p6_still_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = standins.selected_tasks(spark, sf_dir).select("task_id", "status")
    return tasks.filter(status.is_active(F.col("status")))


def _ui(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return records.ui_columns(standins.selected_tasks(spark, sf_dir)).select("task_id", *columns)


@query(sql.with_tables(
    f"""SELECT task_id, CASE WHEN status = 'completed' THEN 'reset' ELSE 'start' END AS action,
          CASE status WHEN 'idle' THEN '{S.CAPTION_IDLE}'
            WHEN 'completed' THEN '{S.CAPTION_COMPLETED}' ELSE '{S.CAPTION_BUSY}' END AS caption
        FROM selected_tasks""",
    sql.SELECTED_TASKS,
))
def p7_next_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ui(spark, sf_dir, "action", "caption")


@query(sql.with_tables(
    f"""SELECT task_id, CASE status WHEN 'completed' THEN 'result' WHEN 'idle' THEN 'empty'
            ELSE 'loading' END AS pane,
          CASE WHEN status IN ('completed', 'idle') THEN NULL
            WHEN status = 'uploading' THEN '{S.LOADING_UPLOAD}'
            ELSE '{S.LOADING_ANALYSIS}' END AS loading_text
        FROM selected_tasks""",
    sql.SELECTED_TASKS,
))
def p8_result_pane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ui(spark, sf_dir, "pane", "loading_text")


@query(sql.with_tables(
    """SELECT task_id, processed_video_url IS NOT NULL AS has_output,
         CASE WHEN status = 'completed' THEN 'processed' ELSE 'original' END AS view_mode
       FROM selected_tasks""",
    sql.SELECTED_TASKS,
))
def p9_output_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ui(spark, sf_dir, "has_output", "view_mode")


@query(sql.with_tables(
    """SELECT task_id, CASE WHEN status = 'completed' THEN 'Processed_' || filename
         ELSE filename END AS display_name FROM selected_tasks""",
    sql.SELECTED_TASKS,
))
def p10_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ui(spark, sf_dir, "display_name")


_CODE = "CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 404 END"


@query(f"""
SELECT o_orderkey AS task_id,
  CASE WHEN code = 200 THEN 'uploading' ELSE 'error' END AS after_upload,
  CASE WHEN code = 200 THEN 'completed' WHEN code IS NULL THEN 'error'
    ELSE 'processing' END AS after_poll
FROM (SELECT o_orderkey, {_CODE} AS code FROM orders)""")
def p11_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply codes from the order status: 200, 404 and none at all."""
    code = F.when(F.col("o_orderstatus") == "F", 200).when(F.col("o_orderstatus") == "O", 404)
    return standins.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"),
        status.status_after_upload(F.lit(S.UPLOADING), code).alias("after_upload"),
        status.status_after_poll(F.lit(S.PROCESSING), code, F.lit(S.COMPLETED)).alias("after_poll"),
    )


@query(sql.with_tables(
    f"""SELECT task_id, '{S.UPLOADING}' AS status, CAST(0 AS INTEGER) AS progress,
          '{S.RECEIVED_MESSAGE}' AS message FROM uploads""",
    sql.UPLOADS,
))
def p12_served_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.served_records(p3_initial_record(spark, sf_dir))
