"""Sources and sinks, written to the shared scratch folder and read back."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstate import schemas as S
from reelstate.functions import documents, text
from reelstate.operators import records, results
from reelstate.plans import sql, standins
from reelstate.plans.catalog import ORACLES, query
from reelstate.plans.lookups import answered_documents
from reelstate.plans.scalars import REPLY_LINES_SQL, order_replies
from reelstate.session import scratch_path
from reelstate.sources import event_log, landing, listing, replies


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
TABLE_FILES = f"""
SELECT CAST(NULL AS VARCHAR) AS task_id, name || '.parquet' AS filename, 'parquet' AS extension,
  TRUE AS has_bytes
FROM (VALUES {", ".join(f"('{name}')" for name in TABLES)}) AS tables(name)"""


def file_facts(manifest: DataFrame) -> DataFrame:
    return manifest.select(
        "task_id", "filename", text.extension(F.col("filename")).alias("extension"),
        (F.col("length") > 0).alias("has_bytes"),
    )


@query(TABLE_FILES)
def io1_landing_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all table files, as if the folder were the landing folder."""
    return file_facts(landing.read_landing(spark, sf_dir, glob="*.parquet", recursive=True))


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's upload in an inventory of the landing folder; some have no bytes."""
    uploads = standins.uploads(spark, sf_dir)
    name = text.storage_name(F.col("task_id"), F.col("filename"))
    return uploads.select(
        F.concat(F.lit(f"{standins.UPLOAD_FOLDER}/"), name).alias("path"),
        (F.col("n_chars") % 7).alias("length"),
        F.timestamp_seconds(F.col("n_chars") + 1_772_805_600).alias("modificationTime"),
    )


def landed_uploads(spark: SparkSession, sf_dir: str) -> str:
    """A folder that every document's upload has landed in, by the first digit of its task; some have no bytes."""
    uploads = standins.uploads(spark, sf_dir)
    folder = scratch_path(spark, "landed")
    name = text.storage_name(F.col("task_id"), F.col("filename"))
    rows = uploads.select(F.concat(F.lit(f"{folder}/"), F.substring("task_id", 1, 1), F.lit("/"), name).alias("path"),
                          (F.col("n_chars") % 7).alias("size"))

    def land(part) -> None:
        for path, size in part:
            files, inner = listing.opened(path)
            files.create_dir(inner.rsplit("/", 1)[0])
            with files.open_output_stream(inner) as out:
                out.write(b"x" * size)

    rows.foreachPartition(land)
    return folder


UPLOADED = sql.with_tables(
    "SELECT task_id, basename AS filename, n_chars % 7 AS length FROM uploads", sql.UPLOADS,
)


@query(UPLOADED)
def io1_landed_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of uploaded files, listed by tasks, those without bytes among them."""
    files = listing.list_files(spark, landed_uploads(spark, sf_dir))
    return landing.to_manifest(files).select("task_id", "filename", "length")


@query(UPLOADED)
def io1_inventory_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest from an inventory table: empty files stay, and no folder is listed."""
    return landing.to_manifest(_landed(spark, sf_dir)).select("task_id", "filename", "length")


@query(sql.with_tables(
    f"""SELECT task_id, CAST(0 AS BIGINT) AS seq, '{S.UPLOADING}' AS status,
          CAST(0 AS INTEGER) AS progress, '{S.RECEIVED_MESSAGE}' AS message,
          '/videos/upload/' || task_id || '_' || basename AS file_path,
          strftime(to_timestamp(n_chars + 1772805600) AT TIME ZONE 'UTC', '%Y-%m-%d') AS event_date
        FROM uploads""",
    sql.UPLOADS,
))
def io3_uploads_to_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed uploads as creation events in the log, written twice as one batch."""
    created = records.creation_events(landing.to_manifest(_landed(spark, sf_dir)))
    path = scratch_path(spark, "upload-log")
    for _ in range(2):
        event_log.append_events(created, path, batch="0")
    log = event_log.read_events(spark, path)
    return log.select("task_id", "seq", "status", "progress", "message", "file_path",
                      F.col("event_date").cast("string").alias("event_date"))


@query(sql.with_tables(
    "SELECT task_id, basename AS filename FROM uploads WHERE lang IN ('en', 'de', 'fr')",
    sql.UPLOADS,
))
def io2_media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = standins.uploads(spark, sf_dir).select(
        "task_id", text.basename(F.col("filename")).alias("filename")
    )
    return landing.only_media(manifest)


@query(sql.with_tables(
    """SELECT strftime(event_time, '%Y-%m-%d') AS event_date, task_id, seq, status, progress,
         message, processed_video_url FROM task_events""",
    sql.TASK_EVENTS,
))
def io3_event_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a day-partitioned log, and the log read back."""
    events = standins.task_events(spark, sf_dir)
    path = scratch_path(spark, "event-log")
    event_log.append_events(events, path)
    log = event_log.read_events(spark, path, schema=events.schema)
    return log.drop("event_time").withColumn("event_date", F.col("event_date").cast("string"))


@query(ORACLES["io3_event_append"])
def io3_compacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log from batches of hashed events, its busy days compacted twice while it grows."""
    events = standins.task_events(spark, sf_dir)
    path = scratch_path(spark, "compacted-log")
    for batch in range(4):
        event_log.append_events(events.where(F.pmod(F.xxhash64("seq"), F.lit(4)) == batch), path, batch=str(batch))
        event_log.compact_days(spark, path, events.schema, most=1)
    log = event_log.read_events(spark, path, schema=events.schema)
    return log.drop("event_time").withColumn("event_date", F.col("event_date").cast("string"))


@query(sql.with_tables(
    """SELECT CAST(task_id AS VARCHAR) AS task_id, pos, "timestamp", horse_id, person_name,
         confidence, CAST(200 AS INTEGER) AS code
       FROM detections
       UNION ALL
       SELECT NULL, NULL, NULL, NULL, NULL, NULL, CAST(404 AS INTEGER) FROM orders
       WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    sql.DETECTIONS,
))
def io4_reply_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result replies written as JSON lines, then scanned with the declared schema."""
    answers = answered_documents(spark, sf_dir)
    result = documents.result(
        F.concat(F.lit("clip_"), F.col("task_id").cast("string"), F.lit(".mp4")),
        F.lit("00:30"), F.lit("1920x1080"), F.lit("2026-03-06 14:00:00"), F.col("detections"),
        F.col("part"), F.col("first_pos"),
    )
    path = _sent(answers, result)
    read = replies.read_replies(spark, path).select("code", "data.task_id", "data.result")
    return results.flatten_results(read, ["task_id", "code"], keep_empty=True)


def _sent(answers: DataFrame, result: Column) -> str:
    """The path of the answers' replies, one JSON line each."""
    full = answers.select(
        F.col("task_id").cast("string"), "code", "reply_message",
        F.lit(S.COMPLETED).alias("status"), result.alias("result"),
    )
    sent = records.reply_documents(
        full.withColumn("key", F.col("task_id")), ["task_id", "status", "result"]
    )
    path = scratch_path(answers.sparkSession, "replies")
    replies.write_replies(sent, path, "key")
    return path


@query(sql.with_tables(
    """SELECT CAST(task_id AS VARCHAR) AS task_id, pos, "timestamp", horse_id, person_name,
         confidence FROM detections""",
    sql.DETECTIONS,
))
def io4_declared_reply_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in parts of two through JSON replies and the declared reply schema."""
    parts = results.assemble_results(standins.detections(spark, sf_dir), part_size=2)
    answers = parts.withColumns({"code": F.lit(S.OK_CODE), "reply_message": F.lit(None).cast("string")})
    result = documents.result(
        F.lit("clip.mp4"), F.lit("00:30"), F.lit("1920x1080"), F.lit("2026-03-06 14:00:00"),
        F.col("detections"), F.col("part"), F.col("first_pos"),
    )
    read = replies.read_replies(spark, _sent(answers, result)).select("data.task_id", "data.result")
    return results.detection_table(results.flatten_results(read, ["task_id"]))


@query(f"SELECT value FROM ({REPLY_LINES_SQL})")
def io5_reply_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply lines as another reader finds them."""
    path = scratch_path(spark, "reply-lines")
    replies.write_replies(order_replies(spark, sf_dir), path)
    return spark.read.text(path)
