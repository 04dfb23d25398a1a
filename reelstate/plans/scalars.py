"""One query per scalar function."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstate import schemas as S
from reelstate.functions import documents, parsing, progress, text
from reelstate.operators import records, results
from reelstate.operators.lookup import answer
from reelstate.plans import sql, standins
from reelstate.plans.catalog import query
from reelstate.plans.lookups import answered_documents
from reelstate.plans.projections import completed_uploads


@query(sql.with_tables(
    """SELECT task_id, task_id || '_' || basename AS stored,
         'processed_' || task_id || '_' || basename AS processed,
         '/videos/upload/' || task_id || '_' || basename AS path,
         task_id AS split_id, basename AS split_name
       FROM uploads""",
    sql.UPLOADS,
))
def s_s1_storage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage names built and split again."""
    task, name = F.col("task_id"), F.col("filename")
    stored = text.storage_name(task, name)
    return standins.uploads(spark, sf_dir).select(
        "task_id", stored.alias("stored"), text.processed_name(task, name).alias("processed"),
        text.in_folder(standins.UPLOAD_FOLDER, stored).alias("path"),
        text.stored_task_id(stored).alias("split_id"),
        text.stored_filename(stored).alias("split_name"),
    )


@query(sql.with_tables(
    f"SELECT task_id, '{sql.BASE}/processed_' || task_id || '_' || basename AS url FROM uploads",
    sql.UPLOADS,
))
def s_s2_public_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = text.processed_name(F.col("task_id"), F.col("filename"))
    url = text.public_url(standins.PUBLIC_BASE, name)
    return standins.uploads(spark, sf_dir).select("task_id", url.alias("url"))


@query("""
SELECT event_id, '正在进行 AI 识别... ' || json_extract_string(props, '$.k') || '%' AS message,
  json_extract_string(props, '$.k') || '%' AS percent
FROM events""")
def s_s3_s4_progress_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    percent = F.get_json_object("props", "$.k").cast("int")
    return standins.table(spark, sf_dir, "events").select(
        "event_id", text.progress_message(percent).alias("message"),
        text.percent_text(percent).alias("percent"),
    )


@query("""SELECT page_id, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref
FROM pages""")
def s_s5_query_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = standins.table(spark, sf_dir, "pages")
    return pages.select("page_id", text.query_parameter(F.col("url"), "ref").alias("ref"))


@query("""SELECT '/api/status?task_id=' || o_orderkey AS url,
  CAST(o_orderkey AS VARCHAR) AS task_id FROM orders""")
def s_s5_request_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status URLs built, and bound back to their task id."""
    url = text.status_url(F.col("task_id"))
    bound = text.query_parameter(F.concat(F.lit("http://localhost"), url))
    return standins.requests(spark, sf_dir).select(url.alias("url"), bound.alias("task_id"))


@query(sql.with_tables(
    """SELECT task_id, pos, confidence, CAST(split_part(confidence, '_', 1) AS DOUBLE) AS conf_1,
         CAST(split_part(confidence, '_', 2) AS DOUBLE) AS conf_2,
         CAST(split_part("timestamp", ':', 1) AS BIGINT) * 60
           + CAST(split_part("timestamp", ':', 2) AS BIGINT) AS offset_seconds
       FROM detections""",
    sql.DETECTIONS,
))
def s_s6_s_d2_typed_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence parts and media offsets of every detection."""
    typed = results.typed_detections(standins.detections(spark, sf_dir))
    return typed.select(
        "task_id", "pos", "confidence", F.col("conf_1").cast("double").alias("conf_1"),
        F.col("conf_2").cast("double").alias("conf_2"), "offset_seconds",
    )


_RESOLUTION = "CASE WHEN lang = 'de' THEN n_chars || 'p' ELSE n_chars || 'x' || doc_id END"


@query(f"""
SELECT doc_id, resolution,
  CASE WHEN lang <> 'de' THEN CAST(n_chars AS INTEGER) END AS width,
  CASE WHEN lang <> 'de' THEN CAST(doc_id AS INTEGER) END AS height
FROM (SELECT doc_id, lang, n_chars, {_RESOLUTION} AS resolution FROM documents)""")
def s_s7_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width and height; some texts are malformed and have neither."""
    size = F.col("n_chars").cast("string")
    raw = F.when(F.col("lang") == "de", F.concat(size, F.lit("p"))).otherwise(
        F.concat(size, F.lit("x"), F.col("doc_id").cast("string"))
    )
    width, height = parsing.resolution_parts(F.col("resolution"))
    return (
        standins.table(spark, sf_dir, "documents")
        .select("doc_id", raw.alias("resolution"))
        .select("doc_id", "resolution", width.alias("width"), height.alias("height"))
    )


@query("""
SELECT l_orderkey AS task_id, l_partkey AS part_id, CAST(l_linenumber AS BIGINT) AS loaded,
  CAST(round(l_tax * 100) AS BIGINT) AS total,
  CAST(round(l_linenumber * 100.0::DOUBLE
    / coalesce(nullif(round(l_tax * 100), 0), 1)) AS BIGINT) AS percent
FROM lineitem""")
def s_m1_transfer_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = standins.transfers(standins.table(spark, sf_dir, "lineitem"))
    percent = progress.transfer_percent(F.col("loaded"), F.col("total"))
    return moves.withColumn("percent", percent)


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS completed_at FROM events")
def s_d1_completion_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.table(spark, sf_dir, "events").select(
        "event_id", text.completion_text(F.col("ts")).alias("completed_at")
    )


@query(sql.with_tables(
    "SELECT doc_id, task_id, CAST(36 AS INTEGER) AS id_length, true AS is_version_4 FROM uploads",
    sql.UPLOADS,
))
def s_i1_task_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replayable id, and the shape of a random one."""
    with_random = standins.uploads(spark, sf_dir).select(
        "doc_id", "task_id", text.random_task_id().alias("_random")
    )
    return with_random.select(
        "doc_id", "task_id", F.length("_random").alias("id_length"),
        (F.substring("_random", 15, 1) == "4").alias("is_version_4"),
    )


@query(sql.with_tables(
    """SELECT task_id, pos, "timestamp", horse_id, person_name, confidence FROM detections
       UNION ALL
       SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL FROM orders
       WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    sql.DETECTIONS,
))
def s_n1_s_n2_build_and_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result structs built, then flattened in the form that keeps empty tasks."""
    result = documents.result(
        F.lit("clip.mp4"), F.lit("00:30"), F.lit("1920x1080"), F.lit("2026-03-06 14:00:00"),
        F.col("detections"),
    )
    built = answered_documents(spark, sf_dir).select("task_id", "part", result.alias("result"))
    return results.flatten_results(
        built.select("task_id", "part", "result.detections"), ["task_id"], keep_empty=True
    )


_REPLY = f"""
CASE WHEN n IS NULL
  THEN to_json({{'code': {S.NOT_FOUND_CODE}, 'message': '{S.NOT_FOUND_MESSAGE}'}})::VARCHAR
  ELSE to_json({{'code': {S.OK_CODE}, 'data': {{'status': 'completed', 'progress': 100,
    'n_detections': n}}}})::VARCHAR END"""

REPLY_LINES_SQL = f"""
SELECT o_orderkey AS task_id, {_REPLY} AS value
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
  ON l_orderkey = o_orderkey"""


def order_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for every order: its record, or not found."""
    lines = standins.table(spark, sf_dir, "lineitem")
    tasks = lines.groupBy(F.col("l_orderkey").alias("task_id")).agg(
        F.count(F.lit(1)).alias("n_detections")
    ).withColumns({"status": F.lit(S.COMPLETED), "progress": F.lit(S.PROGRESS_LAST)})
    answers = answer(standins.requests(spark, sf_dir), tasks, unique=True)
    return records.reply_documents(answers, ["status", "progress", "n_detections"])


@query(REPLY_LINES_SQL)
def s_j1_compact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = order_replies(spark, sf_dir)
    return replies.select("task_id", documents.compact_json(F.col("reply")).alias("value"))


@query(sql.with_tables(
    "SELECT task_id, filename, CAST(7 AS INTEGER) AS n_lines FROM uploads", sql.UPLOADS,
))
def s_j2_pretty_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indented result document, shown as its line count and a parsed field."""
    shown = completed_uploads(spark, sf_dir).select(
        "task_id", documents.pretty_json(F.col("result")).alias("_json")
    )
    return shown.select(
        "task_id", F.get_json_object("_json", "$.filename").alias("filename"),
        F.size(F.split("_json", "\n")).alias("n_lines"),
    )
