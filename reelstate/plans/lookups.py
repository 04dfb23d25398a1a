"""Lookup queries and the flagship: every request answered, with its detections."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstate import schemas as S
from reelstate.operators import lookup, results, state
from reelstate.plans import sql, standins
from reelstate.plans.catalog import query
from reelstate.plans.states import ENUMS, FIELDS

NOT_FOUND = f"'{S.NOT_FOUND_MESSAGE}'"


@query(sql.with_tables(
    f"""SELECT r.o_orderkey AS task_id,
          CAST(CASE WHEN d.task_id IS NULL THEN 404 ELSE 200 END AS INTEGER) AS code,
          CASE WHEN d.task_id IS NULL THEN {NOT_FOUND} END AS reply_message,
          d.pos, d."timestamp", d.horse_id, d.person_name, d.confidence
        FROM orders r LEFT JOIN detections d ON d.task_id = r.o_orderkey""",
    sql.DETECTIONS,
))
def flagship_request_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply code and flattened detections of every requested task."""
    answers = answered_documents(spark, sf_dir)
    return results.flatten_results(
        answers, ["task_id", "code", "reply_message"], keep_empty=True
    )


def answered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's request with the result documents of its task."""
    return lookup.answer_documents(
        standins.requests(spark, sf_dir),
        results.assemble_results(standins.detections(spark, sf_dir)),
        unique=True,
    )


@query(sql.with_tables(
    f"""SELECT r.o_orderkey AS request_id, r.o_custkey AS task_id,
          CAST(CASE WHEN s.task_id IS NULL THEN 404 ELSE 200 END AS INTEGER) AS code,
          CASE WHEN s.task_id IS NULL THEN {NOT_FOUND} END AS reply_message,
          s.status, s.progress, s.message, s.processed_video_url
        FROM orders r LEFT JOIN ({sql.merged_state()}) s ON s.task_id = r.o_custkey""",
    sql.TASK_EVENTS,
))
def j1_status_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = state.merged_state(standins.task_events(spark, sf_dir), FIELDS, enums=ENUMS)
    return lookup.answer(standins.customer_requests(spark, sf_dir), merged.drop("last_seq"))


_TASKS = "SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey"


def _line_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = standins.table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("task_id"))


@query(f"SELECT o_orderkey AS task_id FROM orders WHERE EXISTS ({_TASKS})")
def j2_known_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.known_requests(
        standins.requests(spark, sf_dir), _line_tasks(spark, sf_dir), unique=True
    )


@query(f"SELECT o_orderkey AS task_id FROM orders WHERE NOT EXISTS ({_TASKS})")
def j2_unknown_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.unknown_requests(
        standins.requests(spark, sf_dir), _line_tasks(spark, sf_dir), unique=True
    )


# events without a status report progress, and are part of the log
AS_OF = sql.with_tables(
    """SELECT p.task_id, p.seq AS request_id, e.status, e.progress
       FROM (SELECT * FROM task_events WHERE status = 'error') p
       ASOF LEFT JOIN (
         SELECT task_id, event_time,
           last_value(status IGNORE NULLS) OVER w AS status,
           last_value(progress IGNORE NULLS) OVER w AS progress
         FROM task_events WHERE coalesce(status, '') <> 'error'
         WINDOW w AS (PARTITION BY task_id ORDER BY event_time, seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         QUALIFY row_number() OVER (PARTITION BY task_id, event_time ORDER BY seq DESC) = 1
       ) e ON p.task_id = e.task_id AND p.event_time >= e.event_time""",
    sql.TASK_EVENTS,
)


@query(AS_OF)
def j3_state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rows stand in for polls, all others are the log they look into."""
    events = standins.task_events(spark, sf_dir).withColumn("at", F.unix_micros("event_time"))
    polls = events.filter("status = 'error'").select(
        "task_id", "at", F.col("seq").alias("request_id")
    )
    log = events.filter("coalesce(status, '') <> 'error'").select("task_id", "at", "seq", "status", "progress")
    return lookup.state_as_of(polls, log, ["status", "progress"]).drop("at")


def _document_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("lang") == "fr", S.PROCESSING).otherwise(F.lit(S.COMPLETED))
    return standins.table(spark, sf_dir, "documents").select(
        "doc_id", "source", status.alias("status")
    )


_DOCUMENT_TASKS = ("SELECT doc_id, source, CASE WHEN lang = 'fr' THEN 'processing' "
                   "ELSE 'completed' END AS status FROM documents")


@query(f"SELECT t.* FROM ({_DOCUMENT_TASKS}) t "
       "WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id)")
def j4_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = standins.table(spark, sf_dir, "labels")
    return lookup.with_source(_document_tasks(spark, sf_dir), manifest, "doc_id", unique=True)


@query(f"SELECT t.* FROM ({_DOCUMENT_TASKS}) t WHERE status = 'completed' "
       "AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id)")
def j4_dangling_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = standins.table(spark, sf_dir, "labels")
    return lookup.dangling_outputs(_document_tasks(spark, sf_dir), manifest, "doc_id", unique=True)
