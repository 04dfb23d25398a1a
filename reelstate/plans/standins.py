"""The given tables in the roles of the media-task tables.

Only columns that a query uses reach the scan; all functions stay lazy.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstate import schemas as S
from reelstate.functions import parsing, text
from reelstate.operators.results import with_positions

PUBLIC_BASE = S.PUBLIC_BASE
UPLOAD_FOLDER = "/videos/upload"
DETECTION_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream.

    The pattern in the path lets the table be one file or a folder of files; a plain path
    would have to be a folder.
    """
    schema = table(spark, sf_dir, name).schema
    path = f"{sf_dir}/{name}.parque[t]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1_000).parquet(path)


def as_task_events(events: DataFrame) -> DataFrame:
    """``events`` rows as task events of their user; clicks report progress and no status."""
    kind = F.col("event_type")
    moving = kind.isin("signup", "view", "click")
    done = kind == "purchase"
    percent = F.get_json_object("props", "$.k").cast("int")
    status = (
        F.when(kind == "signup", S.UPLOADING)
        .when(kind == "view", S.PROCESSING)
        .when(done, S.COMPLETED)
        .when(kind == "error", S.ERROR)
    )
    clip = F.concat(F.lit("clip_"), F.col("event_id").cast("string"), F.lit(".mp4"))
    url = text.public_url(PUBLIC_BASE, text.processed_name(F.col("user_id"), clip))
    message = text.progress_message(percent)
    return events.select(
        F.col("user_id").alias("task_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("event_time"),
        status.alias("status"),
        F.when(moving, percent).when(done, S.PROGRESS_LAST).alias("progress"),
        F.when(kind.isin("view", "click"), message).alias("message"),
        F.when(done, url).alias("processed_video_url"),
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_task_events(table(spark, sf_dir, "events"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status request per order, for the order's own task."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("task_id"))


def customer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status request per order, for the customer's task: many per task."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("task_id")
    )


def detections(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """``lineitem`` rows as numbered detections of their order's task."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), *DETECTION_ORDER, "l_discount", "l_tax"
    )
    numbered = with_positions(rows, DETECTION_ORDER, limit=limit)
    return numbered.select("task_id", "pos", *detection_fields())


def detection_fields() -> list[Column]:
    supplier = parsing.padded(F.col("l_suppkey"), 9)
    number = parsing.padded(F.col("l_suppkey") % 1000, 3)
    return [
        parsing.media_offset(F.floor("l_extendedprice")).alias("timestamp"),
        F.concat(F.lit("H"), number).alias("horse_id"),
        F.concat(F.lit("Supplier#"), supplier).alias("person_name"),
        F.concat_ws("_", _share("l_discount"), _share("l_tax")).alias("confidence"),
    ]


def _share(name: str) -> Column:
    return (1 - F.col(name)).cast("decimal(4,2)").cast("string")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload per document; names hold separators, underscores and mixed case."""
    doc = F.col("doc_id").cast("string")
    kind = (
        F.when(F.col("lang") == "en", "mp4").when(F.col("lang") == "de", "MOV")
        .when(F.col("lang") == "fr", "avi").otherwise("txt")
    )
    name = F.concat(F.col("source"), F.lit("/clip_"), doc, F.lit("."), kind)
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.derived_task_id(F.lit("upload"), F.col("doc_id")).alias("task_id"),
        name.alias("filename"), "lang", "n_chars",
    )


def selected_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One client session per order, in any of six statuses, some without a file."""
    key = F.col("o_orderkey").cast("string")
    statuses = F.array(*[F.lit(s) for s in (*S.STATUSES, "queued")])
    clip = F.concat(F.lit("clip_"), key, F.lit(".mp4"))
    status = F.get(statuses, F.pmod("o_custkey", F.lit(6)).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"),
        status.alias("status"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", clip).alias("filename"),
        F.when(status == S.COMPLETED, text.public_url(PUBLIC_BASE, clip)).alias(
            "processed_video_url"
        ),
    )


def transfers(lineitem: DataFrame) -> DataFrame:
    """``lineitem`` rows as upload callbacks; some totals are 0."""
    return lineitem.select(
        F.col("l_orderkey").alias("task_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_linenumber").cast("long").alias("loaded"),
        F.round(F.col("l_tax") * 100).cast("long").alias("total"),
    )
