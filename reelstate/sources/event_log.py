"""The append-only task event log: parquet, one folder per day and batch."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructType

from reelstate.schemas import STATUSES, TASK_EVENTS
from reelstate.sources import compaction

DAY = "event_date"
BATCH = "event_batch"


def append_events(events: DataFrame, path: str, batch: str | None = None) -> None:
    """Append event rows, placed by the day of ``event_time``.

    A batch that is written again under its own id replaces what it wrote before; without
    an id every call is a batch of its own.

    The rebalance hint makes files of even size: a busy day is split over tasks, quiet
    days are merged. A status outside the allowed set stops the write, for the log is
    what all state is derived from.
    """
    allowed = F.col("status").isNull() | F.col("status").isin(*STATUSES)
    checked = F.when(allowed, F.col("status")).otherwise(
        F.raise_error(F.concat(F.lit("status outside its allowed values: "), F.col("status")))
    )
    (
        events.withColumn("status", checked)
        .withColumn(DAY, F.to_date("event_time"))
        .withColumn(BATCH, F.lit(batch or uuid.uuid4().hex))
        .hint("rebalance", DAY)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY, BATCH).parquet(path)
    )


def read_events(spark: SparkSession, path: str, days: tuple[str, str] | None = None,
                schema=TASK_EVENTS) -> DataFrame:
    """The log, or the folders of an inclusive range of days."""
    return _seen(spark, path, days, schema).drop(BATCH)


def _seen(spark: SparkSession, path: str, days: tuple[str, str] | None, schema) -> DataFrame:
    events = spark.read.schema(_with_day(schema)).parquet(path)
    events = events.where(compaction.visible(spark, path, DAY, BATCH))
    if days is None:
        return events
    first, last = (F.lit(day).cast("date") for day in days)
    return events.filter(F.col(DAY).between(first, last))


def compact_days(spark: SparkSession, path: str, schema=TASK_EVENTS, most: int = compaction.MOST_BATCHES,
                 keep: int = compaction.KEEP) -> list[str]:
    """Rewrite the days of more than ``most`` batches as one batch each; these days."""
    return compaction.compact(_seen(spark, path, None, schema), path, DAY, BATCH, most, keep)


def stream_events(spark: SparkSession, path: str, schema=TASK_EVENTS,
                  files_per_batch: int = 1_000) -> DataFrame:
    return (
        spark.readStream.schema(_with_day(schema))
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path).where(~F.col(BATCH).startswith(compaction.PREFIX)).drop(BATCH)
    )


def _with_day(schema: StructType) -> StructType:
    # a list of its own: add() would change the fields of the caller's schema
    return StructType([*schema.fields]).add(DAY, DateType()).add(BATCH, StringType())
