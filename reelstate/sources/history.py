"""History of task records, extended day by day.

The record after every event needs what was before it. A snapshot, the levelled table of ``state_levels``, holds for each
task its last record and its number of attempts. A new day reads its own events and of the snapshot the buckets, or
for few tasks the pages, that hold its tasks; it writes its own history and its tasks' new records. No window goes over
the log, and the work of a day grows with the day.

Events count in the order of ``order``. One that comes after its task's later events have been taken in would change
history that is written: it goes to ``late`` instead, for ``state.state_history`` over the whole log to set right.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstate.operators.skew import running_last, running_sum, with_running
from reelstate.sources.state_levels import Commit, Layout, merge_events, read_state, store_batch

DAY = "day_id"
RESETS = "resets"


def extend(events: DataFrame, path: str, day: int, fields: Sequence[str], is_reset: Column | None = None,
           key: str = "task_id", order: str = "seq", layout: Layout | None = None, limit: int | None = None) -> None:
    """Add a day's events to the history at ``path``: ``history``, ``late`` and the ``snapshot``.

    Numbers of days grow. A day that failed is written again, one that is in the snapshot is left out. With ``is_reset``
    each row gets its ``attempt``, as ``state.number_attempts`` gives it.
    """
    spark, table = events.sparkSession, f"{path}/snapshot"
    last = Commit.last(spark, table)
    if last and day <= last.batch_id:
        return
    resets = F.lit(False) if is_reset is None else F.coalesce(is_reset, F.lit(False))
    named = "attempt" in events.columns
    own = events.select(key, order, *fields, (F.col("attempt") if named else F.lit(None)).cast("long").alias("_given"),
                        resets.cast("long").alias("_resets"), F.lit(True).alias("_own"))
    if last:
        before = read_state(spark, table, [*fields, RESETS], key, order, asked=events)
        known = before.select(key, F.col(f"last_{order}").alias(order), *fields, F.lit(None).cast("long").alias("_given"),
                              F.col(RESETS).alias("_resets"), F.lit(False).alias("_own"))
        known = known.join(events.select(key).distinct(), key, "left_semi")
    else:
        known = own.limit(0)
    seen = known.select(F.col(key).alias("_of"), F.col(order).alias("_seen"))
    marked = own.join(seen, own[key] == seen["_of"], "left").drop("_of")
    in_time = F.coalesce(F.col(order) > F.col("_seen"), F.lit(True))
    late = marked.where(~in_time).drop("_seen", "_own", "_resets", "_given")
    late.write.mode("overwrite").parquet(f"{path}/late/{DAY}={day}")
    own = marked.where(in_time).drop("_seen").unionByName(known)
    columns = [running_last(field, [order]) for field in fields] + [running_sum("_attempt", F.col("_resets"))]
    rows = with_running(own, [key], [order], columns, limit).where("_own")
    attempts = [F.coalesce("_given", "_attempt").alias("attempt")] if is_reset is not None else []
    target = f"{path}/history/{DAY}={day}"
    rows.select(key, order, *fields, *attempts, F.col("_attempt").alias(RESETS)).write.mode("overwrite").parquet(target)
    written = spark.read.parquet(target)
    store_batch(merge_events(written, [*fields, RESETS], key, order), table, day, [*fields, RESETS], key, order, layout)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All days' rows: the record after each event, and its attempt where that is kept."""
    return spark.read.parquet(f"{path}/history").drop(DAY, RESETS)


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """Events that came after later ones of their task had been taken in."""
    return spark.read.parquet(f"{path}/late").drop(DAY)
