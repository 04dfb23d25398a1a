"""Following tasks until they end."""

import contextlib
import sys
from typing import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelstate.schemas import ACTIVE_STATUSES

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# How long an event may be late without bringing a finished task back.
DAY_MILLISECONDS = 86_400_000


@contextlib.contextmanager
def rocksdb_store(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which following tasks needs."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def newest_per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the newest row of each key in each Arrow batch.

    Only the newest row decides whether a task is followed, so this map-side combine
    changes no result. It takes a hot key's rows out of the shuffle.
    """
    for batch in batches:
        table = pa.Table.from_batches([batch])
        newest = table.group_by("key").aggregate([("seq", "max")])
        newest = newest.rename_columns({"seq_max": "seq"})
        kept = table.join(newest, ["key", "seq"], join_type="inner")
        yield from kept.select(batch.schema.names).combine_chunks().to_batches()


class FollowUntilDone(StatefulProcessor):
    """Holds the newest event of each task that is still active.

    A task that ends leaves the state. With ``late_milliseconds`` its last ``seq`` stays
    that long as a tombstone, so an event that arrives late does not bring the task back.
    """

    def __init__(self, active: tuple[str, ...], late_milliseconds: int | None):
        self.active = active
        self.late_milliseconds = late_milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "seq BIGINT")
        self.states = [self.open]
        if self.late_milliseconds:
            self.ended = handle.getValueState(
                "ended", "seq BIGINT", ttlDurationMs=self.late_milliseconds
            )
            self.states.append(self.ended)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda row: row.seq, default=None)
        known = [state.get()[0] for state in self.states if state.exists()]
        if newest is None or any(newest.seq <= seq for seq in known):
            return
        followed = newest.status in self.active
        for state in self.states:
            state.clear()
        if followed:
            self.open.update((newest.seq,))
        elif self.late_milliseconds:
            self.ended.update((newest.seq,))
        yield Row(key=key[0], seq=newest.seq, status=newest.status, followed=followed)

    def close(self) -> None:
        pass


def follow_tasks(events: DataFrame, key: str = "task_id", order: str = "seq",
                 late_milliseconds: int | None = DAY_MILLISECONDS) -> DataFrame:
    """A stream of ``task, seq, status, followed``: one row per task a batch changed.

    Events without a status leave a task as it is. The last event of a finished task is
    remembered for ``late_milliseconds``, so that late ones do not bring it back. Give None
    for a stream that is drained once: Spark would go on to wait for the memories to expire.
    Start the stream inside ``rocksdb_store``.
    """
    slim = events.filter("status IS NOT NULL").selectExpr(f"{key} AS key", f"{order} AS seq", "status")
    kind = slim.schema["key"].dataType.simpleString()
    combined = slim.mapInArrow(newest_per_batch, f"key {kind}, seq BIGINT, status STRING")
    return combined.groupBy("key").transformWithState(
        FollowUntilDone(ACTIVE_STATUSES, late_milliseconds),
        outputStructType=f"key {kind}, seq BIGINT, status STRING, followed BOOLEAN",
        outputMode="Update",
        timeMode="ProcessingTime" if late_milliseconds else "None",
    ).withColumnRenamed("key", key)
