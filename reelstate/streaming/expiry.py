"""Running state that lets finished tasks go and starts again from the stored table."""

import sys
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelstate.schemas import ACTIVE_STATUSES

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# How long a finished task stays, for events that come late.
HOUR_MILLISECONDS = 3_600_000


class MergeUntilDone(StatefulProcessor):
    """Holds the merged record of each task: per field its value and the ``order`` value that set it.

    A task that is not active goes when its timer expires, unless an event came meanwhile. What an event that is later
    still brings is a record of its own fields; the table that the rows are merged into has the others.
    """

    def __init__(self, fields: Sequence[str], kinds: Sequence[str], order: str, active: Sequence[str],
                 stay: int | None):
        self.fields, self.order, self.active, self.stay = list(fields), order, set(active), stay
        self.names = [x for name in fields for x in (name, f"{name}_{order}")] + [f"last_{order}"]
        self.kinds = [x for kind in kinds for x in (kind, "BIGINT")] + ["BIGINT"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState(
            "record", ", ".join(f"`{name}` {kind}" for name, kind in zip(self.names, self.kinds)))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.record.update(tuple(initialState[name] for name in self.names))
        self._wait(dict(zip(self.names, self.record.get())), timerValues)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = dict(zip(self.names, self.record.get())) if self.record.exists() else dict.fromkeys(self.names)
        for row in rows:
            seq = row[self.order]
            if seq is None:
                continue
            for name in self.fields:
                at = f"{name}_{self.order}"
                if row[name] is not None and (held[at] is None or seq >= held[at]):
                    held[name], held[at] = row[name], seq
            last = f"last_{self.order}"
            held[last] = seq if held[last] is None else max(held[last], seq)
        self.record.update(tuple(held[name] for name in self.names))
        self._wait(held, timerValues)
        yield Row(_key=key[0], **held)

    def _wait(self, held: dict, timerValues) -> None:
        if self.stay is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held["status"] is not None and held["status"] not in self.active:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stay)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.record.clear()
        yield from ()

    def close(self) -> None:
        pass


def expiring_state_stream(events: DataFrame, fields: Sequence[str], key: str = "task_id", order: str = "seq",
                          initial: DataFrame | None = None, stay: int | None = HOUR_MILLISECONDS) -> DataFrame:
    """Running field-level merge per key, in update mode, as ``latest.latest_state_stream`` gives it.

    Tasks whose status is not active leave the stream's store after ``stay`` milliseconds; the table that
    ``latest.publish_state`` keeps has them. ``initial`` (rows of ``state_levels.read_state``) is the state to start
    from where the checkpoint is new: its active tasks are taken, for the others the table is enough. ``fields`` needs the
    ``status``. Give no ``stay`` for a stream that is drained once. Start the stream inside ``eviction.rocksdb_store``.
    """
    slim = events.select(F.col(key).alias("_key"), F.col(order).cast("long").alias(order), *fields)
    kinds = [events.schema[name].dataType.simpleString() for name in fields]
    processor = MergeUntilDone(fields, kinds, order, ACTIVE_STATUSES, stay)
    key_kind = events.schema[key].dataType.simpleString()
    out = ", ".join(f"`{name}` {kind}" for name, kind in zip(processor.names, processor.kinds))
    started = None
    if initial is not None:
        started = initial.where(F.col("status").isin(*ACTIVE_STATUSES)).select(
            F.col(key).alias("_key"), *processor.names).groupBy("_key")
    return slim.groupBy("_key").transformWithState(
        processor, outputStructType=f"_key {key_kind}, {out}", outputMode="Update",
        timeMode="ProcessingTime" if stay is not None else "None", initialState=started,
    ).withColumnRenamed("_key", key)
