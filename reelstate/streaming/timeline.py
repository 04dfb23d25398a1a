"""Polls answered with the state of their instant, from streams of polls and events in any order."""

import sys
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a task that are one entry of its state.
CHUNK = 1_000


class AnswerAsOf(StatefulProcessor):
    """Holds, for each task, its polls and events that the watermark has not passed, and one record of all before.

    Once the watermark has passed a poll no event before it can come any more: the poll is answered, and the events
    up to it are folded into the record. What is held is bounded by the events and polls of the watermark's delay.
    A task has one timer, at the earliest row that it holds: however many rows the watermark passes at once, they are
    read, sorted and folded once. The rows of a batch are stored in one call, up to ``CHUNK`` of them as one entry.
    """

    def __init__(self, fields: Sequence[str], kinds: Sequence[str], poll: str):
        self.fields, self.kinds, self.poll = list(fields), list(kinds), poll

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = list(zip(self.fields, self.kinds))
        self.record = handle.getValueState("record", ", ".join(f"`{name}` {kind}" for name, kind in columns))
        row = [("_at", "BIGINT"), ("_is_poll", "BOOLEAN"), ("_seq", "BIGINT"), ("_id", self.poll), *columns]
        self.held = handle.getListState("held", ", ".join(f"`{name}` ARRAY<{kind}>" for name, kind in row))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = ["_at", "_is_poll", "_seq", "_id", *self.fields]
        new = [tuple(row[name] for name in names) for row in rows]
        first = _passed_at(new)
        self.held.appendList(_chunks(new))
        timers = list(self.handle.listTimers())
        if not timers or first < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # all that lies before the watermark, which is in milliseconds, is complete
        until = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for chunk in self.held.get():
            for row in zip(*chunk):
                (due if row[0] < until else later).append(row)
        before = self.record.get()
        record = list(before) if before else [None] * len(self.fields)
        # a poll sees the events of its own instant
        for at, is_poll, _, poll, *values in sorted(due, key=lambda x: (x[0], x[1], 0 if x[1] else x[2])):
            if is_poll:
                yield Row(**{"_key": key[0], "_at": at, "_id": poll, **dict(zip(self.fields, record))})
            else:
                record = [old if new is None else new for old, new in zip(record, values)]
        self.record.update(tuple(record))
        if later:
            self.held.put(_chunks(later))
            self.handle.registerTimer(_passed_at(later))
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def _chunks(rows: list[tuple]) -> list[tuple]:
    """Rows as entries of the state, each with a list for every column."""
    return [tuple(map(list, zip(*rows[n:n + CHUNK]))) for n in range(0, len(rows), CHUNK)]


def _passed_at(rows: list[tuple]) -> int:
    """The watermark, in milliseconds, that has passed the earliest row."""
    return min(row[0] for row in rows) // 1000 + 1


def as_of_stream(polls: DataFrame, events: DataFrame, fields: Sequence[str], key: str = "task_id",
                 at: str = "event_time", poll: str = "request_id", order: str = "seq",
                 delay: str = "10 minutes") -> DataFrame:
    """Each poll with the record as of its instant, in append mode: the stream form of ``lookup.state_as_of``.

    ``polls`` (key, poll, at) and ``events`` (key, at, order, fields) are streams; ``at`` is a timestamp. The watermark is
    ``delay`` behind the latest row of the stream that is further back. A poll is answered when it has passed the poll,
    and sees every event that came before that. Rows that it has passed are dropped. Start the stream inside
    ``eviction.rocksdb_store``.
    """
    instant = F.unix_micros(at)
    asked = polls.select(
        F.col(key).alias("_key"), F.col(at).alias("_time"), instant.alias("_at"), F.lit(True).alias("_is_poll"),
        F.col(poll).alias("_id"), F.lit(None).cast("long").alias("_seq"),
        *[F.lit(None).cast(events.schema[name].dataType).alias(name) for name in fields],
    )
    set_ = events.select(
        F.col(key).alias("_key"), F.col(at).alias("_time"), instant.alias("_at"), F.lit(False).alias("_is_poll"),
        F.lit(None).cast(polls.schema[poll].dataType).alias("_id"), F.col(order).cast("long").alias("_seq"), *fields,
    )
    both = asked.withWatermark("_time", delay).unionByName(set_.withWatermark("_time", delay))
    kinds = [events.schema[name].dataType.simpleString() for name in fields]
    out = ", ".join(f"`{name}` {kind}" for name, kind in zip(fields, kinds))
    key_kind, poll_kind = (df.schema[name].dataType.simpleString() for df, name in ((events, key), (polls, poll)))
    answered = both.groupBy("_key").transformWithState(
        AnswerAsOf(fields, kinds, poll_kind),
        outputStructType=f"_key {key_kind}, _at BIGINT, _id {poll_kind}, {out}",
        outputMode="Append", timeMode="EventTime",
    )
    return answered.select(F.col("_key").alias(key), F.timestamp_micros("_at").alias(at),
                           F.col("_id").alias(poll), *fields)
