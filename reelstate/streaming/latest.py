"""Latest state of a stream, and the keyed tables that streams keep up to date (``sources.state_levels``)."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelstate.sources.state_levels import Layout, merge_events, merged_fields, store_batch

EVERY_SECOND = {"processingTime": "1 second"}


def latest_state_stream(events: DataFrame, fields: Sequence[str], key: str = "task_id",
                        order: str = "seq") -> DataFrame:
    """Running field-level merge per key, for update mode.

    Each micro-batch combines map-side before it touches the state store, so a hot key
    sends one row per input partition. State is kept for every key; ``upsert_stream`` needs
    none, ``expiry.expiring_state_stream`` lets finished tasks go.
    """
    return events.groupBy(key).agg(*merged_fields(fields, order, events=True))


def upsert_stream(events: DataFrame, table: str, checkpoint: str, fields: Sequence[str],
                  key: str = "task_id", order: str = "seq", trigger: dict | None = None,
                  layout: Layout | None = None) -> StreamingQuery:
    """Merge an event stream into a table, without a state store."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        store_batch(merge_events(batch, fields, key, order), table, batch_id, fields, key, order, layout)

    return _start(events.writeStream.foreachBatch(upsert), checkpoint, trigger)


def publish_state(state: DataFrame, table: str, checkpoint: str, fields: Sequence[str], key: str = "task_id",
                  order: str = "seq", trigger: dict | None = None, layout: Layout | None = None,
                  first_batch: int = 0) -> StreamingQuery:
    """Merge the updated rows of a state stream into a table each second.

    A stream with a new checkpoint numbers its batches from 0: give it a ``first_batch`` above those in the table.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, table, first_batch + batch_id, fields, key, order, layout)

    return _start(state.writeStream.outputMode("update").foreachBatch(publish), checkpoint, trigger)


def publish_changes(changes: DataFrame, table: str, checkpoint: str, key: str = "task_id", order: str = "seq",
                    drop: str | None = None, trigger: dict | None = None,
                    layout: Layout | None = None) -> StreamingQuery:
    """Keep the newest of the rows that a stream emits for a key; rows that ``drop`` holds for go in time."""
    fields = [name for name in changes.columns if name not in (key, order)]

    def publish(batch: DataFrame, batch_id: int) -> None:
        # the row as a whole counts, so that a NULL in it replaces a value
        whole = batch.select(key, F.col(order), F.struct(*fields).alias("row"))
        rows = merge_events(whole, ["row"], key, order)
        store_batch(rows, table, batch_id, ["row"], key, order, layout, drop and f"row.{drop}")

    return _start(changes.writeStream.outputMode("update").foreachBatch(publish), checkpoint, trigger)


def _start(writer, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        writer.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or EVERY_SECOND))
        .start()
    )
