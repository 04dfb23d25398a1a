"""Task state derived from the append-only event log.

An event row sets some fields of a task record; NULL means the field is untouched.
``seq`` orders the events of a task and is unique within it.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelstate.operators.skew import running_last, running_sum, with_running

# Allowed values of text fields, by field name.
Enums = dict[str, Sequence[str]] | None


def latest_value(events: DataFrame, fields: list[str], keys: Sequence[str] = ("task_id",),
                 order: str = "seq", enums: Enums = None) -> DataFrame:
    """The value each field has in the last event of the key, NULL included."""
    return _aggregate(events, fields, keys, order, enums, F.max_by)


def latest_row(events: DataFrame, keys: Sequence[str] = ("task_id",), order: str = "seq") -> DataFrame:
    """The whole last event row of the key.

    The rank filter also limits rows per key before the shuffle, so a hot key sends one
    row per input partition.
    """
    newest = W.partitionBy(*keys).orderBy(F.col(order).desc())
    return (
        events.withColumn("_rank", F.row_number().over(newest))
        .filter("_rank = 1")
        .drop("_rank")
    )


def merged_state(events: DataFrame, fields: list[str], keys: Sequence[str] = ("task_id",),
                 order: str = "seq", enums: Enums = None) -> DataFrame:
    """Field-level last write wins: per field, the latest value that is not NULL."""
    return _aggregate(events, fields, keys, order, enums, _latest_set)


def _latest_set(field: str, order: str) -> Column:
    return F.max_by(field, F.when(F.col(field).isNotNull(), F.col(order)))


def _aggregate(events: DataFrame, fields: list[str], keys: Sequence[str], order: str,
               enums: Enums, latest: Callable[[str, str], Column]) -> DataFrame:
    """One aggregate per field, combined map-side.

    ``enums`` lists the usual values of text fields. They travel as numbers, and with
    only numbers in its buffer the aggregate hashes where text would make it sort. Other
    values are rare: they are merged on their own, as text, and join the result.
    """
    enums = {name: values for name, values in (enums or {}).items() if name in fields}
    coded = events.withColumns({name: _code(name, values) for name, values in enums.items()})
    set_at = [F.max(F.when(F.col(name).isNotNull(), F.col(order))).alias(f"_{name}_at") for name in enums]
    found = coded.groupBy(*keys).agg(
        F.max(order).alias(f"last_{order}"),
        *[latest(field, order).alias(field) for field in fields],
        *set_at,
    )
    for name, values in enums.items():
        text = F.get(F.array(*[F.lit(v) for v in values]), F.col(name))
        other = events.filter(~F.col(name).isin(*values)).groupBy(
            *[F.col(key).alias(f"_of_{key}") for key in keys]
        ).agg(F.max(order).alias("_other_at"), F.max_by(name, order).alias("_other"))
        matches = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys]
        last = F.col(f"last_{order}") if latest is F.max_by else F.col(f"_{name}_at")
        later = F.col("_other_at") >= F.coalesce(last, F.col("_other_at"))
        found = found.join(other, matches, "left").withColumn(
            name, F.when(later, F.col("_other")).otherwise(text)
        ).drop("_other", "_other_at", *[f"_of_{key}" for key in keys])
    return found.select(*keys, f"last_{order}", *fields)


def _code(name: str, values: Sequence[str]) -> Column:
    code = F.lit(None).cast("int")
    for number, text in reversed(list(enumerate(values))):
        code = F.when(F.col(name) == text, F.lit(number)).otherwise(code)
    return code


def phase_progress(transfers: DataFrame, events: DataFrame, key: str = "task_id",
                   order: str = "seq") -> DataFrame:
    """Latest upload percent and latest processing percent, side by side.

    ``transfers`` has the ``percent`` of the upload's callbacks; processing reports through
    the log, in rows of any status.
    """
    upload = transfers.select(key, order, F.col("percent").alias("upload_percent"),
                              F.lit(None).cast("int").alias("processing_percent"))
    processing = events.select(key, order, F.lit(None).cast("int").alias("upload_percent"),
                               F.col("progress").alias("processing_percent"))
    both = upload.unionByName(processing)

    def latest(name: str) -> Column:
        # equal order values: the higher percent
        return F.max(F.when(F.col(name).isNotNull(), F.struct(order, name)))[name].alias(name)

    return both.groupBy(key).agg(latest("upload_percent"), latest("processing_percent"))


def state_history(events: DataFrame, fields: list[str], keys: Sequence[str] = ("task_id",),
                  order: str = "seq", limit: int | None = None) -> DataFrame:
    """The full record after every event: untouched fields keep their value."""
    return with_running(
        events, list(keys), [order], [running_last(field, [order]) for field in fields], limit=limit
    )


def number_attempts(events: DataFrame, is_reset: Column, key: str = "task_id",
                    order: str = "seq", limit: int | None = None) -> DataFrame:
    """Number the attempts of a task: each reset starts the next one.

    An event that names its ``attempt`` keeps it, so that a late result stays with the
    attempt it belongs to; all others take the number of resets so far. Events should be
    in the log once, which batch ids of ``append_events`` see to.
    """
    resets = F.coalesce(is_reset, F.lit(False)).cast("long")
    named = "attempt" in events.columns
    given = events.withColumnRenamed("attempt", "_given") if named else events
    running = with_running(
        given, [key], [order], [running_sum("attempt", resets)], limit=limit
    )
    if not named:
        return running
    return running.withColumn("attempt", F.coalesce("_given", "attempt")).drop("_given")
