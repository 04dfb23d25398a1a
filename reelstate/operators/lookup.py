"""Keyed lookups of requests against task state.

``unique`` promises that the request key is a primary key; see ``lookup_join``.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelstate import schemas as S
from reelstate.operators.skew import lookup_join, running_last, with_running


def answer(requests: DataFrame, state: DataFrame, key: str = "task_id",
           unique: bool = False, limit: int | None = None) -> DataFrame:
    """Every request with ``code`` and ``message`` beside the record's columns.

    ``state`` holds one row per key. An unknown key is a 404 row whose record columns
    are NULL.
    """
    known = state.withColumn("_known", F.lit(True))
    return with_reply_code(lookup_join(requests, known, key, "left", unique, limit))


def with_reply_code(joined: DataFrame) -> DataFrame:
    """Turn the ``_known`` mark of a lookup into reply code and message."""
    found = F.col("_known").isNotNull()
    return joined.withColumns({
        "code": F.when(found, F.lit(S.OK_CODE)).otherwise(F.lit(S.NOT_FOUND_CODE)),
        "reply_message": F.when(~found, F.lit(S.NOT_FOUND_MESSAGE)),
    }).drop("_known")


def answer_documents(requests: DataFrame, documents: DataFrame, key: str = "task_id",
                     unique: bool = False, limit: int | None = None) -> DataFrame:
    """Every request with its task's result documents, one row per document.

    Only a not-found request has no document. A task has its first document (``part`` 0) once,
    so that the outer join, which finds the unknown requests, meets no skew on its side; further
    documents come by an inner join, which adaptive execution can split on either side.
    """
    known = documents.withColumn("_known", F.lit(True))
    first = lookup_join(requests, known.filter("part = 0"), key, "left", unique, limit)
    more = lookup_join(requests, known.filter("part > 0"), key, "inner", unique, limit)
    return with_reply_code(first.unionByName(more))


def known_requests(requests: DataFrame, tasks: DataFrame, key: str = "task_id",
                   unique: bool = False, limit: int | None = None) -> DataFrame:
    return lookup_join(requests, tasks.select(key).distinct(), key, "left_semi", unique, limit)


def unknown_requests(requests: DataFrame, tasks: DataFrame, key: str = "task_id",
                     unique: bool = False, limit: int | None = None) -> DataFrame:
    return lookup_join(requests, tasks.select(key).distinct(), key, "left_anti", unique, limit)


def state_as_of(polls: DataFrame, events: DataFrame, fields: list[str],
                key: str = "task_id", at: str = "at", order: str = "seq",
                limit: int | None = None) -> DataFrame:
    """The record as each poll saw it: per field the last value set up to the poll.

    ``at`` is an integral instant in both inputs. A poll sees the events of its own
    instant. One union and one window replace a range join.
    """
    timeline = polls.withColumn("_poll", F.lit(True)).unionByName(
        events.select(key, at, order, *fields).withColumn("_poll", F.lit(False)),
        allowMissingColumns=True,
    )
    in_time = [at, "_poll", order]
    seen = with_running(
        timeline, [key], in_time, [running_last(field, in_time) for field in fields], limit=limit
    )
    return seen.filter("_poll").drop("_poll", order)


def with_source(tasks: DataFrame, manifest: DataFrame, key: str,
                unique: bool = False, limit: int | None = None) -> DataFrame:
    """Tasks whose source file landed."""
    return known_requests(tasks, manifest, key, unique, limit)


def dangling_outputs(tasks: DataFrame, manifest: DataFrame, key: str,
                     unique: bool = False, limit: int | None = None) -> DataFrame:
    """Completed tasks that name an output although their source never landed."""
    completed = tasks.filter(F.col("status") == S.COMPLETED)
    return unknown_requests(completed, manifest, key, unique, limit)
