"""Exact ways around hot keys.

A key is hot when it has more than ``limit`` rows. Key counts combine map-side and move one slim row
per key; whether any key is hot is known before the plan is made, so that without one the plain plan
is the whole plan. The set of hot keys is written down where there is one: Spark then knows its size and
broadcasts it only if it is small.

The split only chooses a plan. Results are the same for every limit.
"""

import math
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelstate.session import scratch_path

# Rows of one key that a single task may take.
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: list[str], limit: int | None = None, nulls: bool = False) -> DataFrame:
    """Keys with more than ``limit`` rows, with the number of their rows as ``_hot``; with ``nulls`` NULL keys too."""
    counted = df if nulls else df.filter(_not_null(keys))
    counted = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hot"))
    return counted.filter(F.col("_hot") > (limit or HOT_ROWS))


def found_hot(df: DataFrame, keys: list[str], limit: int | None,
              nulls: bool = False) -> tuple[DataFrame | None, int]:
    """The hot keys of ``df``, written down, and their rows together; None without any."""
    hot = hot_keys(df, keys, limit, nulls)
    rows = hot.agg(F.sum("_hot")).first()[0]
    return (_written(hot, "hot-keys"), rows) if rows else (None, 0)


def _written(df: DataFrame, purpose: str) -> DataFrame:
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _not_null(keys: list[str]) -> Column:
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return present


def split_hot(df: DataFrame, keys: list[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(cold, hot)`` rows of ``df``; hot rows carry ``_hot``."""
    marked = _null_safe(df, hot, keys, "left").select(*df.columns, "_hot")
    return marked.filter("_hot IS NULL").drop("_hot"), marked.filter("_hot IS NOT NULL")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which NULL keys meet."""
    named = right.withColumnsRenamed({key: f"_of_{key}" for key in keys})
    match = F.lit(True)
    for key in keys:
        match = match & left[key].eqNullSafe(named[f"_of_{key}"])
    return left.join(named, match, how).drop(*[f"_of_{key}" for key in keys])


def in_pieces(hot: DataFrame, keys: list[str], order: list[str], rows: int,
              limit: int | None = None) -> DataFrame:
    """Hot rows cut into ``_piece``s of about ``limit`` rows, in the order of keys and ``order``.

    The cuts are quantiles of the rows themselves over all of ``order``: values that crowd, or
    that are equal in its first columns, are cut all the same. The cut rows are written down, so
    that every reader sees the same pieces.
    """
    pieces = math.ceil(rows / (limit or HOT_ROWS)) + 1
    ranged = hot.drop("_hot").repartitionByRange(pieces, *keys, *order)
    return _written(ranged.withColumn("_piece", F.spark_partition_id()), "hot-rows")


# --- running columns -----------------------------------------------------------------


@dataclass(frozen=True)
class Running:
    """A column that runs down an ordered group, computed within a block and then shifted.

    ``local`` runs over one window; ``total`` aggregates a block; ``carry`` folds the
    totals of the blocks before; ``merge`` joins the carried and the local value.
    """

    name: str
    local: Callable[[WindowSpec], Column]
    total: Column
    carry: Callable[[WindowSpec, Column], Column]
    merge: Callable[[Column, Column], Column]


def running_last(field: str, order: list[str]) -> Running:
    """The latest non-NULL value of ``field`` up to the row."""
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return Running(
        name=field,
        local=lambda rows: F.last(field, ignorenulls=True).over(rows),
        total=F.max_by(field, F.when(F.col(field).isNotNull(), rank)),
        carry=lambda before, total: F.last(total, ignorenulls=True).over(before),
        merge=lambda carried, local: F.coalesce(local, carried),
    )


def running_sum(name: str, amount: Column) -> Running:
    """Sum of ``amount`` up to the row."""
    return Running(
        name=name,
        local=lambda rows: F.sum(amount).over(rows),
        total=F.sum(amount),
        carry=lambda before, total: F.sum(total).over(before),
        merge=lambda carried, local: local + F.coalesce(carried, F.lit(0)),
    )


def running_position(name: str) -> Running:
    """Number of rows up to and with the row."""
    return running_sum(name, F.lit(1).cast("long"))


def with_running(df: DataFrame, keys: list[str], order: list[str], columns: list[Running],
                 limit: int | None = None) -> DataFrame:
    """Add running columns over ``keys`` in ``order``, which should be unique within a key.

    The rows of a piece of a hot key are sorted in one task, and the totals of its pieces, of
    which there are ``rows / limit``, in another, so no task sees a hot key whole. Rows with a NULL
    key are one group, and are split as others are.
    """
    rows = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    found, many = found_hot(df, keys, limit, nulls=True)
    if found is None:
        return df.withColumns({c.name: c.local(rows) for c in columns})
    cold, hot = split_hot(df, keys, found)
    cold = cold.withColumns({c.name: c.local(rows) for c in columns})
    hot = in_pieces(hot, keys, order, many, limit)
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        hot.groupBy(*keys, "_piece")
        .agg(*[c.total.alias(f"_total_{c.name}") for c in columns])
        .select(*keys, "_piece", *[
            c.carry(before, F.col(f"_total_{c.name}")).alias(f"_carried_{c.name}") for c in columns
        ])
    )
    inside = W.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    local = hot.withColumns({f"_local_{c.name}": c.local(inside) for c in columns})
    hot = (
        _null_safe(local, carried, [*keys, "_piece"], "inner")
        .withColumns({
            c.name: c.merge(F.col(f"_carried_{c.name}"), F.col(f"_local_{c.name}"))
            for c in columns
        })
    )
    return cold.unionByName(hot.select(*cold.columns))


# --- lookups -------------------------------------------------------------------------


def lookup_join(requests: DataFrame, table: DataFrame, key: str, how: str,
                unique: bool = False, limit: int | None = None) -> DataFrame:
    """Join requests to a table of keyed rows (left, inner, semi or anti).

    The table should hold a key at most a few times, unless the join is inner.
    ``unique`` says that no two requests share a key: then none is hot, and the plain
    join is the whole plan.

    Hot request keys are salted: their rows spread over as many copies of the table row
    as the key has pieces. The salt is a hash of the whole request, so a replay repeats
    it; a request id among the columns tells requests of one key apart.
    """
    found = None if unique else found_hot(requests, [key], limit)[0]
    if found is None:
        return requests.join(table, key, how)
    pieces = found.withColumn("_hot", F.ceil(F.col("_hot") / (limit or HOT_ROWS)))
    cold, hot = split_hot(requests, [key], pieces)
    salt = F.pmod(F.xxhash64(*requests.columns), F.col("_hot"))
    salted = hot.withColumn("_salt", salt).drop("_hot")
    copies = (
        table.join(pieces, key)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_hot") - 1)))
        .drop("_hot")
    )
    plain = cold.join(table, key, how)
    return plain.unionByName(salted.join(copies, [key, "_salt"], how).select(*plain.columns))
