"""A keyed table that grows by batches of merged rows: hash buckets, each with parts in levels.

A key belongs to one of ``buckets``. Batch number ``t`` writes a part ``bucket=b/level=l/until=t`` for each bucket
that it touches. Every ``fan`` batches a bucket's parts of level 0 are merged into one of level 1, every ``fan`` squared
its parts of levels 0 and 1 into one of level 2, and so on; the last level takes in its own part too. Buckets take their
turns one after the other, so that a batch merges a share of them and no merge takes the whole table. A row is written
about once for each level until it reaches the last, and a bucket has at most ``fan * levels`` live parts.

When a part is merged away follows from its bucket, level and batch, so a reader needs no list of parts: the number of
the last batch, in the name of a marker, tells which parts are live, and that is a filter on partition columns. The
marker is written last; a batch that failed before is written again over its own parts, one that comes again after it is left
out by its id. Parts go ``keep`` batches after their merge, and a reader has that long. A table has one writer.

A row holds for each field its value and the ``order`` value that set it. The merge of merges is again a merge.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstate.sources import files

COMMITS = "_commits"
PLACE = ["bucket", "level", "until"]
# Requested keys that are looked up one by one in a file's pages; more are found by reading their buckets.
POINTS = 1_000
IN_PUSHDOWN = "spark.sql.parquet.pushdown.inFilterThreshold"


@dataclass(frozen=True)
class Layout:
    """How a table is cut; it stays what it was when the table was begun."""

    buckets: int = 64
    fan: int = 8
    levels: int = 4
    keep: int = 8

    def turn(self, bucket: Column) -> Column:
        return bucket % self.fan ** self.levels

    def merged_at(self, bucket: Column, level: Column, until: Column) -> Column:
        """Number of the batch that merges a part away."""
        turn = self.turn(bucket)
        period = F.lit(self.fan ** self.levels)
        for number in reversed(range(self.levels - 1)):
            period = F.when(level == number, F.lit(self.fan ** (number + 1))).otherwise(period)
        return (F.floor((until + 1 + turn) / period) + 1) * period - 1 - turn

    def level_at(self, bucket: Column, batch: int) -> Column:
        """The level of the part that a batch writes into a bucket."""
        level = F.lit(0)
        for number in range(1, self.levels + 1):
            due = (F.lit(batch + 1) + self.turn(bucket)) % self.fan ** number == 0
            level = F.when(due, F.lit(number)).otherwise(level)
        return level

    def due(self, batch: int) -> dict[int, int]:
        """Buckets that a batch merges, and the level that they reach."""
        found = {}
        for bucket in range(self.buckets):
            count = batch + 1 + bucket % self.fan ** self.levels
            level = max((n for n in range(1, self.levels + 1) if count % self.fan ** n == 0), default=0)
            if level:
                found[bucket] = level
        return found


@dataclass(frozen=True)
class Commit:
    """The last batch of a table: its number, the id its writer gave it, and the table's layout."""

    number: int
    batch_id: int
    layout: Layout

    @property
    def name(self) -> str:
        part = self.layout
        return f"{self.number:012d}_{self.batch_id}_{part.buckets}_{part.fan}_{part.levels}_{part.keep}"

    @classmethod
    def last(cls, spark: SparkSession, table: str) -> "Commit | None":
        marks = files.names(spark, f"{table}/{COMMITS}")
        if not marks:
            return None
        number, batch_id, *layout = (int(x) for x in marks[-1].split("_"))
        return cls(number, batch_id, Layout(*layout))


def bucket_of(key: str, layout: Layout) -> Column:
    # by its text, so that a key hashes alike whatever integer type it has
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(layout.buckets)).cast("int")


# --- merging -------------------------------------------------------------------------


def merge_events(events: DataFrame, fields: Sequence[str], key: str = "task_id",
                 order: str = "seq") -> DataFrame:
    """The rows that events add to a table."""
    return events.groupBy(key).agg(*merged_fields(fields, order, events=True))


def merged_fields(fields: Sequence[str], order: str, events: bool = False) -> list[Column]:
    """Aggregates that merge events, or rows that are merges already."""
    merged = []
    for field in fields:
        at = F.when(F.col(field).isNotNull(), F.col(order)) if events else F.col(f"{field}_{order}")
        merged += [F.max_by(field, at).alias(field), F.max(at).alias(f"{field}_{order}")]
    last = order if events else f"last_{order}"
    return merged + [F.max(last).alias(f"last_{order}")]


# --- writing -------------------------------------------------------------------------


def store_batch(rows: DataFrame, table: str, batch_id: int, fields: Sequence[str], key: str = "task_id",
                order: str = "seq", layout: Layout | None = None, drop: str | None = None) -> None:
    """Add the merged rows of a batch; ids of batches grow, and one that is in the table is left out.

    Rows that ``drop`` holds for go once they reach the last level, where no older part can hold their key.
    """
    spark = rows.sparkSession
    last = Commit.last(spark, table)
    if last and batch_id <= last.batch_id:
        return
    layout = last.layout if last else layout or Layout()
    number = last.number + 1 if last else 0
    merged = rows.withColumn("bucket", bucket_of(key, layout))
    old = _parts(spark, table, layout, set(layout.due(number)))
    if old is None:  # nothing to merge with: the rows are merged already
        merged = merged.repartition("bucket")
    else:
        place = [F.col(name) for name in PLACE]
        leaving = old.where((F.col("until") < number) & (layout.merged_at(*place) == number))
        both = merged.unionByName(leaving.drop("level", "until"))
        merged = both.repartition("bucket").groupBy("bucket", key).agg(*merged_fields(fields, order))
    merged = merged.withColumns({"level": layout.level_at(F.col("bucket"), number), "until": F.lit(number)})
    if drop:
        merged = merged.where(f"level < {layout.levels} OR NOT coalesce({drop}, false)")
    (
        merged.sortWithinPartitions(*PLACE, key)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PLACE).parquet(table)
    )
    files.mark(spark, f"{table}/{COMMITS}/{Commit(number, batch_id, layout).name}")
    _clean(spark, table, layout, number - layout.keep)


def _clean(spark: SparkSession, table: str, layout: Layout, number: int) -> None:
    """Drop the parts that batch ``number`` merged away, and the markers up to it."""
    for bucket, level in layout.due(number).items() if number >= 0 else ():
        turn, top = bucket % layout.fan ** layout.levels, layout.levels
        for below in range(top + 1 if level == top else level):
            period = layout.fan ** min(below + 1, top)
            folder = f"{table}/bucket={bucket}/level={below}"
            for name in files.names(spark, folder):
                until = int(name.removeprefix("until="))
                if ((until + 1 + turn) // period + 1) * period - 1 - turn <= number:
                    files.remove(spark, f"{folder}/{name}")
    for name in files.names(spark, f"{table}/{COMMITS}"):
        if int(name.split("_")[0]) <= number:
            files.remove(spark, f"{table}/{COMMITS}/{name}")


# --- reading -------------------------------------------------------------------------


def _parts(spark: SparkSession, table: str, layout: Layout, buckets: set[int]) -> DataFrame | None:
    """All parts in these buckets, None without any."""
    there = {n for n in files.names(spark, table) if n.startswith("bucket=")}
    paths = sorted(there & {f"bucket={bucket}" for bucket in buckets})
    if not paths:
        return None
    return spark.read.option("basePath", table).parquet(*[f"{table}/{path}" for path in paths])


def read_state(spark: SparkSession, table: str, fields: Sequence[str], key: str = "task_id",
               order: str = "seq", asked: DataFrame | None = None) -> DataFrame:
    """The table as of its last batch: one row for each key.

    With ``asked``, a DataFrame of keys, only what may hold them is read: the buckets of its keys and, up to ``POINTS``
    rows, the pages of their files that the keys fall into. Other keys may be among the rows.
    """
    last = Commit.last(spark, table)
    if last is None:
        raise ValueError(f"no state in {table} yet")
    layout, points, buckets = last.layout, None, set(range(last.layout.buckets))
    if asked is not None:
        wanted = asked.select(key, bucket_of(key, layout).alias("_bucket")).where(F.col(key).isNotNull())
        some = wanted.limit(POINTS + 1).collect()
        if len(some) <= POINTS:
            points, buckets = sorted({k for k, _ in some}), {b for _, b in some}
        elif layout.buckets > POINTS:  # else so many rows are in nearly all buckets
            buckets = {b for b, in wanted.select("_bucket").distinct().collect()}
    parts = _parts(spark, table, layout, buckets)
    if parts is None:  # none of the keys has a bucket with rows
        parts, points = _parts(spark, table, layout, set(range(layout.buckets))), []
    live = (F.col("until") <= last.number) & (
        layout.merged_at(*[F.col(name) for name in PLACE]) > last.number)
    parts = parts.where(live)
    if points is not None:
        parts = parts.where(F.col(key).isin(points) if points else F.lit(False))
    return parts.groupBy(key).agg(*merged_fields(fields, order))
