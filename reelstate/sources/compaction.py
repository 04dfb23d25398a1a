"""Few files for days of many batches: a day's batches rewritten as one, behind one switch.

A compaction writes the rows of a day's batches again, under a batch of its own in the same day, and then a marker that names what
it replaced. Readers (``event_log.read_events``) go by the newest marker: before it the compacted batch does not
count, after it the replaced ones do not; a reader keeps what it saw when it was made. Replaced batches are removed
``KEEP`` compactions later. One that fails leaves rows that no marker names, and the next one writes over them.

Streams from the log leave compacted batches out: they have read the batches themselves. They may lag ``KEEP`` compactions behind.
"""

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstate.sources import files

MARKS = "_compactions"
PREFIX = "compact-"
KEEP = 4
#: Days with more batches than this are compacted.
MOST_BATCHES = 32


def _state(spark: SparkSession, path: str) -> dict:
    """What the newest marker says: its number, and the replaced batches, each with the compaction that did it."""
    marks = files.names(spark, f"{path}/{MARKS}")
    if not marks:
        return {"number": 0, "replaced": []}
    return json.loads(files.read_text(spark, f"{path}/{MARKS}/{marks[-1]}"))


def visible(spark: SparkSession, path: str, day: str, batch: str) -> Column:
    """Whether a reader made now sees a batch: a condition on partition columns."""
    now = _state(spark, path)
    # only compactions with a marker count
    later = F.col(batch).startswith(PREFIX) & (
        F.try_to_number(F.substring(F.col(batch), len(PREFIX) + 1, 12), F.lit("999999999999")) > now["number"])
    seen = ~F.coalesce(later, F.lit(False))
    if now["replaced"]:
        place = F.concat_ws("/", F.col(day).cast("string"), F.col(batch))
        seen = seen & ~place.isin(*[f"{d}/{b}" for d, b, _ in now["replaced"]])
    return seen


def batches(spark: SparkSession, path: str, day: str, batch: str) -> dict[str, list[str]]:
    """The batches of each day that a reader sees, from the folders' names."""
    now = _state(spark, path)
    gone = {(d, b) for d, b, _ in now["replaced"]}
    found = {}
    for folder in files.names(spark, path):
        if not folder.startswith(f"{day}="):
            continue
        own = folder.removeprefix(f"{day}=")
        names = [n.removeprefix(f"{batch}=") for n in files.names(spark, f"{path}/{folder}") if n.startswith(f"{batch}=")]
        live = [n for n in names if (own, n) not in gone
                and not (n.startswith(PREFIX) and int(n.removeprefix(PREFIX)) > now["number"])]
        if live:
            found[own] = live
    return found


def compact(rows: DataFrame, path: str, day: str, batch: str, most: int = MOST_BATCHES,
            keep: int = KEEP) -> list[str]:
    """Compact the days with more than ``most`` batches; ``rows`` is the log with its day and batch columns.

    One writer at a time; others may append meanwhile, and what they add is left for the next compaction.
    """
    spark = rows.sparkSession
    now = _state(spark, path)
    days = {d: names for d, names in batches(spark, path, day, batch).items() if len(names) > most}
    if not days:
        return []
    number = now["number"] + 1
    name = f"{PREFIX}{number:012d}"
    places = [(d, b) for d, names in days.items() for b in names]
    place = F.concat_ws("/", F.col(day).cast("string"), F.col(batch))
    chosen = rows.where(F.col(day).cast("string").isin(*days)).where(place.isin(*[f"{d}/{b}" for d, b in places]))
    (
        chosen.withColumn(batch, F.lit(name)).hint("rebalance", day)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(day, batch).parquet(path)
    )
    old = [(d, b, n) for d, b, n in now["replaced"] if n <= number - keep]
    left = [(d, b, n) for d, b, n in now["replaced"] if n > number - keep]
    text = json.dumps({"number": number, "replaced": left + old + [(d, b, number) for d, b in places]})
    files.write_text(spark, f"{path}/{MARKS}/{number:012d}", text)
    for d, b, _ in old:
        files.remove(spark, f"{path}/{day}={d}/{batch}={b}")
    if old:  # they are gone: the marker need not name them any more
        text = json.dumps({"number": number, "replaced": left + [(d, b, number) for d, b in places]})
        files.write_text(spark, f"{path}/{MARKS}/{number:012d}", text)
    for mark in files.names(spark, f"{path}/{MARKS}")[:-keep]:
        files.remove(spark, f"{path}/{MARKS}/{mark}")
    return sorted(days)
