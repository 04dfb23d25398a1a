"""Detections of any number, stored in parts beside the state that names them.

A version is written whole, one folder of parts keyed by task and part. Its manifest, one slim row for each task,
goes into completion events: ``version, parts, total``. State merges, lookups and streams carry these numbers and no
detections. A task's result changes with its event, from one complete version to the next; versions that no state
names any more can be dropped. Writing a version again replaces it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstate.functions import documents

VERSION = "version"


def write_results(parts: DataFrame, path: str, version: int, key: str = "task_id") -> DataFrame:
    """Write assembled parts (``key, part, first_pos, detections``) as one version; its manifest.

    The manifest reads the part's numbers from what was written, not the detections.
    """
    folder = f"{path}/{VERSION}={version}"
    counted = parts.select(key, "part", "first_pos", F.size("detections").alias("held"), "detections")
    counted.write.mode("overwrite").parquet(folder)
    written = parts.sparkSession.read.schema(counted.schema).parquet(folder)
    return written.groupBy(key).agg(
        F.lit(version).cast("long").alias(VERSION), F.count(F.lit(1)).alias("parts"), F.sum("held").alias("total"))


def with_manifest(tasks: DataFrame, manifest: DataFrame, version: int, key: str = "task_id") -> DataFrame:
    """Finished tasks with their manifest; those without detections have a result of no parts."""
    return tasks.join(manifest, key, "left").withColumns({
        VERSION: F.coalesce(VERSION, F.lit(version)),
        "parts": F.coalesce("parts", F.lit(0)), "total": F.coalesce("total", F.lit(0)),
    })


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The parts of all versions."""
    return spark.read.parquet(path)


def served_documents(state: DataFrame, parts: DataFrame, key: str = "task_id") -> DataFrame:
    """The state's records, one row for each part of their result, ready for ``lookup.answer_documents``.

    ``result`` holds the part's detections, with ``part`` beside it. Records without a result, with one of no detections
    or with detections of their own have one row, part 0. A result that lacks stored parts stops the job.
    """
    others = [name for name in state.columns if name not in (key, "result")]
    head = F.col("result")
    stored = parts.select(F.col(key).alias("_of"), F.col(VERSION).alias("_version"), F.col("part").alias("_part"),
                          F.col("first_pos").alias("_first"), F.col("detections").alias("_detections"))
    match = (state[key] == stored["_of"]) & (state["result.version"] == stored["_version"])
    # first parts by an outer join, which meets no skew; others by an inner join, which can be split on either side
    both = state.join(stored.where("_part = 0"), match, "left").unionByName(
        state.join(stored.where("_part > 0"), match))
    kind = stored.schema["_detections"].dataType
    gone = F.raise_error(F.lit("the stored parts of a result are missing")).cast(kind)
    held = (
        F.when(head["version"].isNull(), head["detections"])
        .when((head["total"] > 0) & F.col("_part").isNull(), gone)
        .otherwise(F.coalesce("_detections", F.array().cast(kind)))
    )
    result = documents.with_part(head, held, F.coalesce("_part", F.lit(0)), F.coalesce("_first", F.lit(0)))
    return both.select(key, *others, F.when(head.isNotNull(), result).alias("result"),
                       F.coalesce("_part", F.lit(0)).alias("part"))


def incomplete(state: DataFrame, parts: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks whose stored parts are not as many, or hold not as many detections, as their result says."""
    named = state.where("result.version IS NOT NULL").select(
        key, F.col("result.version").alias(VERSION), F.col("result.parts").alias("parts"),
        F.col("result.total").alias("total"))
    found = parts.groupBy(key, VERSION).agg(F.count(F.lit(1)).alias("_parts"), F.sum("held").alias("_total"))
    both = named.join(found, [key, VERSION], "left")
    differ = (F.coalesce("_parts", F.lit(0)) != F.col("parts")) | (F.coalesce("_total", F.lit(0)) != F.col("total"))
    return both.where(differ).select(key, VERSION, "parts", "total", "_parts", "_total").withColumnsRenamed(
        {"_parts": "found_parts", "_total": "found_total"})
