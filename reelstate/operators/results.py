"""Detection results: flat rows and nested documents.

A document holds at most ``part_size`` detections. A task with more gets several
documents, numbered by ``part``, so no task or row ever takes an unbounded group.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelstate.functions import documents
from reelstate.functions.parsing import confidence_parts, media_seconds
from reelstate.operators.skew import running_position, with_running

PART_SIZE = 10_000
DETECTION_FIELDS = ("timestamp", "horse_id", "person_name", "confidence")


def with_positions(detections: DataFrame, order: list[str], key: str = "task_id",
                   limit: int | None = None) -> DataFrame:
    """Number the detections of each task from 0 in ``order``, as ``pos``."""
    numbered = with_running(
        detections, [key], order, [running_position("_row")], limit
    )
    return numbered.withColumn("pos", F.col("_row") - 1).drop("_row")


def assemble_results(detections: DataFrame, key: str = "task_id",
                     part_size: int = PART_SIZE) -> DataFrame:
    """Flat detections to ``(task, part, first_pos, detections)``, the array in ``pos`` order.

    ``pos`` is dense from 0; a part says where it starts, so readers need no part size.
    """
    record = documents.detection(*[F.col(name) for name in DETECTION_FIELDS])
    ordered = F.sort_array(F.collect_list(F.struct("pos", record.alias("detection"))))
    return (
        detections.withColumn("part", F.expr(f"pos div {part_size}"))
        .groupBy(key, "part")
        .agg(F.min("pos").alias("first_pos"), ordered.alias("_ordered"))
        .select(key, "part", "first_pos", F.col("_ordered.detection").alias("detections"))
    )


def flatten_results(results: DataFrame, keep: list[str], keep_empty: bool = False) -> DataFrame:
    """One row per detection, with its position in the whole result.

    ``results`` has assembled documents, or a column ``result`` as states and replies have
    it; without ``first_pos`` every document is a whole result. The plain form drops documents without detections; ``keep_empty`` keeps them as one
    row of NULLs.
    """
    explode = F.posexplode_outer if keep_empty else F.posexplode
    inside = "result." if "result" in results.columns else ""
    whole = not inside and "first_pos" not in results.columns
    first = F.lit(0) if whole else F.col(f"{inside}first_pos")
    flat = results.select(
        *keep, first.alias("_first"),
        explode(f"{inside}detections").alias("_pos", "_detection"),
    )
    position = F.coalesce(F.col("_first"), F.lit(0)) + F.col("_pos")
    return flat.select(
        *keep,
        position.cast("long").alias("pos"),
        *[F.col(f"_detection.{name}").alias(name) for name in DETECTION_FIELDS],
    )


def typed_detections(flat: DataFrame) -> DataFrame:
    """Add seconds and the two confidence decimals beside the raw text."""
    first, second = confidence_parts(F.col("confidence"))
    return flat.withColumns({
        "offset_seconds": media_seconds(F.col("timestamp")), "conf_1": first, "conf_2": second,
    })


def detection_table(flat: DataFrame, key: str = "task_id") -> DataFrame:
    """The columns of the detection table; ``pos`` carries the row order."""
    return flat.select(key, "pos", *DETECTION_FIELDS)


def result_metadata(state: DataFrame, key: str = "task_id") -> DataFrame:
    """File name and completion time of a result, the rest of the document unread."""
    return state.select(key, "result.filename", "result.processed_at")
