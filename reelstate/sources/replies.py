"""JSON replies, read and written."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstate.functions import documents
from reelstate.schemas import REPLY


def read_replies(spark: SparkSession, path: str, schema=REPLY) -> DataFrame:
    """One JSON reply per line, with the declared schema."""
    return spark.read.schema(schema).json(path)


def parse_replies(messages: DataFrame, column: str = "value") -> DataFrame:
    """A text column of replies to ``code, message, data`` beside the other columns."""
    others = [name for name in messages.columns if name != column]
    parsed = messages.select(*others, documents.parse_reply(F.col(column)).alias("_reply"))
    return parsed.select(*others, "_reply.*")


def reply_messages(replies: DataFrame, key: str = "task_id") -> DataFrame:
    """``key, value`` text columns, the shape that file and message-bus sinks take."""
    return replies.select(
        F.col(key).cast("string").alias("key"),
        documents.compact_json(F.col("reply")).alias("value"),
    )


def write_replies(replies: DataFrame, path: str, key: str = "task_id", compression: str = "gzip") -> None:
    """One compact JSON line per reply, in compressed files that ``read_replies`` and other readers of text open as such.

    Keys and repeated values are most of a reply: its files take a tenth of the text or less. A file is one task's work
    to read, as it was to write. ``compression`` "none" writes plain text.
    """
    reply_messages(replies, key).select("value").write.text(path, compression=compression)
