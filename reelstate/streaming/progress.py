"""Stateless and lookup streams."""

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelstate.functions.progress import transfer_percent
from reelstate.operators.lookup import answer
from reelstate.sources.state_levels import IN_PUSHDOWN, POINTS

BATCH = "batch_id"


def percent_stream(transfers: DataFrame) -> DataFrame:
    """Upload percent per progress callback (``loaded``, ``total``)."""
    return transfers.withColumn("percent", transfer_percent(F.col("loaded"), F.col("total")))


def answer_stream(requests: DataFrame, state_now: Callable[[DataFrame], DataFrame], path: str,
                  checkpoint: str, key: str = "task_id", limit: int | None = None,
                  trigger: dict | None = None) -> StreamingQuery:
    """Answer the requests of a stream from the state at the time of each micro-batch.

    ``state_now`` is called with every batch and opens the state anew in the batch's session, what the batch asks for at
    least; a stream-static join would keep the files that were there when the stream started. Hot
    request keys are split as in batch lookups. A batch that is run again replaces its own answers.
    """

    def answer_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.conf.get(IN_PUSHDOWN)
        spark.conf.set(IN_PUSHDOWN, POINTS)  # so that requested keys reach the pages of the files
        try:
            answers = answer(batch, state_now(batch), key, limit=limit)
            answers.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
        finally:
            spark.conf.set(IN_PUSHDOWN, before)

    return (
        requests.writeStream.foreachBatch(answer_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BATCH)


def append_stream(df: DataFrame, path: str, checkpoint: str,
                  trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to parquet, exactly once."""
    return (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
