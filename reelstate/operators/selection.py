"""Order and first-of-group."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of_selection(files: DataFrame, selection: str, position: str) -> DataFrame:
    """The first file of each selection; the rank filter cuts rows before the shuffle."""
    first = W.partitionBy(selection).orderBy(position)
    return files.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def in_display_order(flat: DataFrame, key: str = "task_id") -> DataFrame:
    """Rows by task and array position, for the sink only: a range-partitioned sort."""
    return flat.orderBy(key, "pos")
