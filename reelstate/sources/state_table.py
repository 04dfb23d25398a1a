"""The stored state table, laid out for lookups."""

from pyspark.sql import DataFrame


def write_state_table(state: DataFrame, name: str, buckets: int, key: str = "task_id",
                      path: str | None = None) -> None:
    """Save state as a catalog table bucketed and sorted by key.

    A lookup against it shuffles the requests only; the table, the large side, stays
    where it is. Choose ``buckets`` so that one bucket fits a task, a few hundred
    megabytes each.
    """
    writer = (
        state.repartition(buckets, key).write.mode("overwrite")
        .bucketBy(buckets, key).sortBy(key)
    )
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
