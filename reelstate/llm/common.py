"""Helpers that the operators of this package share."""

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelstate.session import scratch_path

#: Java pattern of the white space between words.
SPACE = r"[\x20\x09-\x0D]+"
#: Java pattern of what parts the words of a lower-cased text: all of ASCII but digits and letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole(text: str | Column) -> Column:
    """A text column with empty text for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def release() -> None:
    """Gives memory that this process no longer uses back to the machine.

    Python workers live on between tasks, beside the executor's own memory.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(work):
    """``work`` on Arrow batches or tables, with ``release`` at its end."""
    if inspect.isgeneratorfunction(work):
        @functools.wraps(work)
        def run(batches):
            yield from work(batches)
            release()
    else:
        @functools.wraps(work)
        def run(*tables):
            out = work(*tables)
            release()
            return out
        run.__signature__ = inspect.signature(work)
    return run


def packed(df: DataFrame) -> Column:
    """All columns as one, so that none of them clashes with what an operator adds."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def unpacked(df: DataFrame, row: str, columns: list[str], **replaced: Column) -> DataFrame:
    """The columns that ``packed`` took, some of them replaced."""
    return df.select(*[replaced.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in columns])


def same(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    """Join condition: the named columns are equal, null to null."""
    found = None
    for a, b in names.items():
        one = left[a].eqNullSafe(right[b])
        found = one if found is None else found & one
    return found


def with_arrow_columns(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    added: T.StructType,
) -> DataFrame:
    """``df`` with the columns that ``work`` computes from each Arrow batch.

    Columns of ``df`` that have the name of an added one are replaced, as ``withColumn`` does.
    """
    new = {field.name.lower() for field in added.fields}
    kept = [field for field in df.schema.fields if field.name.lower() not in new]
    names = [field.name for field in kept]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = work(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in names] + [found[f.name] for f in added.fields],
                names=names + [f.name for f in added.fields],
            )

    return df.mapInArrow(run, T.StructType(kept + added.fields))
