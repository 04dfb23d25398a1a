"""Uploaded files as a manifest."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstate.functions import text
from reelstate.schemas import MEDIA_EXTENSIONS

BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def read_landing(spark: SparkSession, folder: str, glob: str | None = None,
                 recursive: bool = False) -> DataFrame:
    """``task_id, filename, path, length, modificationTime`` of the files in a folder.

    Only file metadata is read: ``content`` is pruned before any bytes move. Files not
    named ``{task_id}_{filename}`` have a NULL task id. Spark's file sources do not list
    empty files; ``to_manifest`` over an inventory keeps them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return to_manifest(reader.load(folder))


def stream_landing(spark: SparkSession, folder: str, glob: str | None = None,
                   files_per_batch: int = 100_000, archive: str | None = None,
                   max_age: str | None = None) -> DataFrame:
    """The manifest as a stream; each file arrives once.

    The folder is listed anew for every batch: ``archive`` moves files that were taken to
    another folder, and ``max_age`` (as ``7d``) leaves older ones out of the bookkeeping.
    """
    reader = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE)
        .option("maxFilesPerTrigger", files_per_batch)
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if max_age:
        reader = reader.option("maxFileAge", max_age)
    return to_manifest(reader.load(folder))


def to_manifest(files: DataFrame) -> DataFrame:
    """The manifest of file facts: ``path, length, modificationTime``.

    They may also come from an inventory table, which lists empty files too and spares the
    driver a listing of the folder.
    """
    name = text.basename(F.col("path"))
    return files.select(
        text.stored_task_id(name).alias("task_id"),
        text.stored_filename(name).alias("filename"),
        "path", "length", "modificationTime",
    )


def only_media(manifest: DataFrame, filename: str = "filename",
               extensions: tuple[str, ...] = MEDIA_EXTENSIONS) -> DataFrame:
    """Files with a video extension, in either case (a path glob would miss ``.MP4``)."""
    return manifest.filter(text.extension(F.col(filename)).isin(*extensions))
