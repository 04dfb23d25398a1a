"""Names, markers and removal of files in any store that Spark can reach."""

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(context._jsc.hadoopConfiguration()), found


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it does not exist."""
    files, path = _opened(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def mark(spark: SparkSession, path: str) -> None:
    """An empty file; it is there at once or not at all."""
    files, found = _opened(spark, path)
    files.create(found, True).close()


def remove(spark: SparkSession, path: str) -> None:
    files, found = _opened(spark, path)
    files.delete(found, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written aside and renamed: it is there whole or not at all."""
    files, found = _opened(spark, path)
    aside = found.suffix("._new")
    out = files.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if files.exists(found):
        files.delete(found, False)
    files.rename(aside, found)


def read_text(spark: SparkSession, path: str) -> str:
    files, found = _opened(spark, path)
    stream = files.open(found)
    try:
        jvm = spark.sparkContext._jvm
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
