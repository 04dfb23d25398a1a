"""Files of a landing folder, listed by tasks: a data source for batches and streams.

The driver lists the folder's own entries; each sub-folder, as uploads by day or by prefix, is listed by a task of its own. Empty files are
rows like others. Rows are ``path, modificationTime, length``, as ``landing.to_manifest`` takes them.

As a stream, offsets are instants: a batch has the files that were changed after the last batch and at least ``settle`` seconds
ago, so that a file is neither taken half nor twice. A file that turns up with an older time than that is not seen: move files
in with the time of their arrival.
"""

import datetime as dt
import sys
import time
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "landing"
FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT"
MICROSECOND = dt.timedelta(microseconds=1)
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


class Folder(InputPartition):
    """The folder ``below`` a root, and the microseconds that its files' times lie in: above the first, up to the second."""

    def __init__(self, root: str, below: str, after: int, until: int):
        self.root, self.below, self.after, self.until = root, below, after, until


def opened(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def folders(path: str, after: int, until: int) -> list[Folder]:
    """The folder itself and its sub-folders; names with a leading dot or underscore are left out."""
    from pyarrow import fs

    files, inner = opened(path)
    found = files.get_file_info(fs.FileSelector(inner, recursive=False, allow_not_found=True))
    below = [info.base_name for info in found
             if info.type == fs.FileType.Directory and info.base_name[0] not in "._"]
    return [Folder(path, name, after, until) for name in ("", *sorted(below))]


def listed(folder: Folder) -> Iterator[tuple]:
    from pyarrow import fs

    files, inner = opened(folder.root)
    inner = inner.rstrip("/")
    start = f"{inner}/{folder.below}" if folder.below else inner
    for info in files.get_file_info(fs.FileSelector(start, recursive=bool(folder.below), allow_not_found=True)):
        if info.type != fs.FileType.File or info.base_name[0] in "._":
            continue
        at = info.mtime_ns // 1000
        if folder.after < at <= folder.until:
            yield f"{folder.root.rstrip('/')}/{info.path[len(inner) + 1:]}", EPOCH + at * MICROSECOND, info.size


class Listing(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Folder]:
        return folders(self.path, -1, (1 << 63) - 1)

    def read(self, partition: Folder) -> Iterator[tuple]:
        return listed(partition)


class Arrivals(DataSourceStreamReader):
    def __init__(self, path: str, settle: float):
        self.path, self.settle = path, settle

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": int((time.time() - self.settle) * 1_000_000)}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return folders(self.path, start["until"], end["until"])

    def read(self, partition: Folder) -> Iterator[tuple]:
        return listed(partition)

    def commit(self, end: dict) -> None:
        pass


class Landing(DataSource):
    """``option("path", …)``; for streams also ``option("settle", seconds)``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> Listing:
        return Listing(self.options["path"])

    def streamReader(self, schema) -> Arrivals:
        return Arrivals(self.options["path"], float(self.options.get("settle", 2)))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, modificationTime, length`` of all files below a folder."""
    spark.dataSource.register(Landing)
    return spark.read.format(NAME).option("path", folder).load()


def stream_files(spark: SparkSession, folder: str, settle: float = 2) -> DataFrame:
    """The same as a stream; each file once."""
    spark.dataSource.register(Landing)
    return spark.readStream.format(NAME).option("path", folder).option("settle", settle).load()
