"""Session settings and the shared scratch folder."""

import atexit
import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reelstate")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local master without the setting gets one temporary folder per process. A cluster
    without it is an error: executors do not share a machine-local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _temporary_root()


@functools.cache
def _temporary_root() -> str:
    return tempfile.mkdtemp(prefix="reelstate-")


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder, never used before.

    What is written there goes when this process ends.
    """
    path = f"{scratch_root(spark)}/{purpose}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended first
        context = spark.sparkContext
        found = context._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(context._jsc.hadoopConfiguration()).delete(found, True)
