"""Files listed by tasks, in batches and on streams."""

import os

from pyspark.sql import functions as F

from reelstate.sources import landing, listing
from reelstate.streaming import progress

ID = "123e4567-e89b-42d3-a456-42661417400"


def land(folder, name, size, at=1_700_000_000):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"x" * size)
    os.utime(path, (at, at))


def rows(df):
    return sorted((r.task_id or "", r.filename, r.length) for r in df.collect())


def test_all_files_are_listed_by_tasks(spark, tmp_path):
    """Empty files, nested folders and odd names; hidden files are none."""
    land(tmp_path, f"{ID}0_a_b.mp4", 3)
    land(tmp_path, f"day 1/{ID}1_empty.MOV", 0)
    land(tmp_path, f"day 1/deep/er/{ID}2_c.avi", 2)
    land(tmp_path, "day2/stray.txt", 1)
    land(tmp_path, "day2/_temporary", 9)
    land(tmp_path, "_hidden/x.mp4", 9)
    want = [("", "stray.txt", 1), (f"{ID}0", "a_b.mp4", 3), (f"{ID}1", "empty.MOV", 0), (f"{ID}2", "c.avi", 2)]
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        files = listing.list_files(spark, folder)
        assert rows(landing.to_manifest(files)) == want
        assert files.rdd.getNumPartitions() == 3  # the folder itself, and a task for each folder in it
        assert {r.path.startswith(folder) for r in files.collect()} == {True}
        assert {r.t for r in files.select(F.col("modificationTime").cast("long").alias("t")).collect()} == {1_700_000_000}
    assert landing.only_media(landing.to_manifest(listing.list_files(spark, str(tmp_path)))).count() == 3


def test_an_empty_folder_and_one_that_is_not_there(spark, tmp_path):
    assert listing.list_files(spark, str(tmp_path)).count() == 0
    assert listing.list_files(spark, str(tmp_path / "none")).count() == 0


def test_each_file_arrives_once(spark, tmp_path):
    """Three starts from one checkpoint; files come between, one of them with no bytes."""
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    for n, size in enumerate((3, 0, 5)):
        land(folder, f"{n % 2}/{ID}{n}_v.mp4", size, at=1_700_000_000 + n)
        if n == 2:  # changed just now: still settling
            land(folder, f"1/{ID}9_new.mp4", 1, at=4_000_000_000)
        files = landing.to_manifest(listing.stream_files(spark, str(folder), settle=0))
        # the first start's offset is now; files of later starts have to be newer
        os.utime(folder / f"{n % 2}/{ID}{n}_v.mp4")
        progress.append_stream(files.select("task_id", "filename", "length"), out, checkpoint).awaitTermination()
    assert rows(spark.read.parquet(out)) == [(f"{ID}{n}", "v.mp4", size) for n, size in enumerate((3, 0, 5))]
