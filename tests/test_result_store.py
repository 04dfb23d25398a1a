"""Results of any size through state, streams and replies."""

import pytest
from pyspark.sql import functions as F

from reelstate.operators import lookup, records, results, state
from reelstate.sources import result_store
from reelstate.sources.state_levels import Layout, merge_events, read_state, store_batch

FLAT = ("task_id STRING, pos BIGINT, timestamp STRING, horse_id STRING, person_name STRING, confidence STRING")


def flat(spark, counts, mark="H"):
    rows = [(task, n, f"00:{n:02}", mark, "p", "0.9_0.8") for task, many in counts.items() for n in range(many)]
    return spark.createDataFrame(rows, FLAT)


def finished(spark, path, counts, version, mark="H", part_size=2):
    """Parts of some tasks, written, and the events that complete the tasks."""
    parts = results.assemble_results(flat(spark, counts, mark), part_size=part_size)
    manifest = result_store.write_results(parts, path, version)
    tasks = spark.createDataFrame([(t, f"{t}.mp4", "00:30", "1x1") for t in counts],
                                  "task_id STRING, filename STRING, duration STRING, resolution STRING")
    done = records.completions(result_store.with_manifest(tasks, manifest, version), "http://x",
                               F.lit("2026-03-06 14:00:00").cast("timestamp"))
    done = done.withColumn("seq", F.lit(version).cast("long"))
    return spark.createDataFrame(done.collect(), done.schema)  # as a log has them


def served(spark, current, path, asked=("a", "b", "c", "nobody")):
    documents = result_store.served_documents(current, result_store.read_results(spark, path))
    requests = spark.createDataFrame([(x,) for x in asked], "task_id STRING")
    answers = lookup.answer_documents(requests, documents)
    found = results.flatten_results(answers, ["task_id", "code"], keep_empty=True)
    return sorted((r.task_id, r.code, -1 if r.pos is None else r.pos, r.horse_id or "") for r in found.collect())


def rows(counts, mark="H"):
    return [(t, 200, n, mark) for t, many in counts.items() for n in range(many)] + [
        (t, 200, -1, "") for t, many in counts.items() if not many]


NOBODY = ("nobody", 404, -1, "")
COUNTS = {"a": 5, "b": 1, "c": 0}


def test_no_detection_is_lost(spark, tmp_path):
    """Three parts, one, and none; state rows hold the numbers alone."""
    path = str(tmp_path / "results")
    events = finished(spark, path, COUNTS, 7)
    assert events.count() == 3
    merged = state.merged_state(events, ["status", "result"]).drop("last_seq")
    heads = {r.task_id: (r.result.version, r.result.parts, r.result.total, r.result.detections)
             for r in merged.collect()}
    assert heads == {"a": (7, 3, 5, None), "b": (7, 1, 1, None), "c": (7, 0, 0, None)}
    assert served(spark, merged, path) == sorted([*rows(COUNTS), NOBODY])
    assert result_store.incomplete(merged, result_store.read_results(spark, path)).count() == 0


def test_results_change_at_once(spark, tmp_path):
    """Parts of a new version are written; until its event is there, the old one is served whole."""
    path = str(tmp_path / "results")
    first = finished(spark, path, COUNTS, 1)
    second = finished(spark, path, {"a": 7, "b": 3}, 2, "N")
    merged = state.merged_state(first, ["status", "result"]).drop("last_seq")
    assert served(spark, merged, path) == sorted([*rows(COUNTS), NOBODY])
    merged = state.merged_state(first.unionByName(second), ["status", "result"]).drop("last_seq")
    assert served(spark, merged, path) == sorted([*rows({"a": 7, "b": 3}, "N"), *rows({"c": 0}), NOBODY])
    finished(spark, path, {"a": 7, "b": 3}, 2, "N")  # the same version again
    assert served(spark, merged, path) == sorted([*rows({"a": 7, "b": 3}, "N"), *rows({"c": 0}), NOBODY])


def test_through_the_state_table(spark, tmp_path):
    """Batches, one of them again: no tie between parts, as no part travels through the table."""
    path, table = str(tmp_path / "results"), str(tmp_path / "state")
    batches = [finished(spark, path, {"a": 2, "b": 9}, 1), finished(spark, path, {"a": 5}, 2),
               finished(spark, path, {"c": 3}, 3)]
    for n in (0, 1, 1, 2):
        store_batch(merge_events(batches[n], ["status", "result"]), table, n, ["status", "result"],
                    layout=Layout(buckets=2, fan=2, levels=2, keep=1))
    current = read_state(spark, table, ["status", "result"]).select("task_id", "status", "result")
    assert served(spark, current, path) == sorted([*rows({"a": 5, "b": 9, "c": 3}), NOBODY])


def test_results_of_their_own_and_running_tasks(spark, tmp_path):
    """Whole results inside events, and tasks without any, beside stored ones."""
    path = str(tmp_path / "results")
    own = results.assemble_results(flat(spark, {"b": 4}), part_size=100).withColumns(
        {"filename": F.lit("b.mp4"), "duration": F.lit("00:30"), "resolution": F.lit("1x1")})
    inside = records.completions(own, "http://x", F.lit("2026-03-06 14:00:00").cast("timestamp"))
    stored = finished(spark, path, {"a": 3}, 1)
    running = spark.createDataFrame([("c", "processing")], "task_id STRING, status STRING")
    both = stored.drop("seq").unionByName(inside).unionByName(running, allowMissingColumns=True)
    current = both.select("task_id", "status", "result")
    assert served(spark, current, path) == sorted([*rows({"a": 3, "b": 4, "c": 0}), NOBODY])


def test_missing_parts_are_told(spark, tmp_path):
    path = str(tmp_path / "results")
    merged = state.merged_state(finished(spark, path, COUNTS, 1), ["status", "result"]).drop("last_seq")
    parts = result_store.read_results(spark, path)
    lost = parts.where("NOT (task_id = 'a' AND part = 1) AND task_id <> 'b'")
    found = {r.task_id: (r.found_parts, r.found_total) for r in result_store.incomplete(merged, lost).collect()}
    assert found == {"a": (2, 3), "b": (None, None)}
    with pytest.raises(Exception, match="stored parts of a result are missing"):
        result_store.served_documents(merged, lost).collect()
