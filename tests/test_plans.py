"""What the physical plans must and must not hold."""

import re

import pytest

from reelstate.operators import state
from reelstate.plans import catalog, standins
from reelstate.plans.states import ENUMS

catalog.load()
QUERIES = catalog.QUERIES
# Streams are drained while the query is built, so their plan is only the read-back.
# The listing is a data source in Python, and polls on a stream are a stateful one.
BATCH = sorted(name for name in QUERIES if not re.match(r"t\d_|io1_landed_uploads|j3_as_of_stream", name))
ROW_WISE = [name for name in BATCH if re.match(r"p([2-9]|1[0-2])_", name)] + [
    "s_s1_storage_names", "s_s2_public_url", "s_s3_s4_progress_text", "s_s5_query_parameter",
    "s_s7_resolution", "s_m1_transfer_percent", "s_d1_completion_time", "s_i1_task_ids",
    "s_j2_pretty_json", "io2_media_files", "s_g1_step_grid",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    text = plan(df)
    return text[: text.index("Initial Plan")]


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "InArrow"):
        assert banned not in text


@pytest.mark.parametrize("name", ROW_WISE)
def test_row_wise_queries_do_not_shuffle(spark, sf_dir, name):
    assert "Exchange" not in plan(QUERIES[name](spark, sf_dir))


def test_without_hot_keys_the_plain_plan_runs(spark, sf_dir):
    text = final_plan(QUERIES["w1_state_history"](spark, sf_dir))
    assert text.count("Exchange hashpartitioning") == 1
    assert "Union" not in text and "BroadcastHashJoin" not in text


def test_detections_are_shuffled_once(spark, sf_dir):
    """One exchange serves numbering, assembly and the flattening after them."""
    text = final_plan(QUERIES["p1_detection_table"](spark, sf_dir))
    assert text.count("Exchange hashpartitioning") == 1


def test_latest_row_limits_before_the_shuffle(spark, sf_dir):
    text = final_plan(QUERIES["a1_latest_row"](spark, sf_dir))
    assert re.search(r"WindowGroupLimit.*Final(.|\n)*Exchange(.|\n)*WindowGroupLimit.*Partial", text)


def test_coded_merge_hashes(spark, sf_dir):
    events = standins.task_events(spark, sf_dir)
    coded = plan(state.merged_state(events, ["status", "progress"], enums=ENUMS))
    assert "HashAggregate" in coded
    # text is merged only where it is outside the list, which the scan filters for
    assert coded.count("SortAggregate(") == 2


def test_scan_reads_only_what_is_used(spark, sf_dir):
    text = plan(QUERIES["p6_still_active"](spark, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan(
        QUERIES["s_s1_storage_names"](spark, sf_dir))


def test_merge_carries_values_outside_an_enum(spark):
    rows = [(1, 1, "paused"), (2, 1, "paused"), (2, 2, "completed"), (3, 1, "error"), (3, 2, "odd"),
            (3, 3, None), (4, 1, "error"), (5, 1, None)]
    events = spark.createDataFrame(rows, "task_id INT, seq INT, status STRING")
    for merge in (state.merged_state, state.latest_value):
        coded, plain = (merge(events, ["status"], enums=enums).collect() for enums in (ENUMS, None))
        assert sorted(map(tuple, coded), key=str) == sorted(map(tuple, plain), key=str)
    merged = {r.task_id: r.status for r in state.merged_state(events, ["status"], enums=ENUMS).collect()}
    assert merged == {1: "paused", 2: "completed", 3: "odd", 4: "error", 5: None}
