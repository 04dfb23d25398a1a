"""Every registered query against its SQL, on the smallest data."""

import pytest

import __spark_entry__ as entries
from compare import SAME_TYPE, oracle_connection, oracle_rows, oracle_types, spark_rows
from reelstate.operators import skew
from reelstate.plans import catalog

catalog.load()
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
FILE_LISTS = ("io1_landing_scan", "t1_upload_arrivals")
WITH_HOT_KEYS = (
    "flagship_request_detections", "j1_status_lookup", "j3_state_as_of", "w1_state_history",
    "w2_attempt_state", "a3_result_assembly", "io4_reply_scan",
)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    with oracle_connection(sf_dir) as connection:
        yield connection


def check(spark, oracle, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names, rows = spark_rows(df)
    expected_names, expected = oracle_rows(oracle, ORACLES[name])
    assert names == expected_names
    assert {n: SAME_TYPE[t] for n, t in df.dtypes} == oracle_types(oracle, ORACLES[name])
    assert rows == expected
    assert rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, oracle, sf_dir, name):
    check(spark, oracle, sf_dir, name)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n.startswith("io3_")))
def test_matches_sql_the_second_time(spark, oracle, sf_dir, name):
    """Nothing that a query leaves behind changes the next run in the same process."""
    check(spark, oracle, sf_dir, name)


@pytest.mark.parametrize("name", WITH_HOT_KEYS)
def test_matches_sql_when_most_keys_are_hot(spark, oracle, sf_dir, name, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 4)
    check(spark, oracle, sf_dir, name)


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entries.queries()) and set(ORACLES) <= set(entries.oracle_sql())


@pytest.mark.parametrize("name", FILE_LISTS)
def test_lists_every_table_file(spark, sf_dir, name):
    found = {row.filename for row in QUERIES[name](spark, sf_dir).select("filename").collect()}
    assert {"events.parquet", "lineitem.parquet"} <= found
    assert len(found) == 14


def test_entry_runs(spark):
    assert entries.entry(spark).columns == [
        "task_id", "code", "reply_message", "pos", "timestamp", "horse_id", "person_name",
        "confidence",
    ]
