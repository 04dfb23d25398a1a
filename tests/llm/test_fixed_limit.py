"""Boilerplate in a host of thousands of texts."""

from collections import Counter

import brute
import duckdb

from compare import oracle_connection, oracle_rows, spark_rows
from reelstate.llm import line_rules, queries
from test_line_rules import COLUMNS, SCHEMA, story


def hot_host():
    """3000 texts of one host, with lines in 4 %, in 1 %, in 11 and in 10 of them."""
    out = []
    for i in range(3000):
        lines = [story(i, 24)]
        lines += ["Sign up for   our LETTER today"] * (i % 25 == 0) + ["share this page with all"] * (i % 100 == 1)
        lines += ["one more than the limit"] * (i < 11) + ["just at the limit here"] * (i < 10)
        out.append((i, "\n".join(lines), "hot"))
    return out + [(3000 + i, f"share this page with all\n{story(3000 + i)}", "cold") for i in range(10)]


def test_limit_does_not_grow_with_the_host(spark):
    df = spark.createDataFrame(hot_host(), SCHEMA)
    found = line_rules.frequent_lines(df)
    assert sorted(r.n_docs for r in found.collect()) == [11, 30, 120]
    assert line_rules.frequent_lines(df, share=0.05).count() == 0  # an option
    got = Counter(tuple(r[c] for c in COLUMNS) for r in line_rules.verdicts(df).collect())
    assert got == Counter(brute.line_verdicts(hot_host()))


def test_query_equals_its_sql(spark, sf_dir, tmp_path):
    run = queries.QUERIES["op3_line_rules"]
    assert spark_rows(run(spark, sf_dir)) == oracle_rows(oracle_connection(sf_dir), queries.LINE_SQL)
    spark.createDataFrame(hot_host(), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = spark_rows(run(spark, str(tmp_path)))
    assert got == oracle_rows(connection, queries.LINE_SQL)
    assert sum(row[got[0].index("n_removed_words")] * n for row, n in got[1].items()) == 119 * 6 + 29 * 5 + 10 * 5
