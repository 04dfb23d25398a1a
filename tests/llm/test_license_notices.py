"""Notices wrapped over several lines."""

import re
import textwrap

import duckdb

from compare import oracle_connection, oracle_rows, spark_rows
from reelstate.llm import licenses, queries
from test_licenses import SCHEMA, rows

NAMED = [(label, {w for w in re.split(r"[^a-z0-9]+", t.lower()) if w}, t) for label, t in licenses.TEMPLATES]


def wrapped():
    """Each template wrapped at several widths, plain, as a comment, and cut by a blank line."""
    out = []
    for label, _, text in NAMED:
        for width in (12, 30, 72):
            lines = textwrap.wrap(text, width, break_on_hyphens=False, break_long_words=False)
            half = len(lines) // 2
            for form in ("\n".join(lines), "\n".join(f" * {x}" for x in lines),
                         "Title\n\n" + "\n".join(lines) + "\n \t\n\nA story.\nIt ends.",
                         "\n".join(lines[:half]) + "\n\n" + "\n".join(lines[half:])):
                out.append((len(out), form))
    return out


def brute(text):
    parts = text.split("\n") + re.split(r"\n[ \t-\r]*\n", text)
    found = {}
    for part in parts:
        own = {w for w in re.split(r"[^a-z0-9]+", part.lower()) if w}
        for label, words, _ in NAMED:
            share = len(own & words) / len(words)
            if len(own & words) >= 0.8 * len(words) - 1e-9:
                found[label] = max(share, found.get(label, 0.0))
    return found


def test_wrapped_notices_are_found(spark):
    df = spark.createDataFrame(wrapped(), SCHEMA)
    got = {r.doc_id: r for r in licenses.scanned(df, paragraphs=True).collect()}
    for key, text in wrapped():
        want = brute(text)
        assert got[key].score == max(want.values(), default=0.0), text
        assert set(got[key].labels.split(",")) - {""} == set(want) | (set(got[key].base_labels.split(",")) - {""})
    whole = [got[i].score for i in range(0, len(got), 4)]
    assert whole == [1.0] * len(whole)
    lines = {r.doc_id: r for r in licenses.scanned(df, paragraphs=False).collect()}
    assert any(lines[i].score == 0.0 for i in range(0, len(got), 4))


def test_query_equals_its_sql(spark, sf_dir, tmp_path):
    run = queries.QUERIES["op7_license_notices"]
    assert spark_rows(run(spark, sf_dir)) == oracle_rows(oracle_connection(sf_dir), queries.LICENSE_SQL)
    # the SQL takes minutes on texts of many thousand words
    given = [row for row in rows() if len(row[1] or "") < 1000] + [(1000 + key, text) for key, text in wrapped()]
    spark.createDataFrame(given, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert spark_rows(run(spark, str(tmp_path))) == oracle_rows(connection, queries.LICENSE_SQL)


def test_a_long_list_of_templates_is_not_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(wrapped()[::5], SCHEMA + "").selectExpr("*", "1 AS _hash", "'x' AS label")
    want = sorted(map(tuple, licenses.scanned(df).collect()), key=str)
    monkeypatch.setattr(licenses, "BROADCAST", 10)
    assert sorted(map(tuple, licenses.scanned(df).collect()), key=str) == want
    assert licenses.scanned(df.limit(0)).count() == 0


def test_spdx_lines(spark):
    lines = {1: ("// SPDX-License-Identifier: Apache-2.0", "apache"), 2: ("# SPDX-License-Identifier: GPL-2.0-only", "gpl"),
             3: ("SPDX-License-Identifier: MIT", "mit"), 4: ("spdx license identifier", "")}
    rows = spark.createDataFrame([(k, t) for k, (t, _) in lines.items()], SCHEMA)
    assert {r.doc_id: r.labels for r in licenses.scanned(rows).collect()} == {k: x for k, (_, x) in lines.items()}
