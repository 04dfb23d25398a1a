import duckdb

from compare import oracle_connection, oracle_rows, spark_rows
from reelstate.llm import licenses, queries

TEXTS = [
    None, "", " . ", "mit license", "The MIT  License, the MIT license; MITLICENSE and mit-license",
    "CC BY cc by CC-BY\ncc\nby", "gnu general public license gnu general public license",
    "Released under the terms of the MIT License.\nNothing else.", "license mit the under released",
    "Licensed under CC BY-NC 4.0.", "All rights\nreserved.", "all rights reserved", "All Rights RESERVED © 2020",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3",
    "apache license " * 3000, "x " * 30_000 + "cc by", "é Apache License é", "apache\x85license",
    "Redistribution and use in source and binary forms are permitted provided that the following",
]
SCHEMA = "doc_id long, text string"


def rows():
    return list(enumerate(TEXTS)) + [(None, TEXTS[4]), (3, TEXTS[3]), (3, TEXTS[9])]


def test_query_equals_its_sql(spark, sf_dir, tmp_path):
    assert spark_rows(queries.QUERIES["op7_licenses"](spark, sf_dir)) == oracle_rows(
        oracle_connection(sf_dir), queries.LICENSE_SQL)
    spark.createDataFrame(rows(), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert spark_rows(queries.QUERIES["op7_licenses"](spark, str(tmp_path))) == oracle_rows(
        connection, queries.LICENSE_SQL)


def test_places_and_labels(spark):
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows()[:len(TEXTS)], SCHEMA)).collect()}
    assert (got[0].n_words, got[0].labels, got[0].score, got[0].first_word) == (0, "", 0.0, None)
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].base_labels) == (3, 1, 8, "mit")
    assert (got[5].n_base, got[5].first_word, got[5].last_word) == (4, 0, 6)
    assert (got[6].n_base, got[6].last_word) == (2, 4)
    assert (got[8].base_labels, got[8].labels, got[8].score) == ("", "mit", 1.0)
    assert (got[9].base_labels, got[9].labels) == ("cc-by", "cc-by,cc-by-nc")
    assert got[10].labels == "proprietary" and got[11].labels == "proprietary"
    assert got[14].n_base == 3000 and got[15].first_word == 30_000


def test_every_template_is_found_at_its_threshold(spark):
    """Blocks of each number of a template's words, against counting."""
    import re

    docs, want = [], {}
    for i, (_, text) in enumerate(licenses.TEMPLATES):
        words = list(dict.fromkeys(w for w in re.split(r"[^a-z0-9]+", text.lower()) if w))
        for n in range(1, len(words) + 1):
            for turn, part in enumerate((words[:n], words[-n:], words[::-1][:n])):
                docs.append((i * 10_000 + n * 10 + turn, " ".join(["zebra", *part, "zebra"])))
    sets = [(label, {w for w in re.split(r"[^a-z0-9]+", t.lower()) if w}) for label, t in licenses.TEMPLATES]
    for key, text in docs:
        own = set(text.split())
        best = [(len(own & s) / len(s), label) for label, s in sets if len(own & s) >= 0.8 * len(s) - 1e-9]
        want[key] = max((b for b, _ in best), default=0.0)
    got = {r.doc_id: r.score for r in licenses.scanned(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == want


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows()], SCHEMA + ", _hash int, label string")
    assert licenses.scanned(df).count() == len(rows())
    assert licenses.scanned(df.limit(0)).count() == 0
