import random

import pytest

import brute
from reelstate.llm import queries, substrings
from reelstate.llm.wordgrams import PIECE


def passages(seed, n=200):
    r = random.Random(seed)
    base = [" ".join(r.choice("abcde") for _ in range(r.randint(1, 80))) for _ in range(40)]
    gaps = (" ", "\n", "  ", "\t\n")
    return [(i, r.choice(gaps).join(r.choice(base) for _ in range(r.randint(0, 6))) if i % 7 else None)
            for i in range(n)]


def found(df, **options):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256)
            for r in substrings.removals(df, **options).collect()}


@pytest.mark.parametrize("seed, block", [(3, 3000), (4, 1 << 20), (5, 500)])
def test_against_brute_force(spark, seed, block):
    rows = passages(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, block_bytes=block) == brute.removals(rows)


@pytest.mark.parametrize("window, phrase", [(5, 3), (8, 8), (20, 1)])
def test_other_windows(spark, window, phrase):
    rows = passages(9, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, window=window, phrase=phrase, block_bytes=2000) == brute.removals(rows, window)


def test_query_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256)
           for r in queries.QUERIES["op9_substrings"](spark, sf_dir).collect()}
    assert got == brute.removals(rows)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in substrings.removals(df).collect()), key=str)
    assert got == [(1, 25), (1, 25), (2, 25), (None, 0)]
    df = df.where("doc_id is not null")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.removals(df).collect()) == [
        (1, 0), (1, 0), (2, 25)]
    assert substrings.removals(df.limit(0)).count() == 0


def test_cleaned(spark):
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(1, f"{shared}\nand its own end.", 3, "x"), (2, f"own start\n {shared}\n\nown  end", 3, "x"),
            (3, shared, 3, "x"), (4, None, 3, "x"), (5, "  untouched \n", 3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, _left string")
    out = substrings.cleaned(df)
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (rows[0][1], 3), 2: ("own start\n own  end", 19), 4: (None, 3),
                   5: ("  untouched \n", 3)}


def test_a_long_document_beside_others(spark):
    words = [f"w{i % 5000}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[100:160])), (3, "x " * 60)]
    assert len(rows[0][1]) > PIECE
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute.removals(rows)
