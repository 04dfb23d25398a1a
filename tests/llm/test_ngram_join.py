import random

import pytest

import brute
from reelstate.llm import ngram_join, queries
from reelstate.llm.components import components


def near_copies():
    r = random.Random(3)
    base = [[r.choice("abcdefghijklmnop") for _ in range(60)] for _ in range(4)]
    out = []
    for i in range(400):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = r.choice("xyzuvw")
        text = " ".join(words)
        out.append((i, None if i % 50 == 0 else "" if i % 51 == 0 else "a B" if i % 52 == 0
                    else "A, b!" if i % 53 == 0 else text))
    return out


@pytest.fixture(scope="module")
def rows():
    return near_copies()


@pytest.mark.parametrize("block", [256, 40])
def test_against_brute_force(spark, rows, block):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies)
           for r in ngram_join.linked(df, block=block).collect()}
    assert got == brute.classes(rows)


def test_query_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies)
           for r in queries.QUERIES["op2_ngram_join"](spark, sf_dir).collect()}
    assert got == brute.classes(rows)


def test_first_of_each_class(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3, b"s") for r in rows],
                               "doc_id long, text string, class_id string, first int, _set binary")
    found = ngram_join.first_of_each(df.unionByName(df.where("doc_id < 9")), block=40)
    assert found.columns == df.columns
    want = sorted(k for k, (c, *_) in brute.classes(rows).items() if k == c)
    assert sorted(r.doc_id for r in found.where("text rlike '[a-z]'").collect()) == [
        k for k in want if (dict(rows)[k] or "")]


def test_null_ids_and_empty_table(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text), (2, text), (2, text + " eight"), (3, None)],
                               "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_copies) for r in ngram_join.linked(df).collect()), key=str)
    assert got == sorted([(None, None, 2), (2, None, 2), (2, 2, 1), (3, 3, 1)], key=str)
    assert ngram_join.linked(df.limit(0)).count() == 0
    assert ngram_join.first_of_each(df.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = ngram_join.bands_and_rows(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall
        assert bands * rows <= ngram_join.HASHES
    with pytest.raises(ValueError, match="recall"):
        ngram_join.bands_and_rows(0.1, 0.9999, 10)


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(150)],
    [(random.Random(i).randint(0, 300), random.Random(-i - 1).randint(0, 300)) for i in range(200)],
    [(5, i) for i in range(100)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)],
    [],
])
def test_components(spark, edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: top(x) for x in parent}
    assert len(got) == len(parent)
