import re
from collections import Counter
from fractions import Fraction

import pytest

from compare import SAME_TYPE, oracle_connection, oracle_rows, oracle_types, spark_rows
from reelstate.llm import curriculum, queries

TABLE = "doc_id long, text string, source string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights, most=3):
    """Shared out by weight, the excess again and again, in exact fractions."""
    left, found = dict(weights), {}
    total = Fraction(sum(sizes.values()))
    while True:
        rest = total - sum(found.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > most * sizes[s]]
        if not over:
            return found | share
        for s in over:
            found[s] = Fraction(most * sizes[s])
            del left[s]


def corpus():
    rows = [(i, "word " * (1 + i * 7 % 40), f"host{i % 5}") for i in range(200)]
    rows += [(300 + i, "only a few", "alpha") for i in range(2)]       # a target above three times this
    rows += [(400 + i, "null source words here", None) for i in range(9)]
    rows += [(7, "copied row", "host1")] * 25 + [(None, None, "host2"), (None, "", "host2"), (500, None, None)]
    return rows + [(600, "x " * 9000, "long"), (601, None, "empty"), (602, " \n\t", "empty")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), TABLE).repartition(4)


def order(sources):
    return sorted(sources, key=lambda s: (s is None, (s or "").encode()))


def check(rows, given):
    sizes = Counter()
    for _, text, source in given:
        sizes[source] += words(text)
    weights = {s: i % 3 + 1 for i, s in enumerate(order(sizes))}
    want = targets(sizes, weights)
    taken, found = Counter(), Counter()
    for r in rows:
        assert r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        assert r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and (r.taken > 0) == (r.position is not None)
        assert all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
        taken[r.source] += r.taken
        found[r.doc_id, r.source, r["size"]] += 1
    assert taken == Counter({s: int(t + Fraction(1, 2)) for s, t in want.items()})
    assert found == Counter((i, s, words(t)) for i, t, s in given)


def test_targets_and_taken_words(docs):
    rows = curriculum.placed(docs).collect()
    check(rows, corpus())
    places = [r.position for r in rows if r.position is not None]
    assert places == sorted(places) and all(r.position is None for r in rows[len(places):])


def test_slices_and_runs_change_nothing(docs, monkeypatch):
    want = Counter(map(str, curriculum.placed(docs).collect()))
    monkeypatch.setattr(curriculum, "SLICE", 7)
    monkeypatch.setattr(curriculum, "RUN", 4)
    rows = curriculum.placed(docs.repartition(7)).collect()
    assert Counter(map(str, rows)) == want
    check(rows, corpus())


def test_positions_follow_the_schedule(spark):
    """The words placed before an instant are the integral of the schedule up to it."""
    rows = [(i, "one two three four", s) for i, s in enumerate(["a", "b", "c"] * 400)]
    found = curriculum.placed(spark.createDataFrame(rows, TABLE)).collect()
    until = {"a": lambda t: t, "b": lambda t: 3 * t - t * t,
             "c": lambda t: 2 * t if t < 0.5 else 1 + 2 * (t - 0.5) + 4 * (t - 0.5) ** 2}
    weight = {"a": 1, "b": 2, "c": 3}
    for t in (0.1, 0.3, 0.5, 0.8, 1.0):
        for s in "abc":
            own = [r for r in found if r.source == s]
            before = sum(4 for r in own for p in r.positions if p < t)
            assert before == pytest.approx(own[0].target * until[s](t) / weight[s], abs=5)


def test_other_schedules(spark):
    """A source whose weight is 0 at first comes late; one without weight is not taken."""
    rows = [(i, "some words to take", s) for i, s in enumerate(["a", "b", "c"] * 50)]
    plans = (((0, 1), (1, 1)), ((0, 0), (0.5, 0), (0.5, 1), (1, 1)), ((0, 0), (1, 0)))
    found = curriculum.placed(spark.createDataFrame(rows, TABLE), schedules=plans).collect()
    assert all(p >= 0.5 for r in found if r.source == "b" for p in r.positions)
    assert sum(r.taken for r in found if r.source == "c") == 0
    assert sum(r.taken for r in found) == 600


def test_training_order(docs):
    rows = curriculum.mixed(docs).collect()
    times = Counter((r.doc_id, r.source, r["size"]) for r in curriculum.placed(docs).collect() for _ in r.positions)
    assert Counter((r.doc_id, r.source, words(r.text)) for r in rows) == times
    assert [r.position for r in rows] == sorted(r.position for r in rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(None, "", "a"), (2, "word", "b")]])
def test_few_rows(spark, rows):
    found = curriculum.placed(spark.createDataFrame(rows, TABLE)).collect()
    assert len(found) == len(rows)
    check(found, rows) if rows else None


def test_clashing_columns(spark, docs):
    names = ["order", "size", "position", "target", "_start", "_of", "_order", "_id", "_source"]
    clash = docs.selectExpr("*", *[f"'x' as {n}" for n in names])
    assert Counter(map(str, curriculum.placed(clash).collect())) == Counter(map(str, curriculum.placed(docs).collect()))


def test_query_matches_sql(spark, sf_dir):
    with oracle_connection(sf_dir) as oracle:
        sql = queries.ORACLES["op13_curriculum"]
        df = queries.QUERIES["op13_curriculum"](spark, sf_dir)
        names, rows = spark_rows(df)
        assert (names, rows) == oracle_rows(oracle, sql)
        assert {n: SAME_TYPE[t] for n, t in df.dtypes} == oracle_types(oracle, sql)
