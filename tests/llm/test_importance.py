import itertools
import math

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelstate.llm import importance, queries
from reelstate.llm.common import table

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    good = [(i, f"plain good words about topic {i % 7} and more good words") for i in range(60)]
    bad = [(100 + i, f"junk spam {i % 7} junk click spam junk buy") for i in range(60)]
    return [*good, *bad, (200, None), (201, ""), (None, "plain good words"), (0, good[0][1])]


def labels():
    return [(i, 1, 0) for i in range(30)] + [(i, 1, 1) for i in range(100, 110)] + [
        (i, 0, 0) for i in range(110, 130)] + [(5, None, None), (None, 1, 0), (7, 1, None)]


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.createDataFrame(corpus(), "doc_id long, text string"), spark.createDataFrame(labels(), LABELS))


def test_good_text_is_drawn(tables):
    rows = importance.resampled(*tables, share=0.5).collect()
    assert sum(r.kept for r in rows) == math.ceil(0.5 * len(rows))
    kept = [r.doc_id for r in rows if r.kept and r.doc_id is not None]
    assert sum(k < 100 for k in kept) >= 0.95 * len(kept)


def test_weights_by_hand(tables):
    """The weights from counting the hashed n-grams in plain Python."""
    import pyarrow as pa

    from reelstate.llm import wordgrams

    docs, marks = tables
    rows = docs.collect()

    def buckets(text):
        parts = list(wordgrams.words(pa.array([text], pa.string()), wordgrams.MARKED, lower=True))
        return importance.gram_buckets(parts[0], importance.BUCKETS)[0].tolist() if parts else []

    good = {k for k, q, t in labels() if q == 1 and not t and k is not None}
    target, raw = (np.zeros(importance.BUCKETS) for _ in range(2))
    for key, text in rows:
        for b in buckets(text):
            raw[b] += 1
            target[b] += key in good
    ratio = importance.log_ratio(target, raw)
    got = importance.resampled(docs, marks).collect()
    want = sorted((str(k), sum(ratio[b] for b in buckets(t)) / max(1, len(buckets(t)))) for k, t in rows)
    for (a, x), (b, y) in zip(sorted((str(r.doc_id), r.log_weight) for r in got), want, strict=True):
        assert a == b and x == pytest.approx(y, abs=1e-9)


def test_the_draw_repeats_itself(tables):
    one, two = (sorted(map(str, importance.resampled(*tables).collect())) for _ in range(2))
    assert one == two


def test_drawn_keys_are_the_largest(tables):
    rows = importance.resampled(*tables, share=0.3).collect()
    assert min(r.sample_key for r in rows if r.kept) >= max(r.sample_key for r in rows if not r.kept)


def test_ties_at_the_cut(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(100)], "id long, w double")
    found = importance.drawn(df, "w", ["id"], share=0.37, noise=0.0).collect()
    assert sum(r._drawn for r in found) == 37
    assert not any(r._drawn for r in importance.drawn(df, "w", ["id"], share=0.0).collect())
    assert all(r._drawn for r in importance.drawn(df, "w", ["id"], share=1.0).collect())


def test_kth_largest(spark):
    values = [(v,) for v in [5, 5, 5, 7, 1 << 50, (1 << 50) - 1, 0, 3 << 33, 70_000]]
    df = spark.createDataFrame(values, "v long")
    order = sorted((v for v, in values), reverse=True)
    for k in range(1, len(order) + 1):
        value, above = importance.kth_largest(df, "v", k)
        assert value == order[k - 1] and above == sum(x > value for x in order)


def test_kth_largest_of_signed_numbers(spark):
    values = [-(1 << 63), (1 << 63) - 1, -1, 0, 1, -(1 << 40), 12, -1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k, want in enumerate(sorted(values, reverse=True), 1):
        assert importance.kth_largest(df, "v", k)[0] == want


@pytest.mark.parametrize("weights", [
    [2e6, 3e6, 4e6, 5e6], [-5e9, -4e9, -3e9, -2e9], [1.0, 1.0 + 1e-12, 1.0 - 1e-12, 1.0 - 2e-12],
    [-1e-300, 0.0, 1e-300, -1e300], [float("-inf"), -1.0, 1e308, float("inf")],
])
def test_weights_of_any_size_are_drawn_in_order(spark, weights):
    df = spark.createDataFrame(list(enumerate(weights)), "id long, w double")
    for k in range(1, 5):
        found = importance.drawn(df, "w", ["id"], share=k / 4, noise=0.0).collect()
        assert sorted(r.w for r in found if r._drawn) == sorted(weights)[4 - k:]


def inclusion(weights, noise, k):
    """Chances of being among ``k`` drawn one by one in proportion to exp(weight / noise)."""
    shares = [math.exp(w / noise) for w in weights]
    found = [0.0] * len(weights)
    for drawn in itertools.permutations(range(len(weights)), k):
        chance, left = 1.0, sum(shares)
        for i in drawn:
            chance, left = chance * shares[i] / left, left - shares[i]
        for i in drawn:
            found[i] += chance
    return found


def test_draws_in_proportion_to_the_weights(spark):
    """Thousands of small tables, against the exact chances."""
    weights, noise, trials, k = [0.0, 0.02, 0.05, 0.1, 0.12, 0.2], 0.05, 4000, 3
    rows = spark.range(trials * len(weights)).selectExpr("id", f"id div {len(weights)} as t", f"id % {len(weights)} as i")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.col("i").cast("int"))
    rank = F.rank().over(W.partitionBy("t").orderBy(F.desc(weight + noise * importance.gumbel("id"))))
    got = dict(rows.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("i").count().collect())
    for i, want in enumerate(inclusion(weights, noise, k)):
        assert got[i] / trials == pytest.approx(want, abs=4 * math.sqrt(want * (1 - want) / trials))


def test_the_draw_of_a_table_by_hand(tables):
    """The query's own rows: the keys are weight and noise, and the largest are drawn."""
    rows = importance.resampled(*tables, share=0.4, noise=2.0).collect()
    keys = sorted((r.sample_key for r in rows), reverse=True)
    cut = keys[math.ceil(0.4 * len(rows)) - 1]
    assert all(r.kept == (r.sample_key >= cut) for r in rows)
    assert any(r.log_weight < s.log_weight for r in rows if r.kept for s in rows if not s.kept)


def test_long_texts_and_clashing_columns(spark, tables):
    docs, marks = tables
    long = spark.createDataFrame([(900, "plain good words " * 200_000), (901, "x" * 3_000_000)], docs.schema)
    rows = {r.doc_id: r for r in importance.resampled(docs.unionByName(long), marks).collect()}
    assert rows[900].n_grams == 600_000 * 2 - 1 and rows[901].n_grams == 1
    names = ["_id", "_hash", "_weight", "_key", "_order", "_drawn", "bucket", "n"]
    clash = docs.selectExpr("*", *[f"'x' as {n}" for n in names])
    assert sorted(map(str, importance.resampled(clash, marks).collect())) == sorted(
        map(str, importance.resampled(docs, marks).collect()))


def test_noise_is_gumbel(spark):
    noise = np.array([r[0] for r in spark.range(20_000).select(importance.gumbel("id")).collect()])
    assert noise.mean() == pytest.approx(0.5772, abs=0.03)
    assert noise.std() == pytest.approx(math.pi / math.sqrt(6), abs=0.03)


def test_empty_tables(spark, tables):
    docs, marks = tables
    assert importance.resampled(docs.limit(0), marks).count() == 0
    rows = importance.resampled(docs, marks.limit(0)).collect()
    assert {r.log_weight for r in rows} == {0.0} and len(rows) == len(corpus())


def test_held_out_labels(spark):
    """Models of half of the labels rank the documents of the other half."""
    sf_dir = "/root/testdata/sf0.1"
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = importance.resampled(docs, marks.where("doc_id % 2 = 0"))
    rows = found.join(marks.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.log_weight for r in rows if r.quality == 1 and not r.toxic]
    poor = [r.log_weight for r in rows if r.quality == 0]
    assert np.mean([g > p for g in good for p in poor]) > 0.99
    assert np.mean([r.kept for r in rows if r.quality == 1 and not r.toxic]) > 0.98
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.1


def test_query(spark, sf_dir):
    found = queries.QUERIES["op10_importance"](spark, sf_dir)
    n = table(spark, sf_dir, "documents").count()
    assert found.count() == n and found.where("kept").count() == math.ceil(importance.KEEP * n)
