import numpy as np
import pytest

from compare import SAME_TYPE, oracle_connection, oracle_rows, oracle_types, spark_rows
from reelstate.llm import queries, vector_codes
from reelstate.llm.vector_codes import Neighbours, nearest

TABLE = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds):
    """Codes and errors by comparing every part with every entry, in plain Python."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], l) for i, v, l in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    longest = max(len(v) for _, v, _ in kept)
    dims = -(-max(longest, 1) // parts) * parts
    step = dims // parts
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(i, v + [0] * (dims - len(v)), l) for i, v, l in kept]
    first = [v + [0] * (dims - len(v)) for _, v, _ in order[:entries]]
    books = [[v[p * step:(p + 1) * step] for v in first] for p in range(parts)]

    def code(v):
        found = []
        for p, book in enumerate(books):
            x = v[p * step:(p + 1) * step]
            found.append(min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book)))
        return found

    for _ in range(rounds):
        held = [[[] for _ in book] for book in books]
        for _, v, _ in kept:
            for p, (_, k) in enumerate(code(v)):
                held[p][k].append(v[p * step:(p + 1) * step])
        books = [[[sum(c) // len(c) for c in zip(*held[p][k])] if held[p][k] else e
                  for k, e in enumerate(book)] for p, book in enumerate(books)]
    out = [(i, "".join(f"{k:02x}" for _, k in code(v)), sum(d for d, _ in code(v)), l) for i, v, l in kept]
    return [(i, c, e, sum(x[2] for x in out if x[3] == l)) for i, c, e, l in out]


def some_rows():
    dice = np.random.default_rng(5)
    rows = [(i, dice.normal(size=8).round(2).tolist(), int(dice.integers(3))) for i in range(120)]
    rows += [(i, rows[3][1], 1) for i in range(200, 260)]          # copies
    rows += [(7, rows[9][1], None), (7, rows[9][1], None)]         # repeated rows, no label
    rows += [(500, None, 1), (501, [float("nan")] * 8, 1), (502, [1.0, None] * 4, 2), (503, [float("inf")] * 8, 0)]
    rows += [(None, rows[11][1], 2), (504, [], 1), (505, [0.5, -0.25, 3.0], 0)]
    return rows


def test_matches_brute_force(spark):
    rows = some_rows()
    got = vector_codes.reported(spark.createDataFrame(rows, TABLE).repartition(5), parts=4, entries=9)
    found = [tuple(r)[:4] for r in got.collect()]
    assert sorted(map(str, found)) == sorted(map(str, brute(rows, 4, 9, 2)))
    assert len({r.codebooks_sha256 for r in got.collect()}) == 1


def test_fewer_rows_than_entries(spark):
    rows = some_rows()[:5]
    got = vector_codes.reported(spark.createDataFrame(rows, TABLE), parts=4, entries=64)
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(brute(rows, 4, 64, 2))


@pytest.mark.parametrize("rows", [[], [(1, None, 1)]])
def test_nothing_to_code(spark, rows):
    assert vector_codes.reported(spark.createDataFrame(rows, TABLE)).collect() == []


def test_clashing_columns(spark):
    names = ["_id", "_vector", "_label", "codes", "error", "code", "_of", "label_error"]
    plain = spark.createDataFrame(some_rows()[:40], TABLE)
    clash = plain.selectExpr("*", *[f"'x' as {n}" for n in names])
    assert sorted(vector_codes.reported(clash).collect()) == sorted(vector_codes.reported(plain).collect())


@pytest.mark.parametrize("spread", [2, 40, 100_000])
def test_walk_finds_the_lowest_nearest_entry(spread):
    """Orchard's search against all distances, with many ties and equal entries."""
    dice = np.random.default_rng(spread)
    entries = dice.integers(-spread, spread, size=(50, 3))
    points = np.concatenate([dice.integers(-spread, spread, size=(2000, 3)), entries])
    codes, far = nearest(points, Neighbours.of(entries))
    gaps = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (codes == gaps.argmin(1)).all() and (far == gaps.min(1)).all()


def test_walk_measures_few_entries():
    """On spread entries the search ends long before the end of the lists."""
    dice = np.random.default_rng(1)
    book = Neighbours.of(dice.integers(-1000, 1000, size=(64, 2)))
    stops = [(book.gaps[k] <= 4 * 200 ** 2).sum() for k in range(64)]
    assert max(stops) < 32


def test_query_matches_sql(spark, sf_dir):
    with oracle_connection(sf_dir) as oracle:
        sql = queries.ORACLES["op12_vector_codes"]
        df = queries.QUERIES["op12_vector_codes"](spark, sf_dir)
        names, rows = spark_rows(df)
        assert (names, rows) == oracle_rows(oracle, sql)
        assert {n: SAME_TYPE[t] for n, t in df.dtypes} == oracle_types(oracle, sql)
