import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import vptree

ROWS = "vec_id bigint, embedding array<float>, label int, a string, reach string, leaf string, ids int"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "a", "r", "l", 2) for i, v in vectors]
    return spark.createDataFrame(rows, ROWS).repartition(4)


def brute(vectors, queries, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if queries(i):
            order = sorted(((-(v @ w), j) for j, w in good if j != i))[:k]
            out[i] = [(j, -s) for s, j in order]
    return out


def found(spark, vectors, queries, k, factor):
    rows = table(spark, vectors)
    got = {}
    for r in vptree.nearest(rows, rows.filter(queries), k, factor).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


@pytest.mark.parametrize("shard", [4096, 100])
def test_factor_one_is_exact(spark, monkeypatch, shard):
    monkeypatch.setattr(vptree, "SHARD", shard)
    rng = np.random.default_rng(1)
    vectors = [(i, (rng.normal(size=16) * rng.uniform(0.2, 2)).round(3).tolist()) for i in range(600)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(300)] + [(2000 + i, vectors[20][1]) for i in range(5)]
    want = brute(vectors, lambda i: i % 20 == 0, 5)
    got = found(spark, vectors, F.col("vec_id") % 20 == 0, 5, 1.0)
    assert got.keys() == want.keys()
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


@pytest.mark.parametrize("kind", ["plain", "clusters", "unit"])
def test_recall_of_the_default_factor(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    if kind == "clusters":
        x = rng.normal(size=(30, 16))[rng.integers(30, size=3000)] + 0.3 * x
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = list(enumerate(x.tolist()))
    want = brute(vectors, lambda i: i % 50 == 0, 20)
    got = found(spark, vectors, F.col("vec_id") % 50 == 0, 20, vptree.FACTOR)
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]) >= 0.9


def recall(spark, vectors, queries, column):
    want = brute(vectors, queries, 20)
    got = found(spark, vectors, column, 20, vptree.FACTOR)
    return np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want])


@pytest.mark.parametrize("kind", ["outlier", "near outlier", "heavy tail", "long query"])
def test_recall_does_not_depend_on_the_largest_norm(spark, monkeypatch, kind):
    monkeypatch.setattr(vptree, "SHARD", 1000)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind in ("outlier", "near outlier"):
        x[1] *= 20 if kind == "outlier" else 1.4
    elif kind == "heavy tail":
        x *= rng.pareto(1.5, size=4000)[:, None] + 0.1
    else:
        x[::50] *= 30
    assert recall(spark, list(enumerate(x.tolist())), lambda i: i % 50 == 0, F.col("vec_id") % 50 == 0) >= 0.95


def test_odd_vectors_take_no_part(spark):
    good = [(i, [float(i + 1), *[0.0] * 14, 1.0]) for i in range(4)]
    odd = [(10, None), (20, [0.0] * 16), (40, [float("nan"), *[1.0] * 15]), (60, [float("inf"), *[1.0] * 15]), (80, [None, *[1.0] * 15]), (100, []), (120, [1.0, 2.0])]
    got = found(spark, good + odd, F.col("vec_id") % 20 == 0, 20, 1.0)
    assert got == {0: [(3, 5.0), (2, 4.0), (1, 3.0)]}
    assert found(spark, [(0, good[0][1])], F.lit(True), 20, 1.0) == {}
    assert found(spark, [], F.lit(True), 20, 1.0) == {} and found(spark, odd[:2], F.lit(True), 20, 1.0) == {}


def test_repeated_and_null_ids(spark):
    """Each row is a candidate of all others, also of those that share its id, and each row of a query's id is a query."""
    rng = np.random.default_rng(9)
    vectors = [(i, rng.normal(size=16).round(2).tolist()) for i in range(0, 150)]
    vectors += [(20, rng.normal(size=16).round(2).tolist()) for _ in range(3)] + [(40, vectors[40][1])] * 25 + [(None, vectors[3][1])] * 2
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors]
    want = []
    for a, (i, v) in enumerate(good):
        if i is not None and i % 20 == 0:
            near = sorted(((-(v @ w), -1 if j is None else j) for b, (j, w) in enumerate(good) if a != b))[:20]
            want += [(i, r + 1, None if j < 0 else j, round(-s, 9)) for r, (s, j) in enumerate(near)]
    rows = table(spark, vectors)
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in vptree.nearest(rows, rows.filter("vec_id % 20 = 0"), 20, 1.0).collect()]
    order = lambda t: (t[0], t[1], t[3], -1 if t[2] is None else t[2])
    assert sorted(got, key=order) == sorted(want, key=order)
