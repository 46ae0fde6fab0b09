import math

import pytest
from pyspark.sql import functions as F

from maskwright.llm import mixing
from maskwright.llm.mixing import Mix
from tests.llm import messy

SIZES = {"a": 6000, "b": 1500, "c": 400, None: 100}


NEAR = {f"s{i}": 1000 + 7 * i for i in range(20)}


def plain_weights(sizes, mix):
    """Exponent, weights and budget by fine scans outwards from 1 instead of halving."""
    total = sum(sizes.values())

    def at(a):
        top = max(sizes.values())
        z = sum((v / top) ** a for v in sizes.values())
        w = {k: (v / top) ** a / z for k, v in sizes.items()}
        entropy = -sum(x * math.log(x) for x in w.values() if x)
        budget = {"same": total, "cover": max(sizes[k] / w[k] for k in sizes)}.get(mix.budget, mix.budget)
        return w, entropy, budget, max(w[k] * budget / v for k, v in sizes.items())

    goal = math.inf if mix.entropy is None else mix.entropy * math.log(len(sizes))
    steps = [i / 2000 for i in range(2001)] if at(1.0)[1] <= goal else [1 + i / 400 for i in range(80_000)]
    best = next((a for a in steps if at(a)[1] <= goal + 1e-9), 1.0)
    often = mix.repeats is not None and at(best)[3] > mix.repeats + 1e-9
    if often:
        way = [a for a in steps if best <= a <= 1] if best < 1 else [a for a in reversed(steps) if a <= best]
        best = next((a for a in way if at(a)[3] <= mix.repeats + 1e-9), 1.0)
    return best, *at(best)


@pytest.mark.parametrize("mix", [Mix(), Mix(0.7, None), Mix(None, 2.0), Mix(None, None), Mix(0.95, 1.5, "cover"), Mix(0.9, 3.0, 5000), Mix(0.4, None)])
@pytest.mark.parametrize("sizes", [SIZES, NEAR], ids=["steep", "near"])
def test_weights_against_a_scan(spark, mix, sizes):
    totals = spark.createDataFrame(list(sizes.items()), "source string, tokens bigint")
    a, want, _, budget, _ = plain_weights(sizes, mix)
    for r in mixing.weights(totals, mix).collect():
        assert r.weight == pytest.approx(want[r.source], abs=1e-3 * max(1.0, a / 10))
        assert r.epochs == pytest.approx(want[r.source] * budget / r.tokens, rel=2e-2, abs=1e-3)


def test_even_shares_reach_the_target(spark):
    near = spark.createDataFrame(list(NEAR.items()), "source string, tokens bigint")
    rows = mixing.weights(near, Mix(0.9, None)).collect()
    assert all(r.target_met for r in rows)
    assert -sum(r.weight * math.log(r.weight) for r in rows) == pytest.approx(0.9 * math.log(20), rel=1e-4)
    # the limit stands before the target
    limited = mixing.weights(near, Mix(0.9, 1.5)).collect()
    assert not any(r.target_met for r in limited) and max(r.epochs for r in limited) == pytest.approx(1.5, rel=1e-3)
    alike = spark.createDataFrame([(f"s{i}", 100) for i in range(5)], "source string, tokens bigint")
    assert {(round(r.weight, 9), r.epochs, r.target_met) for r in mixing.weights(alike, Mix(0.9, None)).collect()} == {(0.2, 1.0, False)}
    assert {r.target_met for r in mixing.weights(alike, Mix(1.0, None)).collect()} == {True}
    single = spark.createDataFrame([("a", 100)], "source string, tokens bigint")
    assert [(r.weight, r.epochs) for r in mixing.weights(single, Mix()).collect()] == [(1.0, 1.0)]


def test_rows_of_one_id_are_spread(spark):
    docs = spark.createDataFrame([(None, "a", f"w {i}") for i in range(3000)] + [(7, "b", f"x {i}") for i in range(3000)], "doc_id bigint, source string, text string")
    out = mixing.mixed(docs, Mix(None, None, 3000)).groupBy("row.source").agg(F.sum("tokens").alias("t"), F.countDistinct("block").alias("b")).collect()
    assert all(abs(r.t - 1500) < 60 and r.b > 200 for r in out) and len(out) == 2


def test_budgets_are_met_by_blocks(spark):
    n = {"a": 6000, "b": 1200, "c": 150}
    rows = [(i, s, "w " * (5 + i % 7)) for s, c in n.items() for i in range(c)]
    docs = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id bigint, source string, text string")
    out = mixing.mixed(docs, Mix(0.8, 3.0))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.groupBy("row.source").agg(F.sum("tokens").alias("t"), F.first("weight").alias("w"), F.max("epoch").alias("e"), F.countDistinct("row.doc_id").alias("d")).collect()
    total = sum(5 + r[0] % 7 for r in rows)
    for r in got:
        assert abs(r.t - r.w * total) < 0.02 * total
        assert r.d == n[r.source] if r.e else r.d <= n[r.source]
    # an epoch takes a document once at most, and all of them before the next begins
    per = out.groupBy("row.doc_id", "epoch").count()
    assert per.filter("count > 1").isEmpty()
    assert out.filter("position < 0 or position >= 1.001").isEmpty()


def test_cover_leaves_no_document_out(spark):
    docs = messy.documents(spark)
    out = mixing.mixed(docs, Mix(0.95, 2.0, "cover")).select("row.*")
    assert out.columns == docs.columns
    assert out.select("doc_id", "text").distinct().count() == docs.select("doc_id", "text").distinct().count()
    assert mixing.mixed(messy.none(spark)).count() == 0


def test_query(spark, tmp_path):
    messy.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.op10_mixing(spark, str(tmp_path)).columns == ["doc_id", "source", "tokens", "block", "epoch", "weight", "position", "target_met"]
