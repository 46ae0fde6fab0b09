import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions import text as tx
from maskwright.operators import mixes
from maskwright.plans.training import pseudo_corpus


def run(spark, docs, **limits):
    """Kept ids, and how many documents each range handed to the labeller."""
    asked = []

    def label(part):
        asked.append(part.count())
        return part.select(F.col("doc_id").alias("sent_id"), tx.words(F.col("text")).alias("tokens"))

    kept = mixes.labelled_until(docs, label, **limits)
    return [r.sent_id for r in kept.orderBy("sent_id").collect()], asked


def plain(rows, limit=None, token_limit=None):
    kept, tokens = [], 0
    for i, text in sorted(r for r in rows if r[0] is not None):
        if text.split():
            kept.append(i)
            tokens += len(text.split())
        if kept and ((limit and len(kept) >= limit) or (token_limit and tokens >= token_limit)):
            break
    return kept


LIMITS = [{"limit": 1}, {"limit": 700, "token_limit": 2500}, {"limit": 300, "token_limit": 10**6}]


@pytest.mark.parametrize("limits", LIMITS)
def test_same_rows_and_little_work(spark, limits):
    rng = random.Random(len(str(limits)))
    keys = rng.sample(range(-(10**12), 10**12), 1500)
    rows = [(k, " ".join(["w"] * rng.choice([0, 0, 1, 3, 8, 40]))) for k in keys]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    kept, asked = run(spark, docs, first=64, **limits)
    want = plain(rows, **limits)
    assert kept == want
    # documents up to the last kept one: what a run must label
    needed = sum(1 for k, _ in rows if want and k <= want[-1])
    assert sum(asked) <= max(64, 2 * needed)


def test_a_run_of_empty_documents_goes_on(spark):
    rows = [(i, "" if i < 300 else "a b") for i in range(400)]
    kept, asked = run(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), first=32, limit=3)
    assert kept == [300, 301, 302] and sum(asked) <= 400


def test_null_keys_empty_tables_and_no_limits(spark):
    rows = [(None, "x"), (3, "a"), (1, "b"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert run(spark, docs, limit=9)[0] == [1, 3]
    assert run(spark, docs.limit(0), limit=9) == ([], [0])
    assert run(spark, docs) == ([None, 1, 3], [4])
    with pytest.raises(TypeError):
        run(spark, docs.withColumn("doc_id", F.col("doc_id").cast("string")), limit=1)


def test_raw_documents_are_recognised_as_far_as_needed(spark):
    docs = spark.createDataFrame([(i, "Bob met Eve\n\nand went home") for i in range(2000)], "doc_id bigint, text string")
    none = lambda text: F.array().cast("array<struct<start:int,end:int,label:string>>")
    kept = pseudo_corpus(docs, none, limit=400)
    assert kept.count() == 400 and set(kept.first().labels) == {"O"}
