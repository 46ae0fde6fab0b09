from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from maskwright import redact_documents
from maskwright.operators import splits
from maskwright.plans.redaction import entity_cube, find, funnel, observe_stream, observed

ROWS = [(1, "en", "a", "u@mail.example.com and Mr Ong"), (2, None, "a", "x@mail.example.com"), (3, "en", None, "Mr Tan, Mr Lim"), (4, None, None, "nothing"), (5, "fr", "b", None)]


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, lang string, source string, text string").repartition(2)


def test_cube_against_counting(spark):
    result = redact_documents(docs(spark))
    want = Counter()
    for r in result.filter("text is not null").collect():
        for e in r.entities:
            for l, s, t in product([0, 1], repeat=3):
                want[(None if l else r.lang, None if s else r.source, None if t else e.type, 4 * l + 2 * s + t)] += 1
    got = {(r.lang, r.source, r.entity_type, r.level): r.n_entities for r in entity_cube(result, "lang", "source").collect()}
    assert got == want and got[None, None, None, 7] == 5
    assert got[None, "a", "EMAIL", 0] == 1 and got[None, "a", "EMAIL", 4] == 2


def test_observed_totals_cost_no_pass(spark):
    found, totals = observed(find(docs(spark).filter("text is not null")))
    kept = found.select("doc_id", F.size("final").alias("n")).collect()
    counts = funnel(found).agg(F.count("*"), F.sum("n_candidates"), F.sum("n_final")).first()
    assert len(kept) == 4 and tuple(totals.get.values()) == tuple(counts)
    none, totals = observed(find(docs(spark).limit(0)))
    none.collect()
    assert totals.get == {"n_docs": 0, "n_candidates": 0, "n_final": 0}


def test_observed_on_a_stream(spark, tmp_path):
    docs(spark).filter("text is not null").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs(spark).schema).parquet(f"{tmp_path}/in")
    query = (
        observe_stream(find(stream)).select("doc_id").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c")
        .trigger(availableNow=True).start(f"{tmp_path}/out")
    )
    query.awaitTermination()
    seen = [p["observedMetrics"]["funnel"] for p in query.recentProgress if p["observedMetrics"]]
    batch = funnel(find(docs(spark).filter("text is not null"))).agg(F.count("*"), F.sum("n_candidates"), F.sum("n_final")).first()
    assert sum(s["n_docs"] for s in seen) == 4 and sum(s["n_final"] for s in seen) == batch[2]


def test_split_table(spark):
    rows = spark.createDataFrame([("a", "train")] * 3 + [("a", "test")] + [("b", "validation")], "corpus string, split string")
    assert {tuple(r) for r in splits.split_table(rows).collect()} == {("a", 3, 0, 1, 4), ("b", 0, 1, 0, 1)}
