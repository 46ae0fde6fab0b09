import pytest
from pyspark.sql import functions as F

from maskwright import redact_documents
from maskwright.operators import restore
from maskwright.sources import bucketed
from tests.test_redaction import documents


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_meet_in_place(spark, tmp_path, no_broadcast):
    rows = documents(300, 21)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "no key")], "doc_id bigint, text string")
    spans = spark.createDataFrame([(i, s, e, lab, 0.5) for i, _, ner in rows for s, e, lab in ner], "doc_id bigint, start int, end int, label string, score double")
    stored = [bucketed.write_bucketed(df, f"{n}_bucketed", 8, path=f"{tmp_path}/{n}") for n, df in (("docs", docs), ("spans", spans))]
    try:
        out = redact_documents(stored[0], ner_spans=stored[1], seats=True)
        assert "Exchange" not in plan_of(out) and "Exchange" in plan_of(redact_documents(docs, ner_spans=spans))
        want = {(r.doc_id, r.redacted_text) for r in redact_documents(docs, ner_spans=spans).collect()}
        assert {(r.doc_id, r.redacted_text) for r in out.collect()} == want
        # and back again, also in place
        result = bucketed.scratch_bucketed(out.select("doc_id", "redacted_text"), "redacted", 8)
        vault = bucketed.scratch_bucketed(restore.vault_rows(out, "doc_id"), "vault", 8)
        back = restore.restore(result, vault)
        assert "Exchange" not in plan_of(back)
        assert {(r.doc_id, r.restored_text) for r in back.collect()} == {(r.doc_id, r.text) for r in docs.collect()}
    finally:
        for t in ("docs", "spans"):
            spark.sql(f"DROP TABLE IF EXISTS {t}_bucketed")
        for t in ("redacted", "vault"):
            bucketed.drop_scratch(spark, t)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("redacted_", "vault_"))]


def test_other_numbers_of_buckets_still_give_the_result(spark, tmp_path, no_broadcast):
    docs = spark.createDataFrame([(i, f"Zed {i}") for i in range(50)], "doc_id bigint, text string")
    spans = docs.select("doc_id", F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("Z").alias("label"), F.lit(0.5).alias("score"))
    try:
        stored = [bucketed.write_bucketed(df, f"{n}_odd", b, path=f"{tmp_path}/{n}") for n, df, b in (("docs", docs, 3), ("spans", spans, 5))]
        out = redact_documents(stored[0], ner_spans=stored[1])
        assert {r.redacted_text for r in out.collect()} == {f"***[Z#1]*** {i}" for i in range(50)}
        with pytest.raises(Exception, match="already exists"):
            bucketed.write_bucketed(docs, "docs_odd", 3, path=f"{tmp_path}/docs")
    finally:
        for t in ("docs", "spans"):
            spark.sql(f"DROP TABLE IF EXISTS {t}_odd")
