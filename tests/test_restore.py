import random

from pyspark.sql import functions as F

from maskwright import redact_documents
from maskwright.operators import restore
from maskwright.sources import sinks
from tests.test_redaction import documents

FALSE = ["***[EMAIL#1]***", "***[PERSON#1]***", "***[", "]***", "***[X#0]***", "***"]


def fuzzed(spark, n, seed):
    rng = random.Random(seed)
    rows = [(i, "".join(t for part in text.split(" ") for t in (part, rng.choice([" ", " ", *FALSE])))) for i, text, _ in documents(n, seed)]
    return rows, spark.createDataFrame([*rows, (n, ""), (n + 1, None)], "doc_id bigint, text string").repartition(3)


def test_restored_texts_are_the_originals(spark, tmp_path):
    rows, docs = fuzzed(spark, 400, 3)
    sinks.write_redaction(redact_documents(docs, seats=True), f"{tmp_path}/out")
    redacted, vault = (spark.read.parquet(f"{tmp_path}/out/{t}") for t in ("redacted", "vault"))
    assert vault.columns == ["doc_id", "at", "placeholder", "label", "original"]
    out = {r.doc_id: r for r in restore.restore(redacted, vault).collect()}
    assert {i: r.restored_text for i, r in out.items()} == {**dict(rows), 400: "", 401: None}
    assert sum(r.restored_text != r.redacted_text for r in out.values() if r.redacted_text) > 200
    assert restore.unrestored(redacted, vault).count() == 0


def test_access_by_label(spark):
    _, docs = fuzzed(spark, 200, 5)
    result = redact_documents(docs, seats=True).cache()
    vault = restore.vault_rows(result, "doc_id")
    got = {r.doc_id: r.restored_text for r in restore.restore(result.drop("seats"), vault, labels=["EMAIL", "DATE"]).collect()}
    for r in result.filter("text is not null").collect():
        want, shift = r.redacted_text, 0
        for s in r.seats:
            if s.label in ("EMAIL", "DATE"):
                at = s.at + shift
                want = want[:at] + s.original + want[at + len(s.placeholder):]
                shift += len(s.original) - len(s.placeholder)
        assert got[r.doc_id] == want
    assert restore.restore(result.drop("seats"), vault, labels=[]).filter("restored_text <> redacted_text").count() == 0


def test_faulty_vaults_leave_the_text(spark):
    redacted = spark.createDataFrame([(1, "a ***[X#1]*** b"), (2, "c ***[X#1]***"), (3, "d"), (None, "***[X#1]***")], "doc_id bigint, redacted_text string")
    rows = [(1, 2, "***[X#1]***", "X", None), (2, 2, "***[X#1]***", "X", "one"), (2, 2, "***[X#1]***", "X", "two"), (3, 0, "***[X#1]***", "X", "e"),
            (3, -4, "d", "X", "e"), (4, 0, "***[X#1]***", "X", "e"), (None, 0, "***[X#1]***", "X", "e"), (1, None, "***[X#1]***", "X", "e"), (1, 2**40, "b", "X", "e")]
    vault = spark.createDataFrame(rows, "doc_id bigint, at bigint, placeholder string, label string, original string")
    got = {r.doc_id: r.restored_text for r in restore.restore(redacted, vault).collect()}
    assert got == {1: "a  b", 2: "c ***[X#1]***", 3: "d", None: "***[X#1]***"}
    reasons = sorted((r.doc_id or 0, r.reason) for r in restore.unrestored(redacted, vault).collect())
    assert reasons == [
        (0, "no such document"), (1, "not in the text"), (1, "not in the text"), (2, "two originals"), (2, "two originals"),
        (3, "not in the text"), (3, "not in the text"), (4, "no such document"),
    ]


def test_long_documents(spark):
    text = " ".join(f"u{i}@mail.example.com 😀 ***[EMAIL#{i}]***" for i in range(1500))
    result = redact_documents(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), seats=True)
    assert restore.restore(result, restore.vault_rows(result, "doc_id")).first().restored_text == text


def test_only_small_rows_are_grouped(spark):
    redacted = spark.createDataFrame([(1, "a")], "doc_id bigint, redacted_text string")
    vault = spark.createDataFrame([(1, 0, "p", "X", "o")], "doc_id bigint, at int, placeholder string, label string, original string")
    plan = restore.restore(redacted, vault).select("doc_id", F.length("restored_text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
