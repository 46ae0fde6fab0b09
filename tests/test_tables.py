"""Tables given as a file or a folder, and tasks that do not grow with them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from checks import queries as q
from checks import standins as st
from maskwright.operators import restore
from maskwright.sources import corpora


def test_stream_of_a_table_that_is_a_folder_or_a_file(spark, tmp_path):
    rows = [(i, f"mail a{i}@example.com") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    (part,) = (p for p in Path(tmp_path, "one").glob("*.parquet"))
    (part.parent / "documents.parquet").write_bytes(part.read_bytes())
    for place in ("folder", "one"):
        got = {r.doc_id: r.redacted_text for r in q.redact_stream(spark, f"{tmp_path}/{place}").collect()}
        assert got == {i: "mail ***[EMAIL#1]***" for i in range(6)}


def test_tasks_of_a_table_grow_with_its_rows(spark, tmp_path, monkeypatch):
    spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setitem(st.TASK_ROWS, "documents", 50)
    assert st.table(spark, tmp_path, "documents").rdd.getNumPartitions() == 20
    monkeypatch.setitem(st.TASK_ROWS, "documents", 5_000)
    assert st.table(spark, tmp_path, "documents").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_a_corpus_are_read_once(spark):
    df = spark.createDataFrame([("['a']", "['O']"), ("['a', 'b']", "['O']"), ("x", "['O']")], "tokens string, labels string").cache()
    parsed = corpora.parse_tagged(df)
    assert optimized(parsed).count("from_json") == 2
    assert [tuple(r) for r in parsed.collect()] == [(["a"], ["O"])]


def test_lines_of_a_block_are_split_once(spark):
    df = spark.createDataFrame([("a X Y O\nb X Y B-PER",), ("-DOCSTART- X Y O",)], "value string").cache()
    found = corpora.conll_sentences(df)
    assert optimized(found).count("DOCSTART") == 1
    assert [tuple(r) for r in found.collect()] == [(["a", "b"], ["O", "B-PER"])]


def test_unrestored_aggregates_the_vault_only(spark):
    redacted = spark.createDataFrame([(1, "x ***[A#1]***"), (1, "y")], "doc_id bigint, redacted_text string").cache()
    vault = spark.createDataFrame([(1, 2, "***[A#1]***", "A", "o"), (2, 0, "***[A#1]***", "A", "o")], "doc_id bigint, at int, placeholder string, label string, original string").cache()
    lost = restore.unrestored(redacted, vault)
    assert optimized(lost).count("Aggregate") == 1
    assert sorted((r.doc_id, r.reason) for r in lost.collect()) == [(1, "not in the text"), (2, "no such document")]
