"""Cheaper ways of tagging and detection give the results of the plain ones."""

import random

from pyspark.sql import functions as F

from maskwright.functions import bio
from maskwright.functions import text as tx
from maskwright.operators import detect, labels
from maskwright.sources.catalog import default_catalog

SPANS = "array<struct<start:int,end:int,label:string>>"


def test_tags_by_count_equal_tags_by_word(spark):
    rnd, rows = random.Random(3), []
    for i in range(400):
        text = "".join(rnd.choice(["Tan", "é", "😀", " ", "\n", " ", "x", ",", "\u0001" if i % 9 == 0 else "-"]) for _ in range(rnd.randint(0, 12)))
        cuts = sorted(rnd.sample(range(len(text) + 4), rnd.randint(0, 4)))
        spans = [(a, b, rnd.choice(["A", "I-X", "O", None])) for a, b in zip(cuts, cuts[1:])]
        if i % 4 == 0:
            rnd.shuffle(spans)
        if i % 7 == 0:
            spans += [(None, 2, "N"), (-1, 1, "L"), (0, 10**9, "R")]
        rows.append((i, text if i % 50 else None, spans if i % 60 else None))
    df = spark.createDataFrame(rows, f"doc_id long, text string, s {SPANS}")
    words = tx.words_at(F.col("text"))
    plain = df.select("doc_id", words["word"].alias("w"), bio.tag_words(words, F.col("s")).alias("t"))
    want = {r.doc_id: (r.w, r.t) for r in plain.collect()}
    got = {r.sent_id: (r.tokens, r.labels) for r in labels.spans_to_bio(df, "s").collect()}
    assert got == want


def test_words_are_not_placed_for_spans_in_order(spark):
    # a word is looked at once per span in order, so a label's plan counts instead of placing words first
    df = spark.createDataFrame([(1, "Mr Tan met Alice Lim.", [(3, 6, "P"), (11, 20, "P")])], f"doc_id long, text string, s {SPANS}")
    out = labels.spans_to_bio(df, "s")
    assert out.first()["labels"] == ["O", "B-P", "O", "B-P", "I-P"]
    below = out._jdf.queryExecution().optimizedPlan().toString().splitlines()[1:]
    assert not any("substring_index" in line for line in below)


def test_rules_build_no_row_for_each_rule(spark):
    df = spark.createDataFrame([("Dr. Lim, S1234567A",)], "text string")
    out = df.select(detect.text_spans("text", default_catalog().rules).alias("s"))
    assert sorted((s.start, s.end, s.label) for s in out.first()["s"]) == [(0, 7, "PERSON"), (9, 18, "NRIC_SG"), (9, 18, "PASSPORT_ID")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("named_struct(") <= 2


def test_values_of_plain_and_other_windows(spark):
    texts = ["nric: S1234567A", "nric: é S1234567A", "nric: xS1234567A", "nric: éS1234567A", "nric 😀 T7654321Z, nric is S1234567A", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = df.select("doc_id", F.explode(detect.context_spans("text", default_catalog().keys)).alias("s")).collect()
    for r in got:
        assert texts[r.doc_id][r.s.start : r.s.end] == r.s.text
    assert {r.doc_id for r in got} == {0, 1, 4}
    assert "regexp_instr" in df.select(detect.context_spans("text", default_catalog().keys))._jdf.queryExecution().optimizedPlan().toString().lower()
