"""The quick paths of short texts against the general ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import queries as q
from maskwright.functions import bio
from maskwright.functions import text as tx
from maskwright.operators import adjudicate, detect
from maskwright.operators import labels as lb


def test_quick_and_general_offsets_and_tags_agree(spark, monkeypatch):
    # a plain text, the mark in a text, accents, an empty text, a null
    rows = [(0, "Mr Tan, a@b.example  x"), (1, "a\u0001b c"), (2, "\u00e9\u00e9 \U0001f600 d "), (3, ""), (4, None), (5, "w " * 700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = [(0, 5, "A"), (4, 12, "B"), (8, 9, "C"), (3, 3, "D"), (2, 1, "E"), (None, 4, "F"), (1, None, "G")]
    at = F.array(*[F.struct(F.lit(s).cast("int").alias("start"), F.lit(e).cast("int").alias("end"), F.lit(x).alias("label")) for s, e, x in spans])

    def now():
        return docs.select("doc_id", tx.words_at(F.col("text")).alias("w"), bio.tag_words(tx.words_at(F.col("text")), at).alias("t")).orderBy("doc_id").collect()

    quick = now()
    monkeypatch.setattr(tx, "SHORT", 0)
    monkeypatch.setattr(bio, "PAIRS", -1)
    assert quick == now()


def test_group_winners_are_the_winners_of_the_groups(spark):
    text = "Payment to Tan Solutions Pte Ltd, mail a.b@tan.example, account number 123-456-7890-1, cvc of 123"
    found = detect.detect(spark.createDataFrame([(1, text), (2, ""), (3, "none")], "doc_id bigint, text string"), q.CATALOG)
    both = found.select(
        tx.let(adjudicate.ordered(F.col("spans")), lambda s: adjudicate.winners(adjudicate.overlap_groups(s))).alias("a"),
        tx.let(adjudicate.ordered(F.col("spans")), adjudicate.group_winners).alias("b"),
    ).collect()
    assert [r.a for r in both] == [r.b for r in both] and len(both[0].a) > 2


def test_short_sentences_are_tagged_without_a_sort(spark):
    """The quick path is taken: with a merge that fails, short texts still get their tags."""
    docs = spark.createDataFrame([(1, "call Tan now")], "doc_id bigint, text string")
    spans = F.array(F.struct(F.lit(5).alias("start"), F.lit(8).alias("end"), F.lit("PERSON").alias("label")))
    plain = bio.ranks
    bio.ranks = lambda points, queries, inclusive: F.transform(plain(points, queries, inclusive), lambda n: F.raise_error(F.lit("sorted")).cast("int"))
    try:
        assert lb.spans_to_bio(docs.withColumn("s", spans), "s").first()["labels"] == ["O", "B-PERSON", "O"]
    finally:
        bio.ranks = plain
