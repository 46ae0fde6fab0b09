"""Stand-ins for inputs that come with no data: recogniser spans, corpora, predictions.

All derive from the whole driver tables, in Spark here and in SQL in oracle.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import text as tx
from maskwright.operators import adjudicate, detect, labels, mixes, splits
from maskwright.plans.notes import notes as notes_of
from maskwright.sources.catalog import TextRule, default_catalog
from maskwright.sources.sinks import as_table
from maskwright.sources.spans import attach_spans

SEED = 42
VAL, TEST = 0.1, 0.1

# label, pattern: what the stand-in recogniser finds in the notes
NER_RULES = [
    ("PERSON", r"\b(?:Alice|Brandon|Chloe|Daniel|Evelyn|Farid|Grace|Hassan)\b"),
    ("GPE", r"\b(?:Singapore|fine)\b"),
    ("Loc", r"\b(?:Orchard|all)\b"),
    ("ORG", r"\b[A-Z][a-z]+ (?:Solutions|Realty|Holdings)\b"),
    ("org", r"\bNRIC\b"),
    ("CARDINAL", r"\b\d{1,3}\b"),
]
# words of which one stands in every match
NEEDED = {
    pattern: tuple(words.split("|"))
    for (_, pattern), words in zip(NER_RULES, ["Alice|Brandon|Chloe|Daniel|Evelyn|Farid|Grace|Hassan", "Singapore|fine", "Orchard|all", "Solutions|Realty|Holdings", "NRIC"])
}
# what it finds in the conversations
PSEUDO_RULES = [("PER", r"\b[A-Z][a-z]+\b"), ("MISC", r"\b\d+\b")]
PSEUDO_GROUPS = ["PER"]
# token patterns that stand for the tags of a general corpus
GENERAL_TAGS = [("B-ORG", "^[A-Z]{2,}$"), ("I-PER", "^[A-Z][a-z]+$"), ("MISC", "^[0-9]+$")]


TASK_ROWS = {"orders": 50_000, "documents": 5_000, "conversations": 20_000}
KEYS = {"orders": "o_orderkey", "documents": "doc_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table over all cores: the test files hold one row group each, which one task would read.

    Tasks stay as small as they are on a small table: their number grows with the rows, which the files' footers tell.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS[name])), KEYS[name])


def notes(spark: SparkSession, sf: str) -> DataFrame:
    return notes_of(spark, table(spark, sf, "orders"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Notes and documents together."""
    docs = table(spark, sf, "documents").select(F.lit("documents").alias("src"), "doc_id", "text")
    return notes(spark, sf).select(F.lit("notes").alias("src"), "doc_id", "text").unionByName(docs)


def _found(text: str, rules: list[tuple[str, str]]) -> Column:
    spans = detect.text_spans(text, [TextRule(i, lab, pat, 60, NEEDED.get(pat, ())) for i, (lab, pat) in enumerate(rules)])
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.lit(0.9).alias("score")),
    )


def ner_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, start, end, label, score)`` as any recogniser would deliver them."""
    return tx.each(docs, "doc_id", e=_found("text", NER_RULES)).select("doc_id", "e.*")


def notes_with_ner(spark: SparkSession, sf: str) -> DataFrame:
    docs = notes(spark, sf)
    return attach_spans(docs, ner_rows(docs))


def detected(spark: SparkSession, sf: str) -> DataFrame:
    """Notes with candidate spans of all three kinds."""
    return detect.detect(notes_with_ner(spark, sf), default_catalog(), ner="ner").drop("ner")


def adjudicated(spark: SparkSession, sf: str) -> DataFrame:
    return adjudicate.adjudicate(detected(spark, sf))


def tagged_notes(spark: SparkSession, sf: str) -> DataFrame:
    """The PII corpus: words of the notes, tagged from their final spans."""
    return labels.spans_to_bio(adjudicated(spark, sf), "final")


def damaged_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Tagged notes with some B turned into I and some tags without a prefix."""
    def hurt(tag: Column, i: Column) -> Column:
        n = F.col("sent_id") + i
        return (
            F.when((n % 7 == 0) & (tag != "O"), F.substring(tag, F.lit(3), F.length(tag)))
            .when((n % 3 == 0) & tag.startswith("B-"), F.concat(F.lit("I-"), F.substring(tag, F.lit(3), F.length(tag))))
            .otherwise(tag)
        )

    return tagged_notes(spark, sf).withColumn("labels", F.transform("labels", hurt))


def general(spark: SparkSession, sf: str) -> DataFrame:
    """The general corpus: words of the documents, tags by token shape (not repaired)."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("sent_id"), tx.words(F.col("text")).alias("tokens"))

    def tag(t: Column) -> Column:
        out = F.lit("O")
        for name, pattern in reversed(GENERAL_TAGS):
            out = F.when(t.rlike(pattern), name).otherwise(out)
        return out

    return docs.select("sent_id", "tokens", F.transform("tokens", tag).alias("labels"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as documents."""
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


def with_groups(docs: DataFrame) -> DataFrame:
    """Documents with the spans of the allowed groups."""
    found = docs.withColumn("found", _found("text", PSEUDO_RULES))
    return found.select("doc_id", "text", mixes.allow_groups(F.col("found"), PSEUDO_GROUPS).alias("spans"))


def conversation_docs(spark: SparkSession, sf: str) -> DataFrame:
    return with_groups(turns(spark, sf))


def pseudo(spark: SparkSession, sf: str) -> DataFrame:
    """The pseudo-labelled corpus, one sentence per turn."""
    return mixes.emitted(labels.spans_to_bio(conversation_docs(spark, sf), "spans"))


def split_notes(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign_splits(as_table(tagged_notes(spark, sf), "tagged"), "sent_id", VAL, TEST, SEED)


def split_general(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign_splits(as_table(general(spark, sf), "general"), "sent_id", VAL, TEST, SEED)


def corpora(spark: SparkSession, sf: str) -> DataFrame:
    """Both corpora with their splits."""
    pii = split_notes(spark, sf).withColumn("corpus", F.lit("pii"))
    return pii.unionByName(split_general(spark, sf).withColumn("corpus", F.lit("conll")))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out sentences with repaired true tags and disturbed predictions."""
    held_out = labels.sanitize_bio(splits.eval_sets(corpora(spark, sf)).select("eval_set", "sent_id", "labels"))

    def disturbed(tag: Column, i: Column) -> Column:
        n = F.col("sent_id") + i
        return F.when(n % 7 == 0, "O").when(n % 11 == 0, "B-MISC").when((n % 13 == 0) & (tag != "O"), "I-PERSON").otherwise(tag)

    return held_out.select(
        "eval_set", "sent_id", F.col("labels").alias("true_tags"), F.transform("labels", disturbed).alias("pred_tags")
    )
