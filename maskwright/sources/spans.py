"""Documents and externally found spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "array<struct<start:int,end:int,label:string,score:double>>"


def valid_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents with a non-empty text; white space alone is a text."""
    return df.filter(F.length(text) >= 1)


def span_fault(start: Column, end: Column, label: Column, length: Column) -> Column:
    """Why a span cannot be used on a text of ``length`` code points; null for a good one."""
    return (
        F.when(start.isNull() | end.isNull(), "no offset")
        .when(label.isNull(), "no label")
        .when(start < 0, "before the text")
        .when(end <= start, "empty")
        .when(end > length, "beyond the text")
    )


def _with_faults(docs: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    lengths = docs.select(key, F.coalesce(F.length(text), F.lit(0)).alias("_n")).dropDuplicates([key])
    fault = span_fault(F.col("start"), F.col("end"), F.col("label"), F.col("_n"))
    known = spans.join(lengths, key, "left")
    return known.withColumn("reason", F.when(F.col("_n").isNull(), "no such document").otherwise(fault)).drop("_n")


def ner_spans_in(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Span rows ``(doc_id, start, end, label, score)`` of known documents that lie within their texts."""
    return _with_faults(docs, spans, key, text).filter("reason is null").drop("reason")


def ner_spans_rejected(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The other span rows, each with its ``reason``."""
    return _with_faults(docs, spans, key, text).filter("reason is not null")


def attach_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id", name: str = "ner") -> DataFrame:
    """Add the spans of each document as an array column, in text order.

    Span rows are small and grouped before they meet the texts. A group is one
    document's spans: no larger in kind than the text itself, which is one cell.
    Tables bucketed by ``key`` join without moving the texts. Offsets are taken as they
    are: recogniser_spans() passes over spans that do not fit the text.
    """
    entry = F.struct("start", F.negative(F.col("end")).alias("_back"), "label", "score")
    grouped = (
        spans.select(key, F.col("start").try_cast("int"), F.col("end").try_cast("int"), "label", F.col("score").cast("double"))
        .groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("_found"))
    )
    found = F.transform(
        "_found",
        lambda e: F.struct(
            e["start"].alias("start"), F.negative(e["_back"]).alias("end"), e["label"].alias("label"), e["score"].alias("score")
        ),
    )
    return (
        docs.join(grouped, key, "left")
        .withColumn(name, F.coalesce(found, F.array().cast(FOUND))).drop("_found")
    )
