"""Documents -> redacted documents, in one pass without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from maskwright.functions import text as tx
from maskwright.operators import adjudicate, detect, redact
from maskwright.sources.catalog import Catalog, default_catalog
from maskwright.sources.spans import attach_spans


def find(docs: DataFrame, catalog: Catalog | None = None, text: str = "text", ner: str | None = None) -> DataFrame:
    """Documents with candidate (``spans``) and adjudicated spans (``final``)."""
    return adjudicate.adjudicate(detect.detect(docs, catalog or default_catalog(), text, ner), text)


def redact_documents(
    docs: DataFrame,
    catalog: Catalog | None = None,
    text: str = "text",
    ner_spans: DataFrame | None = None,
    key: str = "doc_id",
    ner: str | None = None,
    seats: bool = False,
) -> DataFrame:
    """Add ``redacted_text``, ``entities`` and ``map``; works on batch and streaming tables alike.

    ``seats`` adds a column of that name: what restoration needs, see operators/restore.py.

    ``ner_spans`` are an optional table of recogniser spans (batch only); ``ner`` names an
    array column of them instead. Filters on the result do not run detection again.
    """
    catalog = catalog or default_catalog()
    if ner_spans is not None:
        docs, ner = attach_spans(docs, ner_spans, key, "_ner"), "_ner"
    marked = redact.mark(find(docs, catalog, text, ner), catalog).drop("spans", "final", "_ner")
    out = redact.respond(tx.once(marked, "marks"), text)
    return (out.withColumn("seats", redact.seats(F.col("marks"))) if seats else out).drop("marks")


def funnel(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Candidate and final spans of each document of find()."""
    return found.select(key, *_counts())


def _counts() -> list[Column]:
    return [F.size("spans").cast("bigint").alias("n_candidates"), F.size("final").cast("bigint").alias("n_final")]


def observed(found: DataFrame, name: str = "funnel") -> tuple[DataFrame, Observation]:
    """The table of find() as it is, and an observation that holds the funnel's totals once an action has run over it.

    The totals are taken on the way, so they cost no second pass; a filter or limit after
    this one does not change them, but an action that stops early, such as head(), sees part of the rows.
    For a stream use observe_stream().
    """
    totals = Observation(name)
    return found.observe(totals, *_totals()), totals


def observe_stream(found: DataFrame, name: str = "funnel") -> DataFrame:
    """The same on a stream: each batch's progress holds the totals under ``observedMetrics`` and the name."""
    return found.observe(name, *_totals())


def _totals() -> list[Column]:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in zip(_counts(), ("n_candidates", "n_final"), strict=True)]
    return [F.count(F.lit(1)).alias("n_docs"), *sums]


def entity_totals(result: DataFrame, *by: str) -> DataFrame:
    """Entities per label and the given document columns."""
    rows = tx.each(result, *by, entity_type=F.col("entities.type"))
    return rows.groupBy(*by, "entity_type").agg(F.count(F.lit(1)).alias("n_entities"))


def entity_cube(result: DataFrame, *by: str) -> DataFrame:
    """entity_totals() with all subtotals: a column is null where it is summed over, and ``level`` tells that from a null value.

    ``level`` has a bit for each of ``by`` and the label, the first one highest, set where the column is summed over.
    One aggregate: counts per label and ``by`` are made where the rows lie and only they are multiplied by the grouping sets.
    """
    counts = entity_totals(result, *by)
    level = F.grouping_id(*by, "entity_type").cast("int").alias("level")
    return counts.cube(*by, "entity_type").agg(level, F.sum("n_entities").alias("n_entities"))
