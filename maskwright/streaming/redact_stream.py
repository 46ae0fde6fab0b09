"""Streaming redaction.

Redaction is a projection of each row, without state or shuffle, so the batch
plan runs on a stream as it is. Spans of a recogniser that come as a stream of their
own wait with their documents in the state of a time-interval join, as long as told.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from maskwright.plans.redaction import redact_documents
from maskwright.sources.catalog import Catalog
from maskwright.sources.sinks import as_table, tables_of


def redact_stream(docs: DataFrame, catalog: Catalog | None = None, ner: str | None = None) -> DataFrame:
    """A stream of documents -> a stream of responses; ``ner`` names an array column of recogniser spans."""
    return redact_documents(docs, catalog, ner=ner)


@dataclass(frozen=True)
class Wait:
    """How long after its document a span may be found (``found_at`` against ``at``), and how late rows may come (watermark)."""

    spans: str = "10 minutes"
    rows: str = "10 minutes"


def _sides(docs: DataFrame, spans: DataFrame, wait: Wait) -> tuple[DataFrame, DataFrame, Column]:
    left = docs.withWatermark("at", wait.rows)
    right = spans.select(F.col("doc_id").alias("_doc"), "start", "end", "label", "score", "found_at").withWatermark("found_at", wait.rows)
    met = (F.col("doc_id") == F.col("_doc")) & (F.col("found_at") >= F.col("at")) & (F.col("found_at") <= F.col("at") + F.expr(f"interval {wait.spans}"))
    return left, right, met


def with_spans(docs: DataFrame, spans: DataFrame, wait: Wait = Wait()) -> DataFrame:
    """Streams ``(doc_id, at, text)`` and ``(doc_id, start, end, label, score, found_at)`` -> ``(doc_id, at, text, ner)``.

    A document leaves once no more span can be found for it, with those found in time, or with none. The join holds
    documents for the time of ``wait`` and spans likewise; then one document's spans are gathered, as in the batch.
    ``(doc_id, at)`` is a document's key; of several texts with one key the least is taken. Rows at or before the watermark,
    which begins at 1970, are late. Append mode.
    """
    left, right, met = _sides(docs.select("doc_id", "at", "text"), spans, wait)
    back = F.negative(F.col("end").try_cast("int"))
    entry = F.when(F.col("_doc").isNotNull(), F.struct(F.col("start").try_cast("int").alias("start"), back.alias("_back"), "label", F.col("score").cast("double").alias("score")))
    gathered = left.join(right, met, "left_outer").groupBy("doc_id", "at").agg(F.min("text").alias("text"), F.sort_array(F.collect_list(entry)).alias("_found"))
    ner = F.transform(
        "_found", lambda e: F.struct(e["start"].alias("start"), F.negative(e["_back"]).alias("end"), e["label"].alias("label"), e["score"].alias("score"))
    )
    return gathered.select("doc_id", "at", "text", ner.alias("ner"))


def span_rejects(docs: DataFrame, spans: DataFrame, wait: Wait = Wait()) -> DataFrame:
    """The other side as a stream of its own: spans that met no document, since there is none or they were found too late or too early."""
    left, right, met = _sides(docs.select("doc_id", "at"), spans, wait)
    lost = right.join(left, met, "left_outer").filter(F.col("doc_id").isNull())
    return lost.select(F.col("_doc").alias("doc_id"), "start", "end", "label", "score", "found_at")


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for the queries started within: a query copies those of its session when it starts."""
    was = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_joined_sink(
    docs: DataFrame, spans: DataFrame, path: str, checkpoint: str, wait: Wait = Wait(), catalog: Catalog | None = None,
    state_parts: int | None = None, more: bool = False, **trigger,
) -> tuple[StreamingQuery, StreamingQuery]:
    """Stream ``redacted`` texts and span ``rejects`` to parquet tables below ``path``: two queries with checkpoints of their own.

    State is dealt to ``state_parts`` (None: as many as the session shuffles to), for as long as the checkpoint lives. Each costs
    nine state stores, which write files in every batch: take as many as the rows need, not more. ``more``: a later run brings
    more rows, so what is due leaves with them and not in a batch of its own at the end of this one.
    """
    texts = redact_stream(with_spans(docs, spans, wait), catalog, ner="ner").select("doc_id", "at", "redacted_text")
    settings = {"spark.sql.shuffle.partitions": str(state_parts)} if state_parts else {}
    if more:
        settings["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"

    def start(out: DataFrame, name: str) -> StreamingQuery:
        writer = (
            out.writeStream.format("parquet").outputMode("append").option("path", f"{path.rstrip('/')}/{name}")
            .option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name}").trigger(**(trigger or {"availableNow": True}))
        )
        with _settings(out.sparkSession, settings):
            return writer.start()

    return start(texts, "redacted"), start(span_rejects(docs, spans, wait), "rejects")


def start_text_sink(docs: DataFrame, path: str, checkpoint: str, catalog: Catalog | None = None, **trigger) -> StreamingQuery:
    """Stream the redacted texts to parquet files, each exactly once."""
    out = redact_stream(docs, catalog).select("doc_id", "redacted_text")
    return (
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def start_table_sink(docs: DataFrame, path: str, checkpoint: str, catalog: Catalog | None = None, **trigger) -> StreamingQuery:
    """Stream texts, entity rows and vault to three tables, partitioned by batch.

    A batch that is run again overwrites its own partition only.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        wide = as_table(batch.select("doc_id", "redacted_text", "entities", "map"), "redaction")
        for table, df in tables_of(wide, "doc_id").items():
            df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{table}/batch_id={batch_id}")

    return (
        redact_stream(docs, catalog).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
