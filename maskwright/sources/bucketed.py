"""Bucketed tables: documents, spans and vaults stored by their key, so that they meet in place.

Two tables with the same number of buckets of one key are joined and grouped by it
where they lie: no exchange of texts, whatever they are redacted or restored with, and as
often as wanted. The dealing is paid once, when a table is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from maskwright.sources.sinks import scratch_path


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "doc_id", path: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """Write ``df`` as a table of ``buckets`` buckets by ``key``, sorted in each, and give it back as read.

    Each bucket is dealt to one task before it is written, so a table has one file a bucket. A key
    with very many rows makes one bucket large; a document's rows are bounded by the document.
    ``path`` makes the table external. Choose buckets for some hundred megabytes each, and the same number for all tables that meet.
    """
    writer = df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def scratch_bucketed(df: DataFrame, name: str, buckets: int, key: str = "doc_id") -> DataFrame:
    """The same below the shared folder, under a name of its own; drop_scratch() takes it out of the catalog."""
    table = f"{name}_{uuid.uuid4().hex}"
    return write_bucketed(df, table, buckets, key, scratch_path(df.sparkSession, table))


def drop_scratch(spark: SparkSession, name: str) -> None:
    """Drop the catalog's entries of scratch_bucketed() tables of a name; files below the shared folder are its owner's."""
    for t in spark.catalog.listTables(pattern=f"{name}_*"):
        spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
