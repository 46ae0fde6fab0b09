"""Writers of results.

Redacted texts, entity rows and the vault go to separate tables, since the vault
holds the raw values and needs its own access rules.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators import redact, restore

TABLES = ("redacted", "entities", "vault")


@cache
def _local_base() -> str:
    """One temporary folder for this process, removed when it ends."""
    base = tempfile.mkdtemp(prefix="maskwright-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one in ``spark.checkpoint.dir``; a temporary one only where all work is in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table used more than once, and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_of(result: DataFrame, key: str, *by: str) -> dict[str, DataFrame]:
    """The three tables of redact.respond()."""
    return {
        "redacted": result.select(key, *by, "redacted_text"),
        "entities": redact.entity_rows(result, key, *by),
        "vault": restore.vault_rows(result, key) if "seats" in result.columns else redact.vault_rows(result, key),
    }


def write_redaction(result: DataFrame, path: str, key: str = "doc_id", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write the three tables of redact.respond(); texts may be partitioned by document columns.

    With ``seats`` (redact_documents) the vault can restore the texts.
    Detection runs once, into a table below the shared folder that the three are derived from.
    It holds original values like the vault: restrict that folder likewise.
    """
    by = partition_by or []
    wide = as_table(result.select(key, *by, "redacted_text", "entities", "map", *[c for c in ("seats",) if c in result.columns]), "redaction")
    for table, df in tables_of(wide, key, *by).items():
        writer = df.write.mode(mode)
        if by and table != "vault":
            writer = writer.partitionBy(*by)
        writer.parquet(f"{path.rstrip('/')}/{table}")


def write_labels(vocab: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The vocabulary as an ordered list, and as maps label -> id and id -> label."""
    base = path.rstrip("/")
    one = as_table(vocab, "vocabulary").coalesce(1).sortWithinPartitions("id")
    one.select(F.col("label").alias("value")).write.mode(mode).text(f"{base}/labels")
    one.select("label", "id").write.mode(mode).json(f"{base}/label2id")
    one.select("id", "label").write.mode(mode).json(f"{base}/id2label")


def write_metrics(scores: DataFrame, path: str, mode: str = "errorifexists") -> None:
    scores.coalesce(1).write.mode(mode).json(path)
