"""From raw documents to packed training sequences.

Toxic documents go, one document of each group of near-duplicates stays (five
words, similarity 0.8), secrets are masked, sources are mixed so that no
document is left out, and what is left is packed. Each stage is written as Parquet and
read again, so a lost executor costs a part of one stage. An empty or null text
passes all stages; columns beyond those of ``documents`` are kept up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import mixing, near_dedup, packing, samples, secrets
from maskwright.llm import toxicity as toxic
from maskwright.sources.sinks import as_table

# SQL can express neither the trained models nor the packing
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learned from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(samples.fold("doc_id", 5) != 0)
    return toxic.clean(docs, toxic.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.kept_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secrets.redacted(docs, secrets.fit(docs, "source", group="source"), "source")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of small sources up to twice."""
    return mixing.mixed(docs, mixing.Mix(entropy=0.95, repeats=2.0, budget="cover")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.packed(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = as_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
