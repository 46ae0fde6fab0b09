"""From corpora to a written training mix: vocabulary, splits, mix, label ids.

Each derived corpus is stored once, below the shared folder, and read by all
steps after it; the mix itself is a union of scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.operators import labels, mixes, splits
from maskwright.sources.corpora import numbered_chunks, paragraph_chunks
from maskwright.sources.sinks import as_table, write_labels


@dataclass(frozen=True)
class Options:
    """``strategy`` is joint, curriculum or sequential; ratios count against the PII train rows."""

    strategy: str = "sequential"
    val: float = 0.1
    test: float = 0.1
    seed: int = 42
    stratify: bool = False
    pseudo_ratio: float | None = None
    general_ratio: float | None = None
    factor: float | None = 2.0
    augment: bool = False
    max_tokens: int = 128


def pseudo_corpus(docs: DataFrame, recognise, groups: list[str] | None = None, limit: int | None = None, token_limit: int | None = None) -> DataFrame:
    """Raw documents (doc_id, text) -> tagged sentences with unique ``sent_id``, one per chunk of a paragraph.

    ``recognise`` maps the text column to an array column of spans (start, end, label); it
    runs over the first chunks only, as far as the limits need.
    """
    def label(chunks: DataFrame) -> DataFrame:
        spans = mixes.allow_groups(recognise(F.col("text")), groups)
        return labels.spans_to_bio(chunks.select(F.col("sent_id").alias("doc_id"), "text", spans.alias("spans")), "spans")

    return mixes.labelled_until(numbered_chunks(paragraph_chunks(docs)), label, limit, token_limit, key="sent_id")


def training_mix(pii: DataFrame, general: DataFrame | None = None, pseudo: DataFrame | None = None, options: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpora (sent_id, tokens, labels) -> the mix with label ids, the held-out PII rows with theirs, and the vocabulary."""
    o = options
    pii = as_table(labels.with_has_pii(labels.sanitize_bio(pii)), "pii")
    general = as_table(general, "general") if general is not None else None
    pseudo = as_table(pseudo, "pseudo") if pseudo is not None else None
    vocab = as_table(labels.label_vocab(*[c for c in (pii, general, pseudo) if c is not None]), "vocabulary")
    parts = as_table(splits.assign_splits(pii, "sent_id", o.val, o.test, o.seed, stratify="has_pii" if o.stratify else None), "split")
    train = parts.filter("split = 'train'").drop("split")
    shares = {"pseudo_ratio": o.pseudo_ratio, "general_ratio": o.general_ratio, "factor": o.factor, "augment": o.augment}
    if o.strategy == "joint":
        mix = mixes.joint_mix(train, pseudo, general, **shares)
    elif o.strategy == "curriculum":
        mix = mixes.curriculum_mix(train, pseudo, general, **shares)
    elif o.strategy == "sequential":
        mix = mixes.sequential_mix(train, general, pseudo, **shares)
    else:
        raise ValueError(f"unknown strategy {o.strategy}")
    coded = lambda df: labels.encode_labels(labels.truncate(df, o.max_tokens), vocab)
    return coded(mix), coded(parts.filter("split <> 'train'")), vocab


def write_training(mix: DataFrame, held_out: DataFrame, vocab: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The mix by stage or phase, the held-out rows by split, and the vocabulary in its three forms."""
    base = path.rstrip("/")
    steps = [c for c in ("stage", "phase") if c in mix.columns]
    mix.write.mode(mode).partitionBy(*steps).parquet(f"{base}/train")
    held_out.write.mode(mode).partitionBy("split").parquet(f"{base}/held_out")
    write_labels(vocab, base, mode)
