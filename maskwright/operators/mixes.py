"""Training mixes: pseudo-label limits, caps, oversampling and the two strategies.

"First rows" means lowest ``sent_id``. Caps and takes are filters on a key
(prefix.py) and copies are made in place by explode(), so a mix is a union of
scans: no row is shuffled. Write the corpora to tables before mixing them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.labels import add_swapcase
from maskwright.operators.prefix import cut_at, head, last_key, row_count
from maskwright.sources.sinks import as_table

# documents that a labelling run begins with
FIRST = 256


def allow_groups(found: Column, groups: list[str] | None) -> Column:
    """Entities of the allowed groups only; no groups keep all."""
    return F.filter(found, lambda e: e["label"].isin(groups)) if groups else found


def emitted(df: DataFrame) -> DataFrame:
    """Rows with at least one token; a text without tokens yields no sentence."""
    return df.filter(F.size("tokens") > 0)


def pseudo_limit(df: DataFrame, limit: int | None = None, token_limit: int | None = None) -> DataFrame:
    """Rows up to a row limit or a token limit, in order; the row that crosses is kept."""
    df = emitted(df)
    if not limit and not token_limit:
        return df
    below = lambda before: (
        (before["rows"] < limit if limit else F.lit(True)) & (before["tokens"] < token_limit if token_limit else F.lit(True))
    )
    return df.filter(F.col("sent_id") <= cut_at(df, "sent_id", {"rows": F.lit(1), "tokens": F.size("tokens")}, below))


def labelled_until(
    docs: DataFrame,
    label: Callable[[DataFrame], DataFrame],
    limit: int | None = None,
    token_limit: int | None = None,
    key: str = "doc_id",
    first: int = FIRST,
) -> DataFrame:
    """pseudo_limit() of ``label(docs)``, labelling little more than it keeps.

    Documents are labelled in ranges of growing keys, each stored once, until the
    limits are met; only then is the cut found among the stored rows. A range is
    as large as what the rows so far say is still needed, and never larger than
    all ranges before it, so that at most twice the kept documents (or ``first``) are labelled.
    Ranges are found from the key column alone. ``label`` maps documents to rows with
    ``sent_id`` (their key) and ``tokens``. Keys are unique integers; a document with a null key has no place in the order and is left out.
    Without limits all documents are labelled at once.
    """
    if not limit and not token_limit:
        return emitted(label(docs))
    rest, size, seen, rows, tokens, done = docs.filter(F.col(key).isNotNull()), first, 0, 0, 0, []
    while True:
        last = last_key(rest, key, {"rows": F.lit(1)}, lambda before: before["rows"] < size)
        part = as_table(emitted(label(rest.filter(F.col(key) <= F.lit(last)))), "labelled")
        done.append(part)
        got = part.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
        seen, rows, tokens = seen + size, rows + got[0], tokens + got[1]
        # the share of the nearer limit that is met, read as a share of the documents needed
        share = max(rows / limit if limit else 0.0, tokens / token_limit if token_limit else 0.0)
        if last is None or share >= 1:
            return pseudo_limit(reduce(DataFrame.unionByName, done), limit, token_limit)
        size = max(1, min(seen, int(seen / share * 1.05) - seen + 1)) if share else seen
        rest = rest.filter(F.col(key) > last)


def pseudo_stats(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts of one labelling run: ``rows`` is what pseudo_limit() kept of ``docs``.

    Like the run itself, documents without entities are counted up to the last kept row.
    """
    kept = rows.agg(
        F.count(F.lit(1)).alias("emitted_rows"),
        F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum((F.size("spans") == 0).cast("bigint")), F.lit(0)).alias("empty_entities"),
    )
    return kept.select(
        row_count(docs).alias("processed_docs"), "emitted_rows", "empty_entities", "total_tokens"
    )


def cap_by_ratio(df: DataFrame, max_ratio: float | None, base: int, key: str = "sent_id") -> DataFrame:
    """The first int(base * max_ratio) rows; no cap for no ratio, no base, or a cap of 0."""
    cap = int(base * max_ratio) if max_ratio is not None and max_ratio > 0 else 0
    return head(df, key, cap) if cap > 0 else df


def copies(df: DataFrame, factor: float, take: int = 0, key: str = "sent_id") -> DataFrame:
    """int(factor) copies of each row and one more of the first ``take`` rows; adds ``copy``."""
    whole = max(1, int(factor))
    n = F.lit(whole)
    if take > 0 and factor > whole:
        last = cut_at(df, key, {"rows": F.lit(1)}, lambda before: before["rows"] < take)
        n = n + F.coalesce((F.col(key) <= last).cast("int"), F.lit(0))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))


def oversample(df: DataFrame, factor: float | None) -> DataFrame:
    """Repeat rows ``factor`` times; the fraction repeats the first rows once more."""
    if not factor or factor <= 1.0:
        return df.withColumn("copy", F.lit(0))
    return copies(df, factor, int(df.count() * (factor - int(factor))))


def _pii_part(pii: DataFrame, n_pii: int, pseudo: DataFrame | None, factor: float | None) -> DataFrame:
    """PII rows, then pseudo rows, oversampled as one list."""
    name = lambda df, corpus: df.select("sent_id", "tokens", "labels").withColumn("corpus", F.lit(corpus))
    parts = [name(pii, "pii")] + ([name(pseudo, "pseudo")] if pseudo is not None else [])
    if factor and factor > 1.0:
        n_all = n_pii + (pseudo.count() if pseudo is not None else 0)
        take = int(n_all * (factor - int(factor)))
        parts = [copies(p, factor, t) for p, t in zip(parts, (take, take - n_pii))]
    else:
        parts = [p.withColumn("copy", F.lit(0)) for p in parts]
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("is_pii", F.lit(True))


def _finish(df: DataFrame, augment: bool) -> DataFrame:
    return add_swapcase(df) if augment else df.withColumn("augmented", F.lit(False))


def joint_mix(
    pii: DataFrame,
    pseudo: DataFrame | None = None,
    general: DataFrame | None = None,
    pseudo_ratio: float | None = None,
    general_ratio: float | None = None,
    factor: float | None = 2.0,
    augment: bool = False,
) -> DataFrame:
    """One training set of PII, capped pseudo and capped general rows.

    Only PII and pseudo rows are repeated and augmented. Ratios count against the PII rows.
    """
    if pii is None:
        raise ValueError("the PII train split is missing")
    base = pii.count()
    pseudo = cap_by_ratio(pseudo, pseudo_ratio, base) if pseudo is not None else None
    general = cap_by_ratio(general, general_ratio, base) if general is not None else None
    return _joint(pii, base, pseudo, general, factor, augment)


def _joint(pii, n_pii: int, pseudo, general, factor, augment: bool) -> DataFrame:
    """joint_mix() of corpora that are capped already."""
    mix = _pii_part(pii, n_pii, pseudo, factor)
    if general is not None:
        plain = general.select(
            "sent_id", "tokens", "labels",
            F.lit("conll").alias("corpus"), F.lit(0).alias("copy"), F.lit(False).alias("is_pii"),
        )
        mix = mix.unionByName(plain)
    return _finish(mix, augment)


def curriculum_mix(
    pii: DataFrame,
    pseudo: DataFrame | None,
    general: DataFrame | None,
    pseudo_ratio: float | None = None,
    general_ratio: float | None = None,
    factor: float | None = 2.0,
    augment: bool = False,
) -> DataFrame:
    """Phase 1 without pseudo rows, phase 2 with them; ``phase`` tells them apart. Both share the cuts."""
    base = pii.count()
    pseudo = cap_by_ratio(pseudo, pseudo_ratio, base) if pseudo is not None else None
    general = cap_by_ratio(general, general_ratio, base) if general is not None else None
    phases = [_joint(pii, base, p, general, factor, augment) for p in (None, pseudo)]
    return phases[0].withColumn("phase", F.lit(1)).unionByName(phases[1].withColumn("phase", F.lit(2)))


def sequential_mix(
    pii: DataFrame,
    general: DataFrame,
    pseudo: DataFrame | None = None,
    pseudo_ratio: float | None = None,
    general_ratio: float | None = None,
    factor: float | None = 2.0,
    augment: bool = False,
) -> DataFrame:
    """Stage 1: general rows, capped against PII. Stage 2: PII and pseudo rows."""
    if pii is None or general is None:
        raise ValueError("the sequential strategy needs a PII and a general train split")
    base = pii.count()
    first = cap_by_ratio(general, general_ratio, base).select(
        "sent_id", "tokens", "labels", F.lit("conll").alias("corpus"), F.lit(0).alias("copy"),
        F.lit(False).alias("is_pii"), F.lit(False).alias("augmented"), F.lit(1).alias("stage"),
    )
    pseudo = cap_by_ratio(pseudo, pseudo_ratio, base) if pseudo is not None else None
    second = _finish(_pii_part(pii, base, pseudo, factor), augment).withColumn("stage", F.lit(2))
    return first.unionByName(second)
