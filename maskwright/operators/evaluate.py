"""Entity-level scores of predicted tags.

True and predicted tags of a sentence sit in one row, so hits are an array
intersection: the only shuffle is the sum of counts per evaluation set and type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import bio
from maskwright.functions import text as tx

OVERALL = "overall"


def decode_predictions(df: DataFrame, labels: list[str], logits: str = "logits", ids: str = "label_ids") -> DataFrame:
    """Add ``true_tags`` and ``pred_tags``: arg-max class per token (first on ties), ignored positions left out."""
    names = F.array(*[F.lit(x) for x in labels])
    best = F.transform(logits, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))
    pairs = F.filter(
        F.zip_with(F.col(ids), best, lambda t, p: F.struct(t.alias("t"), p.alias("p"))), lambda e: e["t"] != bio.IGNORED
    )
    named = F.transform(pairs, lambda e: F.struct(tx.item(names, e["t"]).alias("t"), tx.item(names, e["p"]).alias("p")))
    return df.withColumn("_pairs", named).withColumns(
        {"true_tags": F.col("_pairs.t"), "pred_tags": F.col("_pairs.p")}
    ).drop("_pairs")


def entity_rows(df: DataFrame, tags: str, *keep: str) -> DataFrame:
    """One row per entity of a tag column."""
    found = tx.let(F.col(tags), bio.entities)
    return tx.each(df, *keep, e=found).select(*keep, "e.type", "e.start", "e.end")


def _counts(true: Column, pred: Column) -> Column:
    """Per sentence: one struct per true, predicted and hit entity."""
    name = lambda e: F.concat_ws(":", e["start"].cast("string"), e["end"].cast("string"), e["type"])
    as_type = lambda x: F.substring(x, F.length(F.substring_index(x, ":", 2)) + 2, F.length(x))

    def row(n_true: int, n_pred: int, n_hit: int):
        return lambda x: F.struct(
            as_type(x).alias("entity_type"), F.lit(n_true).alias("t"), F.lit(n_pred).alias("p"), F.lit(n_hit).alias("h")
        )

    return tx.let(
        F.struct(F.transform(true, name).alias("t"), F.transform(pred, name).alias("p")),
        lambda v: F.concat(
            F.transform(F.array_intersect(v["t"], v["p"]), row(1, 1, 1)),
            F.transform(F.array_except(v["t"], v["p"]), row(1, 0, 0)),
            F.transform(F.array_except(v["p"], v["t"]), row(0, 1, 0)),
        ),
    )


def _score(counted: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("h"), F.col("p")), ratio(F.col("h"), F.col("t"))
    return (
        counted.withColumns({"precision": p, "recall": r})
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )


def entity_counts(df: DataFrame, *by: str, true: str = "true_tags", pred: str = "pred_tags") -> DataFrame:
    """Sums of true, predicted and hit entities per type (and ``by``); type null sums up nothing."""
    per_row = tx.let(
        F.struct(tx.let(F.col(true), bio.entities).alias("t"), tx.let(F.col(pred), bio.entities).alias("p")),
        lambda v: _counts(v["t"], v["p"]),
    )
    # outer, so that a set without any entity keeps one row with no type
    rows = df.select(*by, F.explode_outer(per_row).alias("c")).select(*by, "c.*")
    return rows.groupBy(*by, "entity_type").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("t", "p", "h")])


def scores_by_type(df: DataFrame, *by: str) -> DataFrame:
    return _score(entity_counts(df, *by).filter("entity_type is not null")).select(
        *by, "entity_type", "precision", "recall", "f1", F.col("t").alias("support")
    )


def scores_overall(df: DataFrame, *by: str) -> DataFrame:
    """Micro scores; sentences without entities on both sides still give their set a row of zeros."""
    totals = entity_counts(df, *by).groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("t", "p", "h")])
    return _score(totals).select(*by, "precision", "recall", "f1")


def macro_f1(df: DataFrame, *by: str) -> DataFrame:
    """Mean F1 over the types that occur on either side."""
    return scores_by_type(df, *by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def report(df: DataFrame, by: str = "eval_set") -> DataFrame:
    """Per evaluation set: one row per type and an ``overall`` row with micro scores and macro F1."""
    per_type = entity_counts(df, by)
    scored = _score(per_type)
    grouped = scored.groupBy(by).agg(
        *[F.sum(c).alias(c) for c in ("t", "p", "h")],
        F.coalesce(F.avg(F.when(F.col("entity_type").isNotNull(), F.col("f1"))), F.lit(0.0)).alias("macro_f1"),
    )
    types = scored.filter("entity_type is not null").select(by, "entity_type", "precision", "recall", "f1", F.lit(None).cast("double").alias("macro_f1"))
    overall = _score(grouped).select(by, F.lit(OVERALL).alias("entity_type"), "precision", "recall", "f1", "macro_f1")
    return types.unionByName(overall)
