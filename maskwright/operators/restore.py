"""Restoration: redacted text and vault -> original text, whole or by label.

A vault row says at which offset of the redacted text its placeholder stands, so
text that merely looks like a placeholder is never touched. Vault rows are grouped
per document before they meet the texts: one shuffle of small rows, and an equi join;
tables bucketed by the key join in place. A group is one document's placeholders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import text as tx
from maskwright.operators.redact import rewrite

SEATS = "array<struct<at:int,placeholder:string,original:string,fault:string>>"


def vault_rows(df: DataFrame, *keep: str) -> DataFrame:
    """One row per placeholder of redact_documents(seats=True): where it stands, its label and its original. Keep apart from the rest."""
    return tx.each(df, *keep, _s=F.col("seats")).select(*keep, "_s.at", "_s.placeholder", "_s.label", "_s.original")


def _judged(text: Column, seats: Column) -> Column:
    """Seats with the reason why they cannot be restored, if there is one."""
    def fault(pieces: Column, all_seats: Column, s: Column, i: Column) -> Column:
        fits = (s["at"] >= 0) & (tx.cut(pieces, s["at"], F.length(s["placeholder"])) == s["placeholder"])
        twin = (tx.before(all_seats, i)["at"] == s["at"]) | (tx.item(all_seats, i + 1)["at"] == s["at"])
        return F.when(~F.coalesce(fits, F.lit(False)), "not in the text").when(F.coalesce(twin, F.lit(False)), "two originals")

    def all_of(v: Column) -> Column:
        return F.transform(
            v["seats"],
            lambda s, i: F.struct(
                s["at"].alias("at"), s["placeholder"].alias("placeholder"), s["original"].alias("original"),
                fault(v["pieces"], v["seats"], s, i).alias("fault"),
            ),
        )

    return tx.let(F.struct(tx.chunks(text).alias("pieces"), seats.alias("seats")), all_of)


def _with_seats(redacted: DataFrame, vault: DataFrame, key: str, text: str) -> DataFrame:
    seat = F.struct(F.col("at").try_cast("int").alias("at"), "placeholder", "original")
    grouped = vault.filter(F.col("placeholder").isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(seat)).alias("_seats"))
    judged = F.when(F.size("_seats") > 0, _judged(F.col(text), F.col("_seats"))).otherwise(F.array().cast(SEATS))
    return redacted.join(grouped, key, "left").withColumn("_seats", judged)


def granted(vault: DataFrame, labels: list[str] | None) -> DataFrame:
    """The vault rows a reader may see: those of the given labels, all for None."""
    return vault if labels is None else vault.filter(F.col("label").isin(labels))


def restore(
    redacted: DataFrame, vault: DataFrame, key: str = "doc_id", text: str = "redacted_text", labels: list[str] | None = None, into: str = "restored_text"
) -> DataFrame:
    """Add the text with the placeholders of the vault (of the given labels) replaced by their originals.

    A vault row whose placeholder does not stand at its offset, or for whose place there is another
    original (rows of two documents with one key), leaves the text as it is; unrestored() lists it.
    A null original is an empty one. A document without vault rows, with a null key or a null text stays as it is.
    """
    def marks(seats: Column) -> Column:
        good = F.filter(seats, lambda s: s["fault"].isNull())
        return F.transform(
            good,
            lambda s: F.struct(
                s["at"].alias("start"), (s["at"] + F.length(s["placeholder"])).alias("end"), F.coalesce(s["original"], F.lit("")).alias("placeholder")
            ),
        )

    wide = _with_seats(redacted, granted(vault, labels), key, text)
    return wide.withColumn(into, tx.let(marks(F.col("_seats")), lambda m: rewrite(F.col(text), m))).drop("_seats")


def unrestored(redacted: DataFrame, vault: DataFrame, key: str = "doc_id", text: str = "redacted_text") -> DataFrame:
    """``(key, at, placeholder, reason)``: vault rows that restore() passes over."""
    faults = tx.each(_with_seats(redacted, vault, key, text), key, _s=F.filter("_seats", lambda s: s["fault"].isNotNull()))
    lost = vault.join(redacted.select(key), key, "left_anti")
    return faults.select(key, "_s.at", "_s.placeholder", F.col("_s.fault").alias("reason")).unionByName(
        lost.select(key, F.col("at").try_cast("int").alias("at"), "placeholder", F.lit("no such document").alias("reason"))
    )
