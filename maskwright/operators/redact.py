"""Redaction: final spans -> rewritten text, entity table and placeholder vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import text as tx
from maskwright.sources import fixed_values as fixed
from maskwright.sources.catalog import Catalog

MARK = (
    "struct<start:int,end:int,label:string,number:int,placeholder:string,text:string,score:double>"
)


def placeholder(label: Column, number: Column) -> Column:
    """``***[LABEL#n]***``"""
    head, middle, tail = fixed.PLACEHOLDER.replace("%s", "\0").replace("%d", "\0").split("\0")
    return F.concat(F.lit(head), label, F.lit(middle), number.cast("string"), F.lit(tail))


def visible(final: Column, catalog: Catalog) -> Column:
    """Final spans with canonical labels, without IGNORE; their text stays as it is."""
    named = F.transform(final, lambda s: s.withField("label", catalog.canonical(s["label"])))
    return F.filter(named, lambda s: s["label"] != "IGNORE")


def numbered(shown: Column) -> Column:
    """Spans with their placeholder; each label counts its own occurrences from 1.

    Labels are taken one by one: a document has few labels, maybe many spans.
    """
    def of_label(label: Column) -> Column:
        mine = F.filter(shown, lambda s: s["label"] == label)
        return F.transform(
            mine,
            lambda s, i: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                label.alias("label"),
                (i + 1).alias("number"),
                placeholder(label, i + 1).alias("placeholder"),
                s["text"].alias("text"),
                s["score"].alias("score"),
            ),
        )

    labels = F.array_distinct(F.transform(shown, lambda s: s["label"]))
    return F.when(
        F.size(shown) > 0, F.sort_array(F.flatten(F.transform(labels, of_label)))
    ).otherwise(F.array().cast(f"array<{MARK}>"))


def mark(df: DataFrame, catalog: Catalog, final: str = "final") -> DataFrame:
    """Add ``marks``: visible spans with number and placeholder."""
    return df.withColumn("marks", tx.let(visible(F.col(final), catalog), numbered))


def rewrite(text: Column, marks: Column) -> Column:
    """The text with each marked span replaced by its placeholder."""
    def render(pieces: Column) -> Column:
        def part(m: Column, i: Column) -> Column:
            begin = F.coalesce(tx.before(marks, i)["end"], F.lit(0))
            return F.concat(tx.cut(pieces, begin, m["start"] - begin), m["placeholder"])

        end = F.element_at(marks, -1)["end"]
        tail = tx.cut(pieces, end, F.length(text) - end)
        return F.concat(F.array_join(F.transform(marks, part), ""), tail)

    return F.when(F.size(marks) > 0, tx.let(tx.chunks(text), render)).otherwise(text)


def seats(marks: Column) -> Column:
    """Where each placeholder stands in the rewritten text, with its label and the original."""
    longer = F.transform(marks, lambda m: F.length(m["placeholder"]) - (m["end"] - m["start"]))

    def all_of(shift: Column) -> Column:
        return F.transform(
            marks,
            lambda m, i: F.struct(
                (m["start"] + tx.item(shift, i)).alias("at"), m["placeholder"].alias("placeholder"), m["label"].alias("label"), m["text"].alias("original")
            ),
        )

    return tx.let(tx.running_totals(longer), all_of)


def preview(value: Column) -> Column:
    n = fixed.PREVIEW_LENGTH
    return F.when(F.length(value) > n, F.concat(F.substring(value, 1, n), F.lit(fixed.PREVIEW_TAIL))).otherwise(value)


def respond(df: DataFrame, text: str = "text", marks: str = "marks") -> DataFrame:
    """Add ``redacted_text``, ``entities`` (in text order) and ``map`` (placeholder -> original)."""
    m = F.col(marks)
    return df.withColumns(
        {
            "redacted_text": rewrite(F.col(text), m),
            "entities": F.transform(
                m,
                lambda e: F.struct(
                    e["label"].alias("type"),
                    e["placeholder"].alias("placeholder"),
                    preview(e["text"]).alias("value_preview"),
                    e["score"].alias("confidence"),
                ),
            ),
            "map": F.map_from_entries(F.transform(m, lambda e: F.struct(e["placeholder"], e["text"]))),
        }
    )


def entity_rows(df: DataFrame, *keep: str) -> DataFrame:
    """One row per entity, numbered from 1 in text order."""
    rows = df.select(*keep, F.posexplode_outer("entities").alias("pos", "e")).filter("e is not null")
    return rows.select(
        *keep, (F.col("pos") + 1).alias("entity_no"), "e.type", "e.placeholder", "e.value_preview", "e.confidence"
    )


def vault_rows(df: DataFrame, *keep: str) -> DataFrame:
    """One row per placeholder with the original value: keep apart from the rest."""
    return df.select(*keep, F.explode_outer("map").alias("placeholder", "original")).filter("placeholder is not null")


def reveal(entities: DataFrame, vault: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entity listing with the original values, where the vault has them.

    An equi join of two tables of small rows; Spark picks the strategy.
    """
    full = F.coalesce(F.nullif(F.col("original"), F.lit("")), F.col("value_preview"), F.lit(""))
    n = fixed.LISTING_LENGTH
    shown = F.when(F.length(full) > n, F.concat(F.substring(full, 1, n), F.lit(fixed.LISTING_TAIL))).otherwise(full)
    return entities.join(vault, [key, "placeholder"], "left").select(
        key, "entity_no", F.replace(F.col("type"), F.lit("_"), F.lit(" ")).alias("entity_type"), shown.alias("shown")
    )


def size_class(text: Column) -> Column:
    """Length class of a text; lengths count UTF-16 units, as a browser does."""
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    return (
        F.when(units > fixed.OVER_LIMIT, "over-limit").when(units > fixed.NEAR_LIMIT, "near-limit").otherwise("ok")
    )
