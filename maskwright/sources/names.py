"""Synonyms as a table, for lists of names of any length.

A catalog holds its synonyms as a map literal, which is right for some thousand
names. A longer list stays a table ``(name, canonical)``: rows are mapped by a join, and a
catalog for the redaction of given spans takes only the names that occur.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.sources.catalog import Catalog

#: Names that are sent to all tasks at most, and labels that a catalog may hold.
SENT, LABELS = 1 << 17, 10_000
SALT = 16


def invert(lists: DataFrame) -> DataFrame:
    """``(canonical, names, pos)`` -> ``(name, canonical)``: upper-cased names, each canonical one included; the greatest ``pos`` wins."""
    each = lists.select("canonical", "pos", F.explode(F.array_distinct(F.concat(F.coalesce("names", F.array().cast("array<string>")), F.array("canonical")))).alias("name"))
    return each.filter("name is not null").groupBy(F.upper("name").alias("name")).agg(F.max_by("canonical", F.struct("pos", "canonical")).alias("canonical"))


def canonical_rows(rows: DataFrame, names: DataFrame, label: str = "label") -> DataFrame:
    """Rows with their label upper-cased and, where it has one, mapped to its canonical name.

    ``names`` are sent to all tasks if a count finds them few enough. Beyond that only the
    names that occur are counted, and beyond that, too, both sides are joined with each name in SALT
    copies, since a few labels have most of the rows. A null label stays null.
    """
    up = F.upper(F.col(label))
    names = names.select(F.col("name").alias("_name"), F.col("canonical").alias("_canonical"))
    few = lambda df: df.limit(SENT + 1).count() <= SENT
    if not few(names):
        names = names.join(rows.select(up.alias("_name")).distinct(), "_name")
    if few(names):
        met = rows.join(F.broadcast(names), up == F.col("_name"), "left")
    else:
        copies = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salted = rows.withColumn("_at", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
        met = salted.join(copies, (up == F.col("_name")) & (F.col("_at") == F.col("_salt")), "left")
    return met.withColumn(label, F.coalesce("_canonical", up)).select(*rows.columns)


def catalog_for(catalog: Catalog, names: DataFrame, spans: DataFrame, label: str = "label") -> Catalog:
    """The catalog with those synonyms of a table that the labels of ``spans`` and of its own rules need, now or when they are mapped again."""
    spark = names.sparkSession
    own = sorted({r.label for r in catalog.rules} | {k.label for k in catalog.keys})
    labels = spans.select(F.upper(label).alias("name")).filter("name is not null")
    if own:
        labels = labels.unionByName(spark.createDataFrame([(x.upper(),) for x in own], "name string"))
    found: dict[str, str] = {}
    for _ in range(2):
        rows = names.join(labels.distinct(), "name").select("name", "canonical").limit(LABELS + 1).collect()
        if len(rows) > LABELS:
            raise ValueError(f"more than {LABELS} different labels occur; map them with canonical_rows()")
        new = {r["name"]: r["canonical"] for r in rows}
        found.update(new)
        if not new:
            break
        labels = spark.createDataFrame([(c.upper(),) for c in new.values()], "name string")
    return replace(catalog, synonyms=found)
