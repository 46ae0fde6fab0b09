"""Tagged sentences: vocabulary, encoding, swap-case copies and sub-word labels.

A corpus is a DataFrame with ``sent_id bigint`` (unique), ``tokens array<string>``
and ``labels array<string>``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import bio
from maskwright.functions import text as tx

# A vocabulary is a map literal of the plan; more labels than this are taken for a mistake in the data.
LABELS = 10_000


def label_vocab(*corpora: DataFrame) -> DataFrame:
    """``(label, id)`` over all corpora: O first (always present), then by type, B before I.

    More than LABELS different labels are an error, so the one cell they are sorted in is bounded.
    """
    seen = [tx.each(c, label=F.array_distinct("labels")) for c in corpora]
    some = reduce(DataFrame.unionByName, seen).distinct().limit(LABELS + 1)
    gathered = some.agg(F.array_union(F.array(F.lit("O")), F.collect_list("label")).alias("all"))
    bounded = F.when(F.size("all") <= LABELS, F.col("all")).otherwise(F.raise_error(F.lit(f"more than {LABELS} labels")).cast("array<string>"))
    in_order = F.array_sort(F.transform(bounded, bio.order_key))
    return gathered.select(F.posexplode(in_order).alias("id", "k")).select(F.col("k.label").alias("label"), "id")


def encode_labels(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``ner_tags``, the label ids; a null label or one outside the vocabulary is an error."""
    rows = vocab.limit(LABELS + 1).collect()
    if len(rows) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    ids = F.create_map(*[F.lit(x) for r in rows for x in (r.label, r.id)]) if rows else F.create_map().cast("map<string,int>")

    def code(t: Column, i: Column) -> Column:
        said = F.concat(F.lit("unknown label "), F.coalesce(t, F.lit("<null>")), F.lit(" at position "), i.cast("string"))
        return F.coalesce(F.try_element_at(ids, t), F.raise_error(said).cast("int"))

    return df.withColumn("ner_tags", F.transform("labels", code))


def sanitize_bio(df: DataFrame) -> DataFrame:
    return df.withColumn("labels", bio.sanitize(F.col("labels")))


def with_has_pii(df: DataFrame) -> DataFrame:
    return df.withColumn("has_pii", bio.has_entity(F.col("labels")))


def spans_to_bio(docs: DataFrame, spans: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts with a span array -> tagged sentences of white-space words."""
    tokens = F.coalesce(tx.words(F.col(text)), F.array().cast("array<string>"))
    placed = docs.select(F.col(key).alias("sent_id"), F.col(spans).alias("_spans"), F.col(text).alias("_text"), tokens.alias("tokens"))
    labels = tx.let(F.col("_spans"), lambda s: bio.tag_text(F.col("_text"), F.size("tokens"), s))
    return placed.select("sent_id", "tokens", labels.alias("labels"))


def add_swapcase(df: DataFrame, tagged: Column | None = None) -> DataFrame:
    """Each ``is_pii`` row with an entity also as a copy with swapped letter case.

    One pass over the rows; ``augmented`` tells the copies apart.
    """
    tagged = bio.has_entity(F.col("labels")) if tagged is None else tagged
    swapped = F.transform("tokens", lambda t: F.when(t.rlike(r"\p{L}"), tx.swap_case(t)).otherwise(t))
    plain = F.struct(F.lit(False).alias("augmented"), F.col("tokens").alias("tokens"))
    copy = F.struct(F.lit(True).alias("augmented"), swapped.alias("tokens"))
    both = F.when(F.col("is_pii") & tagged, F.array(plain, copy)).otherwise(F.array(plain))
    rest = [c for c in df.columns if c != "tokens"]
    return tx.each(df, *rest, _v=both).select(*rest, "_v.tokens", "_v.augmented")


def truncate(df: DataFrame, n: int = 128, *columns: str) -> DataFrame:
    """Cap sequence columns at ``n`` items."""
    return df.withColumns({c: F.slice(c, 1, n) for c in columns or ("tokens", "labels")})


def align_subwords(df: DataFrame, labels: str = "ner_tags", word_ids: str = "word_ids", label_all: bool = False) -> DataFrame:
    """Add ``aligned``: labels of sub-word pieces, given each piece's word number."""
    aligned = tx.let(
        F.struct(F.col(labels).alias("l"), F.col(word_ids).alias("w")), lambda v: bio.align(v["l"], v["w"], label_all)
    )
    return df.withColumn("aligned", aligned)
