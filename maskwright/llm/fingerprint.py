"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph is hashed to a wide vector, and a document's fingerprint is the
sum of its paragraphs' vectors modulo powers of two. So the order of paragraphs
does not matter, and a paragraph is put in or taken out by one addition or
subtraction. A paragraph is a line; a line longer than SPAN characters counts as
several, cut every SPAN characters from its start, so that long single lines
can also be compared in part. A line end belongs to what it ends: every
character is hashed.

The vector holds a count, EQUAL wide lanes for equality, and 60 narrow lanes of
one hash bit each, three to a word. A difference of the narrow lanes read as
signs has the number of differing paragraphs (squared multiplicities) as its mean square, which
gives the likeness of two texts without the texts. The hash is not meant to
withstand forgers.

Built-in SQL functions only. Texts move once, to meet the next document.

Defined cases: a null text is empty; an empty text has the zero fingerprint;
rows with one doc_id are ordered by a hash of their text; a null doc_id comes
after all others; one row alone is its own next document; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions import text as tx

SPAN = 32
EQUAL = 4
SHIFTS = 20
WIDE = (1 << 62) - 1
# three one-bit fields, 20 bits apart
FIELDS = 1 | 1 << 20 | 1 << 40
NARROW = (1 << 60) - 1
# aimed-at rows of a bucket of neighbouring ids, and the most buckets: their heads are broadcast, 65,536 short rows at most
ROWS, BUCKETS, QUANTILES = 512, 65_536, 64


def pieces(text: Column, span: int = SPAN) -> Column:
    """Paragraphs of a text; together they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{span}}}\n?|\n"), F.lit(0))


def _sum(items: Column, of, mask: int) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: (a + of(x)).bitwiseAND(F.lit(mask)))


def fingerprint(text: Column, span: int = SPAN) -> Column:
    """``array<bigint>``: count, equality lanes, narrow lanes."""
    def vector(p: Column) -> Column:
        wide = [_sum(p, lambda x, i=i: F.xxhash64(x, F.lit(i)).bitwiseAND(F.lit(WIDE)), WIDE) for i in range(EQUAL)]
        signs = lambda hashes: F.array(
            *[_sum(hashes, lambda h, i=i: F.shiftright(h, i).bitwiseAND(F.lit(FIELDS)), NARROW) for i in range(SHIFTS)]
        )
        return F.concat(F.array(F.size(p).cast("long"), *wide), tx.let(F.transform(p, lambda x: F.xxhash64(x)), signs))

    return tx.let(pieces(text, span), vector)


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' paragraphs together."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: (x["a"] + x["b"]).bitwiseAND(_mask(i)))


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of the first text's paragraphs without the second's."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: (x["a"] - x["b"]).bitwiseAND(_mask(i)))


def _mask(i: Column) -> Column:
    return F.when(i <= EQUAL, F.lit(WIDE)).otherwise(F.lit(NARROW))


def _square(count: Column, words: Column) -> Column:
    """Mean square of the narrow lanes as sums of signs; fields are read as signed numbers of 20 bits."""
    def signed(v: Column) -> Column:
        return F.when(v >= 1 << 19, v - (1 << 20)).otherwise(v)

    def fields(w: Column) -> Column:
        low = signed(w.bitwiseAND(F.lit((1 << 20) - 1)))
        up = F.shiftright(w - low, 20)
        mid = signed(up.bitwiseAND(F.lit((1 << 20) - 1)))
        high = signed(F.shiftright(up - mid, 20).bitwiseAND(F.lit((1 << 20) - 1)))
        return sum((F.pow((v * 2 - count).cast("double"), F.lit(2.0)) for v in (low, mid, high)), F.lit(0.0))

    return F.aggregate(words, F.lit(0.0), lambda a, w: a + fields(w)) / (3 * SHIFTS)


def _energy(fp: Column) -> Column:
    return _square(F.element_at(fp, 1), F.slice(fp, EQUAL + 2, SHIFTS))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal multisets, about 0 for disjoint ones: 1 - |a - b|^2 / (|a|^2 + |b|^2) over paragraph counts."""
    def of(v: Column) -> Column:
        words = F.zip_with(F.slice(v["a"], EQUAL + 2, SHIFTS), F.slice(v["b"], EQUAL + 2, SHIFTS), lambda x, y: x - y)
        apart = _square(v["a"][0] - v["b"][0], words)
        both = _energy(v["a"]) + _energy(v["b"])
        near = F.when(both > 0, F.greatest(F.lit(0.0), F.lit(1.0) - apart / both)).otherwise(F.lit(0.0))
        return F.when(v["a"] == v["b"], F.lit(1.0)).otherwise(near)

    return tx.let(F.struct(a.alias("a"), b.alias("b")), of)


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), "")


def _buckets(ids: DataFrame, key: str) -> Column:
    """A bucket number that grows with the id: quantiles of the ids, each cut evenly."""
    found = ids.agg(
        F.count(key).alias("n"), F.percentile_approx(key, [i / QUANTILES for i in range(QUANTILES + 1)], 10_000).alias("q")
    ).first()
    if not found.n:
        return F.lit(-1).cast("long")
    q = sorted(set(found.q))
    m = max(1, math.ceil(min(found.n / ROWS, BUCKETS) / QUANTILES))
    bounds = F.array(*[F.lit(x).cast("long") for x in q])
    i = F.greatest(F.lit(1), F.size(F.filter(bounds, lambda b: b <= F.col(key))))
    low, high = F.element_at(bounds, i).cast("double"), F.coalesce(F.try_element_at(bounds, i + 1), F.lit(q[-1] + 1)).cast("double")
    part = F.least(F.lit(m - 1), F.greatest(F.lit(0), F.floor((F.col(key).cast("double") - low) / (high - low) * m)))
    return F.coalesce(i.cast("long") * m + part, F.lit(-1).cast("long"))


def with_next(docs: DataFrame, keep: list[str], key: str = "doc_id", tie: str = "_tie") -> DataFrame:
    """Add ``next``, a struct of ``keep`` of the next row by descending ``key``; after the last comes the first.

    Rows are bucketed by key, sorted within buckets, and each bucket also gets
    the first row of the bucket after it.
    """
    placed = docs.withColumn("_b", _buckets(docs.select(key), key))
    order = lambda: (F.col(key).desc_nulls_last(), F.col(tie).desc())
    # one row a bucket, largest key first
    heads = placed.groupBy("_b").agg(F.max(F.struct(F.col(key), F.col(tie))).alias("h"))
    one = Window.partitionBy(F.lit(0)).orderBy(F.col("_b"))
    ends = Window.partitionBy(F.lit(0))
    heads = heads.select("_b", "h", F.coalesce(F.lead("_b").over(one), F.min("_b").over(ends)).alias("_before"))
    heads = heads.select(F.col("_b").alias("_hb"), F.col(f"h.{key}").alias("_hk"), F.col(f"h.{tie}").alias("_ht"), "_before")
    match = (F.col("_b") == F.col("_hb")) & F.col(key).eqNullSafe(F.col("_hk")) & (F.col(tie) == F.col("_ht"))
    own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("extra"))
    extra = F.struct(F.col("_before").alias("b"), F.lit(True).alias("extra"))
    places = F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, extra))
    both = placed.join(F.broadcast(heads), match, "left").select(*docs.columns, F.explode(places).alias("_p"))
    w = Window.partitionBy("_p.b").orderBy(F.col("_p.extra"), *order())
    return both.withColumn("next", F.lead(F.struct(*keep)).over(w)).filter("not _p.extra").drop("_p")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = docs.select("doc_id", "text", fingerprint(F.col("text")).alias("fp"), F.xxhash64("text").alias("_tie"))
    follows = with_next(marked, ["text", "fp"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    both = follows.select("doc_id", n.cast("long").alias("n_chars"), "fp", F.col("next.fp").alias("next_fp"), edited.alias("edited"))
    both = both.withColumn("efp", fingerprint(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
