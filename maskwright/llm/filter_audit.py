"""Which document filters do the work: every order of the filters, replayed from one sparse document-term matrix.

The words of all documents are encoded by one global dictionary. A word's id is
its 63-bit hash; the dictionary, which holds every distinct word, shows which
ids belong to several words, and those words (next to none, at most ``SHARED``
ids) get negative ids of their own, sent to all tasks. So a text is encoded
where it is read, without moving it. Documents become rows of CSR shards
(``indptr``, ``indices``, ``counts``), one shard for about a megabyte of text;
the row sums are the words of a document, its nonzero entries the distinct ones.
With the other flags attached, documents are counted by part, failed filters
and labels, and only these counts meet the 120 orders.

Equal texts meet by digest: the least id of a digest is an aggregate, joined
back on digest and id, so that a text copied a million times lands in no single
task. Repeated rows are counted together before every join.

Defined cases: a null text is empty (no words, fails A only); a null id is no
smaller id, has none and has no label; rows that share id and text are not
smaller than each other; a document whose labels are repeated counts as labelled if
any row says so; a null language is the part of the empty string; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from maskwright.llm import words
from maskwright.sources.sinks import as_table

FILTERS = "ABCDE"
#: A: fewer words; B: percent of distinct words; C: percent of capitals; D: marks.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 3, b"#$%&*|"
BITS = 63
# longer words are hashed by another function, since sums of powers of a fixed base repeat on long regular strings
LONG = 256
SHARED = 100_000

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_MARKED = np.isin(np.arange(256), list(MARKS))


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    h = words.hash_of(words.prefix_hash(data), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def dictionary(docs: DataFrame, text: str = "text", bits: int = BITS) -> DataFrame:
    """All distinct words: ``id`` (the hash), ``word``, ``n`` (its cases)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in words.chunks(b.column(0)):
                starts, ends, _ = words.word_spans(data, offsets, words.SPACE)
                h = _hashed(data, starts, ends, bits)
                first, code = words.distinct(data, starts, ends, h)
                flat, at = words.gather(data, starts[first], (ends - starts)[first])
                word = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(at), pa.py_buffer(flat)]).cast(pa.string())
                n = np.bincount(code, minlength=len(first))
                yield pa.RecordBatch.from_arrays([pa.array(h[first]), word, pa.array(n, pa.int64())], ["id", "word", "n"])

    return docs.select(text).mapInArrow(run, "id bigint, word string, n bigint").groupBy("id", "word").agg(F.sum("n").alias("n"))


def shared_ids(table: DataFrame) -> dict[int, dict[bytes, int]]:
    """For each id of several words of a dictionary: its words, with ids of their own."""
    ids = [r[0] for r in table.groupBy("id").count().filter("count > 1").select("id").limit(SHARED + 1).collect()]
    if len(ids) > SHARED:
        raise ValueError(f"more than {SHARED} ids of several words; use more bits")
    if not ids:
        return {}
    out: dict[int, dict[bytes, int]] = {i: {} for i in ids}
    found = table.filter(F.col("id").isin(ids)).select("id", "word").collect()
    for k, r in enumerate(sorted(found, key=lambda r: r.word.encode())):
        out[r.id][r.word.encode()] = -1 - k
    return out


def csr_shards(docs: DataFrame, shared: dict[int, dict[bytes, int]], keep: list[str], text: str = "text", bits: int = BITS) -> DataFrame:
    """Shards of the document-term matrix.

    A shard holds, for its documents in order, arrays of the ``keep`` columns and of ``points`` (code points), ``upper``
    (capitals A-Z) and ``marked`` (holds one of MARKS), and the matrix as ``indptr``, ``indices`` (word ids, ascending by code
    within the shard) and ``counts``.
    """
    several = np.array(sorted(shared), np.int64)
    kinds = {f.name: f.dataType for f in docs.schema}
    schema = StructType([StructField(c, ArrayType(kinds[c])) for c in keep])
    for name, kind in (("points", LongType()), ("upper", LongType()), ("marked", BooleanType()), ("indptr", IntegerType()), ("indices", LongType()), ("counts", IntegerType())):
        schema = schema.add(name, ArrayType(kind))

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, data, offsets in words.chunks(b.column(len(keep))):
                starts, ends, begins = words.word_spans(data, offsets, words.SPACE)
                ids = _hashed(data, starts, ends, bits)
                for i in np.flatnonzero(np.isin(ids, several)).tolist() if len(several) else ():
                    ids[i] = shared[int(ids[i])][data[starts[i] : ends[i]].tobytes()]
                terms, code = np.unique(ids, return_inverse=True)
                key = np.repeat(np.arange(n), np.diff(begins)) * max(1, len(terms)) + code
                key.sort()
                cell = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                indptr = np.searchsorted(key[cell], np.arange(n + 1) * max(1, len(terms)))
                counts = np.diff(np.append(cell, len(key)))

                def per_row(flags: np.ndarray) -> np.ndarray:
                    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
                    return np.diff(total[offsets])

                columns = [b.column(k).slice(at, n) for k in range(len(keep))]
                columns += [pa.array(per_row((data & 0xC0) != 0x80)), pa.array(per_row(_UPPER[data])), pa.array(per_row(_MARKED[data]) > 0)]
                indices = terms[key[cell] % len(terms)] if len(key) else np.zeros(0, np.int64)
                columns += [pa.array(indptr, pa.int32()), pa.array(indices, pa.int64()), pa.array(counts, pa.int32())]
                yield pa.RecordBatch.from_arrays([one(c) for c in columns], schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def row_counts(shards: DataFrame, keep: list[str]) -> DataFrame:
    """One row per document: the ``keep`` columns, ``points``, ``upper``, ``marked``, ``n_words`` (row sum) and ``n_distinct`` (nonzero entries)."""
    copied = ", ".join(f"`{c}`[i] as `{c}`" for c in [*keep, "points", "upper", "marked"])
    entries = "indptr[i + 1] - indptr[i]"
    total = f"aggregate(slice(counts, indptr[i] + 1, {entries}), 0L, (a, x) -> a + x)"
    row = f"struct({copied}, {total} as n_words, cast({entries} as bigint) as n_distinct)"
    return shards.selectExpr(f"inline(transform(sequence(0, size(points) - 1), i -> {row}))")


def failed(rows: DataFrame) -> DataFrame:
    """Adds ``mask``: a bit for each filter of A to D that the document fails."""
    tests = [
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"),
        100 * F.col("upper") > MOST_CAPITALS * F.col("points"),
        F.col("marked"),
    ]
    return rows.withColumn("mask", sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0)))


def _with_copies(counted: DataFrame) -> DataFrame:
    """Adds filter E to ``mask``: the text of a smaller id. Input: part, doc_id, digest, mask, n."""
    least = counted.groupBy("digest").agg(F.min("doc_id").alias("least")).filter("least is not null")
    met = counted.join(
        least.withColumnRenamed("digest", "_digest"), (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("least")), "left"
    )
    copy = F.col("doc_id").isNotNull() & F.col("least").isNull()
    return met.withColumn("mask", F.col("mask") + F.when(copy, 16).otherwise(0)).drop("_digest", "least")


def outcomes(docs: DataFrame, labels: DataFrame, bits: int = BITS) -> DataFrame:
    """Documents counted by ``part``, ``mask`` (bits of the filters they fail, A first), ``good`` and ``toxic`` (0 or 1): ``n``."""
    slim = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.col("doc_id"),
        F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"),
        F.col("text"),
    )
    keep = ["part", "doc_id", "digest"]
    shared = shared_ids(as_table(dictionary(docs, bits=bits), "words"))
    rows = failed(row_counts(csr_shards(slim, shared, keep, bits=bits), keep))
    counted = as_table(rows.groupBy(*keep, "mask").agg(F.count(F.lit(1)).alias("n")), "filters")
    by_id = _with_copies(counted).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    of = labels.groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    labelled = by_id.join(of, "doc_id", "left").fillna(0, ["good", "toxic"])
    return labelled.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def replayed(counts: DataFrame) -> DataFrame:
    """All orders of the filters over the counts of outcomes(): one row per part, order and step."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            steps.append({"filter_order": "".join(FILTERS[i] for i in order), "step": k + 1, "bit": 1 << f, "before": before})
            before |= 1 << f
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, bit int, before int>>")
    met = counts.withColumn("fails", F.bit_count("mask").cast("long")).select("*", F.inline(listed))
    fails, early = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(case, times=F.col("n")):
        return F.sum(F.when(case, times).otherwise(0)).cast("long")

    gone = fails & ~early
    # a document that fails k filters is removed by each of them in one k-th of the orders
    share = F.col("n") * F.expr("120 div greatest(fails, 1)")
    return met.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~early).alias("kept"),
        total(gone).alias("removed"),
        total(fails & early).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(gone & (F.col("good") == 1)).alias("good_lost"),
        total(gone & (F.col("toxic") == 1)).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(outcomes(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


ORACLE_SQL = r"""
with d as (
  select coalesce(lang, '') as part, doc_id, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
f as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) as c,
    regexp_matches(t, '[#$%&*|]') as d,
    coalesce(doc_id > min(doc_id) over (partition by t), false) as e
  from d left join l using (doc_id)),
m as (
  select part, good, toxic, [a, b, c, d, e] as fails, count(*) as n from f group by all),
letters as (select unnest(range(1, 6)) as k),
orders as (
  select [p.k, q.k, r.k, s.k, t.k] as o from letters p, letters q, letters r, letters s, letters t
  where len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
steps as (
  select list_reduce(list_transform(o, lambda x: substr('ABCDE', x::int, 1)), lambda x, y: x || y) as filter_order,
    k::int as step, o[k] as f, o[1:k - 1] as before from orders, letters),
hit as (
  select part, filter_order, step, f, n, good, toxic, fails[f] as fails_it,
    len(list_filter(before, lambda x: fails[x])) > 0 as early,
    len(list_filter(fails, lambda x: x)) as failures from m, steps),
r as (
  select part, filter_order, step, f,
    sum(case when not fails_it and not early then n else 0 end)::bigint as kept,
    sum(case when fails_it and not early then n else 0 end)::bigint as removed,
    sum(case when fails_it and early then n else 0 end)::bigint as redundant,
    sum(case when fails_it and failures = 1 then n else 0 end)::bigint as unique_fails,
    sum(case when fails_it and not early and good = 1 then n else 0 end)::bigint as good_lost,
    sum(case when fails_it and not early and toxic = 1 then n else 0 end)::bigint as toxic_lost
  from hit group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, f)::bigint as shapley from r
"""
