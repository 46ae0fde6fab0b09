"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct words and word beginnings, hashed. Terms that
tell the classes apart in the training rows enter the machine: a weight each,
and a vector each whose products are the weights of pairs, so that a term can
count otherwise next to another one than alone.

Labels are learned from a bounded sample of labelled rows (PER_CLASS a class), and
of the terms that pass SCORE and SEEN the machine takes the MOST best ones: its size, not
the texts that are read, is bounded by that.
Term counts of that sample are aggregated in Spark; the driver gets the chosen
terms and, of each sampled text, the chosen terms it has. Scoring reads whole
texts in one pass without a shuffle.

Defined cases: a null or empty text has no terms and gets the bias's score;
without labelled rows of both classes every score is 0; labels of one doc_id
that differ count as toxic; repeated documents get equal scores; other columns
do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm import samples, words
from maskwright.sources.sinks import as_table

PER_CLASS = 8_000
TERMS = 1 << 20
# bytes of a word's beginning that make a term of their own
BEGINNING = 5
# a term enters with this standard score of its frequencies in the classes, in this many sampled texts at least, MOST by score
SCORE, SEEN, MOST = 4.0, 4, 8_192
FACTORS, EPOCHS, RATE, SHRINK = 8, 12, 0.2, 1e-4


@dataclass
class Machine:
    """``slot`` maps a hashed term to its row in ``w`` and ``v``; row 0 is for all other terms and is zero."""

    slot: np.ndarray
    w: np.ndarray
    v: np.ndarray
    bias: float


def terms_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Distinct hashed terms of each text."""
    for _, n, data, offsets in words.chunks(pc.utf8_lower(column)):
        starts, ends, first = words.word_spans(data, offsets, words.NO_LETTER)
        prefix = words.prefix_hash(data)
        whole = words.hash_of(prefix, starts, ends) % np.uint64(TERMS)
        begun = words.mix(words.hash_of(prefix, starts, np.minimum(ends, starts + BEGINNING))) % np.uint64(TERMS)
        for i in range(n):
            own = slice(first[i], first[i + 1])
            yield np.unique(np.concatenate((whole[own], begun[own])).astype(np.int64))


def term_rows(docs: DataFrame, keep: str) -> DataFrame:
    """``(keep, terms)`` of rows ``(keep, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [t.astype(np.int32) for t in terms_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array(found, pa.list_(pa.int32()))], [keep, "terms"])

    kind = dict(docs.dtypes)[keep]
    return docs.select(keep, "text").mapInArrow(run, f"{keep} {kind}, terms array<int>")


def choose_terms(rows: DataFrame, n0: int, n1: int) -> list[int]:
    """Terms of ``(y, terms)`` rows whose frequencies in the two classes differ by SCORE standard errors."""
    seen = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("y").cast("double").alias("c1"), F.count("*").cast("double").alias("c")
    )
    p = F.col("c") / (n0 + n1)
    score = F.abs(F.col("c1") / n1 - (F.col("c") - F.col("c1")) / n0) / F.sqrt(p * (1 - p) * F.lit(1 / n0 + 1 / n1) + 1e-12)
    best = seen.filter(F.col("c") >= SEEN).select("term", score.alias("score")).filter(F.col("score") >= SCORE)
    return [r.term for r in best.orderBy(F.desc("score"), "term").limit(MOST).collect()]


def train(texts: list[np.ndarray], y: np.ndarray, size: int, prior: float, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, vectors and bias by stochastic gradient descent (Adagrad) on the logistic loss.

    ``texts`` hold rows 1 .. size; ``prior`` is the log odds of class 1 outside the sample.
    """
    rng = np.random.default_rng(seed)
    w, v = np.zeros(size + 1), rng.normal(0, 0.01, (size + 1, FACTORS))
    v[0] = 0
    seen_w, seen_v, seen_b = np.full(size + 1, 1e-6), np.full((size + 1, FACTORS), 1e-6), 1e-6
    here = float(np.log(max(1, y.sum()) / max(1, (1 - y).sum())))
    bias = here
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            length = np.array([len(texts[i]) for i in batch])
            f = np.concatenate([texts[i] for i in batch])
            d = np.repeat(np.arange(len(batch)), length)
            total, square = np.zeros((len(batch), FACTORS)), np.zeros((len(batch), FACTORS))
            np.add.at(total, d, v[f])
            np.add.at(square, d, v[f] ** 2)
            z = bias + np.bincount(d, w[f], len(batch)) + 0.5 * (total**2 - square).sum(1)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]
            used, back = np.unique(f, return_inverse=True)
            g = np.bincount(back, error[d], len(used)) + SHRINK * w[used]
            seen_w[used] += g**2
            w[used] -= RATE * g / np.sqrt(seen_w[used])
            gv = np.zeros((len(used), FACTORS))
            np.add.at(gv, back, error[d][:, None] * (total[d] - v[f]))
            gv += SHRINK * v[used]
            seen_v[used] += gv**2
            v[used] -= RATE / 4 * gv / np.sqrt(seen_v[used])
            seen_b += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(seen_b)
    return w, v, bias + prior - here


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine | None:
    """Learn from ``labels`` (doc_id, toxic) and the texts of ``docs``; null if a class is missing."""
    one = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    chosen, sizes = samples.per_class(one, "y", "doc_id", per_class)
    if not sizes.get(0) or not sizes.get(1):
        return None
    # about 2 * per_class ids
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text")
    rows = as_table(term_rows(texts, "y"), "toxic-terms")
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    chosen_terms = choose_terms(rows, counts[0], counts[1])
    slot = np.zeros(TERMS, np.int32)
    slot[chosen_terms] = np.arange(1, len(chosen_terms) + 1)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(r := slot[t.values.to_numpy()])[r > 0] for t in b.column("terms")]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(own, pa.list_(pa.int32()))], ["y", "slots"])

    # of each sampled text only the chosen terms reach the driver
    kept = rows.mapInArrow(known, "y int, slots array<int>").toPandas()
    w, v, bias = train([np.asarray(t, np.int64) for t in kept.slots], kept.y.to_numpy(float), len(chosen_terms), float(np.log(sizes[1] / sizes[0])))
    return Machine(slot, w, v, bias)


def scores_of(m: Machine, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    for i, t in enumerate(terms_of(column)):
        rows = m.slot[t]
        rows = rows[rows > 0]
        total = m.v[rows].sum(0)
        out[i] = m.bias + m.w[rows].sum() + 0.5 * (total**2 - (m.v[rows] ** 2).sum(0)).sum()
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """The rows and ``toxic_score``, which replaces a column of that name."""
    docs = docs.drop("toxic_score")
    if machine is None:
        return docs.withColumn("toxic_score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores_of(shared.value, b.column("text")))], [*b.schema.names, "toxic_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())]))


def clean(docs: DataFrame, machine: Machine | None, least: float = 0.5) -> DataFrame:
    """The rows that score below ``least``, as they are."""
    if machine is None:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores_of(shared.value, b.column(at)) < least))

    return docs.mapInArrow(run, docs.schema)


def learn(spark: SparkSession, sf_dir: str) -> Machine | None:
    """The machine of the labelled documents outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(samples.fold("doc_id", 5) != 0)
    return fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, learn(spark, sf_dir))
    return scored.select(
        "doc_id", F.coalesce(samples.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )
