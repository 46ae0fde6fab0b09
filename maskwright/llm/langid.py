"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the runs of GRAMS bytes of the lower-cased text that cross no word,
with the gaps before and after a word as marks. A text is the average of its
subwords' embeddings; embeddings and softmax are trained by stochastic gradient
descent in numpy. Scores are calibrated by a temperature, and a threshold on
them rejects uncertain texts; both are set on a part of the sample that the
descent does not see.

Training rows are a bounded sample (PER_LANGUAGE a language), and of each the
descent sees DRAWN subwords, drawn evenly over the whole text. Prediction reads
all subwords of whole texts, in one pass without a shuffle: since the model is
linear, embeddings and softmax fold into one row of scores per subword.

Defined cases: a null text and a text without a letter are ``und`` with score 0;
a text with letters always gets a learned language, and ``rejected`` tells
whether the threshold refuses it; without training rows all texts are ``und``;
repeated rows get equal results; other columns do not matter; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import samples, words

PER_LANGUAGE, DRAWN = 2_000, 384
GRAMS = (3, 4)
BUCKETS, WIDTH = 1 << 16, 16
EPOCHS, RATE, BATCH = 6, 0.5, 64
# errors that may remain among accepted texts
ERRORS = 0.01
UNKNOWN = "und"
SPACED = np.where(words.NO_LETTER, 0x20, words.LOWER).astype(np.uint8)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket, language: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: buckets of the subwords in a slice of texts, and where each text's subwords begin."""
    data = SPACED[data]
    prefix = words.prefix_hash(data)
    gaps = np.concatenate(([0], np.cumsum(data == 0x20)))
    text_end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(len(data))
    for n in GRAMS:
        start = at[: max(0, len(data) - n + 1)]
        # a gap only as first or last byte, and not a run of two texts
        good = (gaps[start + n - 1] - gaps[start + 1] == 0) & (start + n <= text_end[: len(start)])
        start = start[good]
        yield (words.hash_of(prefix, start, start + n) % np.uint64(BUCKETS)).astype(np.int32), np.searchsorted(start, offsets)


def draws(docs: DataFrame, label: str) -> DataFrame:
    """``(label, grams)``: at most DRAWN subwords of each text, evenly over it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, n, data, offsets in words.chunks(pc.utf8_lower(b.column("text"))):
                sizes = list(subwords(data, offsets))
                for i in range(n):
                    own = np.concatenate([g[at[i] : at[i + 1]] for g, at in sizes])
                    out.append(own if len(own) <= DRAWN else own[np.linspace(0, len(own) - 1, DRAWN).astype(int)])
            yield pa.RecordBatch.from_arrays([b.column(label), pa.array(out, pa.list_(pa.int32()))], [label, "grams"])

    return docs.select(label, "text").mapInArrow(run, f"{label} string, grams array<int>")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(grams: list[np.ndarray], y: np.ndarray, classes: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings times weights, and bias."""
    rng = np.random.default_rng(seed)
    e, w, bias = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)), rng.normal(0, 0.1, (WIDTH, classes)), np.zeros(classes)
    steps, step = EPOCHS * -(-len(grams) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(grams))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            length = np.array([max(1, len(grams[i])) for i in batch])
            f = np.concatenate([grams[i] for i in batch]).astype(np.int64)
            d = np.repeat(np.arange(len(batch)), [len(grams[i]) for i in batch])
            mean = np.zeros((len(batch), WIDTH))
            np.add.at(mean, d, e[f])
            mean /= length[:, None]
            error = softmax(mean @ w + bias)
            error[np.arange(len(batch)), y[batch]] -= 1
            rate = RATE * (1 - step / steps)
            step += 1
            # a subword's own gradient is that of its text, over the text's length; the rate makes up for the batch
            np.add.at(e, f, -rate * (error @ w.T / length[:, None] * 8)[d])
            w -= rate * mean.T @ error / len(batch) * 8
            bias -= rate * error.mean(0)
    return e @ w, bias


def calibrate(z: np.ndarray, y: np.ndarray, errors: float = ERRORS) -> tuple[float, float]:
    """The temperature of least log loss, and the least score at which accepted texts err no more than ``errors``."""
    if not len(z):
        return 1.0, 0.0
    grid = np.geomspace(0.05, 20, 61)
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = softmax(z / t)
    order = np.argsort(-p.max(1), kind="stable")
    wrong = np.cumsum((p.argmax(1) != y)[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(wrong <= errors)
    return t, float(p.max(1)[order][fine[-1]]) if len(fine) else 1.0


def fit(docs: DataFrame, label: str = "lang", key: str = "doc_id", most: int = PER_LANGUAGE) -> Model | None:
    """Learn from rows with a label, a key and a text."""
    known = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull() & F.col(key).isNotNull()).select(key, label, "text")
    chosen, sizes = samples.per_class(known, label, key, most)
    if not sizes:
        return None
    got = draws(chosen, label).toPandas()
    languages = sorted(sizes)
    y = got[label].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    apart = np.random.default_rng(2).random(len(got)) < 0.2
    seen = np.flatnonzero(~apart)
    table, bias = train([got.grams[i] for i in seen], y[seen], len(languages))
    z = np.array([table[g].mean(0) + bias if len(g) else bias for g in got.grams[apart]]).reshape(-1, len(languages))
    return Model(languages, table.astype(np.float32), bias, *calibrate(z, y[apart]))


def logits(m: Model, column: pa.Array) -> np.ndarray:
    """Scores of all languages for whole texts."""
    out = np.zeros((len(column), len(m.languages)))
    for first, n, data, offsets in words.chunks(pc.utf8_lower(column)):
        total, count = np.zeros((n, len(m.languages))), np.zeros(n)
        for g, at in subwords(data, offsets):
            for c in range(len(m.languages)):
                running = np.concatenate(([0.0], np.cumsum(m.table[:, c][g], dtype=np.float64)))
                total[:, c] += running[at[1:]] - running[at[:-1]]
            count += np.diff(at)
        out[first : first + n] = total / np.maximum(count, 1)[:, None] + m.bias
    return out / m.temperature


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """``(key, lang_pred, score, rejected)`` of every row."""
    if model is None:
        return docs.select(key, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            text = b.column("text")
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            p = softmax(logits(m, text))
            best = np.where(letters, np.array([*m.languages], object)[p.argmax(1)], UNKNOWN)
            score = np.where(letters, p.max(1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column(key), pa.array(best, pa.string()), pa.array(score), pa.array(~letters | (score < m.threshold))],
                [key, "lang_pred", "score", "rejected"],
            )

    return docs.select(key, "text").mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, lang_pred string, score double, rejected boolean")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(samples.fold("doc_id", 4) != 2))
    held_out = F.coalesce(samples.fold("doc_id", 4) == 2, F.lit(False))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
