"""Secret scans: wide candidates, and a random forest that removes false positives.

Candidates are assigned values after a credential word, long runs with digits,
and key blocks; a value hides no other one beside it. The forest sees a candidate's length and classes of characters,
how usual its character transitions are, how much of it dictionary words cover,
its path, and neighbouring words. It is trained from labelled findings; where
none are given, from those of a bounded sample of documents (SAMPLE), labelled by
rule where a rule is sure, and varied: random and made-up values put into
found contexts. Dictionary and transitions are counted over all documents, with a
cut by frequency within each source.

Finding, scoring and masking run in one pass over whole texts, without a shuffle.

Defined cases: a null text has no findings and stays null; offsets are code
points; overlapping candidates give way to the earliest, then longest; repeated
rows give repeated findings; a sample without candidates trains on made-up
values alone; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm import words
from maskwright.sources.sinks import as_table

SAMPLE, VARIANTS = 6_000, 1_500
# longest dictionary word, and its least part of its group's words
WORD, PART = 24, 1e-6
TREES, DEPTH, LEAF, TRIED = 25, 8, 3, 5
LONG = 16
MASK = "[SECRET]"
CREDENTIAL = r"secret|token|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth[_-]?key|client[_-]?id"
KEYED = re.compile(rf"(?i)(?:{CREDENTIAL})[\w-]*[\"']?\s*(?::=|=>|=|:)\s*[\"'`]?([^\s\"'`<>#,;&|]{{6,}})")
BARE = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_=.@:~-]*[A-Za-z0-9=]")
KEY = r"(?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY(?: BLOCK)?-----"
# up to the END line; without one, header lines and long runs
BLOCK = re.compile(
    rf"-----BEGIN {KEY}(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END {KEY}"
    r"|(?:\s+[A-Z][\w-]*: [^\n]*+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]+={1,2})?)"
)
NEAR_CREDENTIAL = re.compile(rf"(?i)(?:{CREDENTIAL})")
NEAR_DIGEST = re.compile(r"(?i)\b(?:commit|sha\d*|md5|checksum|digest|hash|etag|uuid|guid|revision|build)\b")
MADE_UP = re.compile(r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|1234567|abcdef|redacted|fake|test")
TEST_PATH = re.compile(r"(?i)test|example|fixture|mock|sample|docs?/")
CONFIG_PATH = re.compile(r"(?i)\.env|config|secret|credential|\.pem|\.key")
SHAPES = re.compile(r"(?i)^(?:[\d.,:/-]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|https?:.*|www\..*|\d{4}-\d\d-\d\d.*)$")
HEX = re.compile(r"^[0-9a-fA-F]+$")
KNOWN = re.compile(r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|xox[abprs]-[\w-]{10,}|eyJ[\w-]+\.[\w-]+\..*|sk-\w{16,}|-----BEGIN)")
FEATURES = (
    "length", "digits", "upper", "lower", "other", "entropy", "transitions", "covered", "hex", "known",
    "shape", "made_up", "credential_near", "digest_near", "made_up_near", "test_path", "config_path",
)
HAS_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
ASSIGNS = np.array([b in b"=:" for b in range(256)])
DASHES = np.array([b == 45 for b in range(256)])


@dataclass
class Finding:
    start: int
    value: str
    before: str
    after: str


def find(column: pa.Array) -> Iterator[list[Finding]]:
    """The candidates of each text, in order."""
    for _, n, data, offsets in words.chunks(column):
        starts, ends, first = words.word_spans(data, offsets, words.SPACE)
        count = lambda table: (c := np.concatenate(([0], np.cumsum(table[data]))))[ends] - c[starts]
        long = (ends - starts >= LONG) & (count(HAS_DIGIT) > 0)
        likely = np.flatnonzero(long | (count(ASSIGNS) > 0) | (count(DASHES) >= 5))
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        at = np.searchsorted(likely, first)
        for i in range(n):
            own = likely[at[i] : at[i + 1]]
            yield _of_text(data, starts, ends, points, own, first[i], first[i + 1], offsets[i]) if len(own) else []


def _keyed(region: str) -> Iterator[tuple[int, int]]:
    """Assigned values; a value may be another one's credential word."""
    m = KEYED.search(region)
    while m:
        yield m.span(1)
        m = KEYED.search(region, m.start(1))


def _long_runs(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    for m in BARE.finditer(text, low, high):
        if len(m[0]) >= LONG and any(c.isdigit() for c in m[0]):
            yield m.span()


def _of_text(data, starts, ends, points, own, low, high, begin) -> list[Finding]:
    text = data[begin : ends[high - 1]].tobytes().decode()
    place = lambda at: int(points[at] - points[begin])
    spans = {m.span() for m in BLOCK.finditer(text)} if "-----BEGIN" in text else set()
    for w in own:
        # the word with what stands before it and the two words after it
        a, b = place(starts[max(low, w - 1)]), place(ends[min(high - 1, w + 2)])
        spans |= {(a + s, a + e) for s, e in _keyed(text[a:b])}
    # long runs in what those leave of each word
    taken, last, bare = [], 0, set()
    for s, e in sorted(spans):
        if e > last:
            taken.append((max(s, last), e))
            last = e
    until = [e for _, e in taken]
    for w in own:
        if ends[w] - starts[w] < LONG:
            continue
        at, end = place(starts[w]), place(ends[w])
        for s, e in taken[bisect.bisect_right(until, at) :]:
            if s >= end:
                break
            bare.update(_long_runs(text, at, s))
            at = max(at, e)
        bare.update(_long_runs(text, at, end))
    spans |= bare
    if not spans:
        return []
    out, reached = [], -1
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= reached:
            out.append(Finding(s, text[s:e], " ".join(text[max(0, s - 64) : s].split()[-3:]), " ".join(text[e : e + 48].split()[:2])))
            reached = e
    return out


@dataclass
class Usage:
    """What plain text looks like: log odds of character pairs, and frequent words."""

    pairs: np.ndarray
    words: frozenset[str]


def _pair_codes(text: str) -> np.ndarray:
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.int64)
    code = np.where((b >= 97) & (b <= 122), b - 96, np.where((b >= 48) & (b <= 57), b - 21, np.where(b > 127, 37, 0)))
    return code[:-1] * 38 + code[1:]


def covered(value: str, usage: Usage) -> float:
    """Part of a value's letters that lies in dictionary words of four letters or more, longest words first."""
    letters = total = 0
    for run in re.findall(r"[^\W\d_]+", value.lower()):
        total += len(run)
        i = 0
        while i < len(run):
            size = next((k for k in range(min(WORD, len(run) - i), 3, -1) if run[i : i + k] in usage.words), 0)
            letters += size
            i += size or 1
    return letters / max(1, len(value)) if total else 0.0


def features(found: list[tuple[Finding, str]], usage: Usage) -> np.ndarray:
    """One row of FEATURES for each finding and its path."""
    out = np.zeros((len(found), len(FEATURES)))
    for row, (f, path) in zip(out, found, strict=True):
        v = f.value
        n = max(1, len(v))
        p = np.array(list(Counter(v).values())) / n
        pairs = _pair_codes(v)
        row[:] = (
            min(n, 200), sum(c.isdigit() for c in v) / n, sum(c.isupper() for c in v) / n, sum(c.islower() for c in v) / n,
            sum(not c.isalnum() for c in v) / n, -(p * np.log2(p)).sum(), usage.pairs[pairs].mean() if len(pairs) else 0.0,
            covered(v, usage), bool(HEX.match(v)), bool(KNOWN.match(v)), bool(SHAPES.match(v)), bool(MADE_UP.search(v)),
            bool(NEAR_CREDENTIAL.search(f.before)), bool(NEAR_DIGEST.search(f.before)),
            bool(MADE_UP.search(f.before + " " + f.after)), bool(TEST_PATH.search(path)), bool(CONFIG_PATH.search(path)),
        )
    return out


class Forest:
    """Trees of Gini splits on bootstrap rows; each split looks at TRIED features and 16 quantiles of each."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(TREES):
            own = rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[own], y[own], rng))

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Rows of (feature, threshold, left, right, value); feature -1 is a leaf."""
        nodes: list[list[float]] = [[-1, 0, 0, 0, y.mean()]]
        todo = [(0, np.arange(len(y)), 0)]
        while todo:
            at, rows, depth = todo.pop()
            if depth >= DEPTH or len(rows) < 2 * LEAF or y[rows].min() == y[rows].max():
                continue
            best = (0.0, -1, 0.0)
            whole = y[rows].mean() * (1 - y[rows].mean())
            for f in rng.permutation(x.shape[1])[:TRIED]:
                v = x[rows, f]
                for t in np.unique(np.quantile(v, np.linspace(0.03, 0.97, 16))):
                    left = v <= t
                    n = left.sum()
                    if LEAF <= n <= len(rows) - LEAF:
                        a, b = y[rows[left]].mean(), y[rows[~left]].mean()
                        gain = whole - (n * a * (1 - a) + (len(rows) - n) * b * (1 - b)) / len(rows)
                        best = max(best, (gain, int(f), float(t)))
            if best[1] < 0:
                continue
            left = x[rows, best[1]] <= best[2]
            nodes[at][:4] = [best[1], best[2], len(nodes), len(nodes) + 1]
            for part in (rows[left], rows[~left]):
                todo.append((len(nodes), part, depth + 1))
                nodes.append([-1, 0, 0, 0, y[part].mean()])
        return np.array(nodes)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = tree[at]
                f = node[:, 0].astype(int)
                down = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= node[:, 1], node[:, 2], node[:, 3]).astype(int)
                at = np.where(f < 0, at, down)
            out += tree[at, 4]
        return out / len(self.trees)


@dataclass
class Scanner:
    usage: Usage
    forest: Forest


def sampled(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """About ``most`` documents, chosen by a hash of text and row number: of many copies only their share."""
    part = min(1.0, most / max(1, docs.count()))
    place = F.xxhash64("text", F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 62) - 1)) / F.lit(float(1 << 62))
    return docs.filter(F.col("text").isNotNull() & (place < F.lit(part)))


def usage_of(docs: DataFrame, group: str | None = None) -> Usage:
    """Words and character pairs of all documents, counted in Spark once.

    A word counts if it is seen three times and has the part PART of the words of
    some ``group`` (a language, a source); in the pairs, all groups weigh the same.
    """
    by = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{1,64}"), F.lit(0))).alias("word")
    counts = as_table(docs.select(by.alias("g"), word).groupBy("g", "word").agg(F.count("*").alias("n")), "usage")
    totals = counts.groupBy("g").agg(F.sum("n").alias("total"))
    often = counts.filter((F.col("n") > 2) & F.length("word").between(4, WORD)).join(totals, "g").filter(F.col("n") >= F.col("total") * PART)
    top = [r.word for r in often.select("word").distinct().collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(38 * 38)
        for b in batches:
            total = b.column("total").to_numpy()
            for t in np.unique(total):
                own = b.filter(pa.array(total == t))
                codes = [_pair_codes(f" {w} ") for w in own.column("word").to_pylist()]
                n = np.repeat(own.column("n").to_numpy() / t, [len(c) for c in codes])
                seen += np.bincount(np.concatenate(codes), n, 38 * 38)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["code", "part"])

    pairs = counts.join(totals, "g").select("word", "n", "total").mapInArrow(run, "code long, part double")
    seen = np.zeros(38 * 38)
    for r in pairs.groupBy("code").agg(F.sum("part").alias("part")).collect():
        seen[r.code] = r.part
    size = (totals.agg(F.sum("total")).first()[0] or 0) / max(1, totals.count())
    seen = seen * size + 1
    return Usage(np.log(seen / seen.sum() * len(seen)), frozenset(top))


def found_in(sample: DataFrame, path: str | None = None) -> list[tuple[Finding, str]]:
    """The findings of a bounded sample, to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (f.start, f.value[:400], f.before, f.after, p or "")
                for own, p in zip(find(b.column("text")), b.column("path").to_pylist(), strict=True) for f in own
            ]
            yield pa.RecordBatch.from_pylist([dict(zip(("start", "value", "before", "after", "path"), r, strict=True)) for r in rows], schema)

    schema = pa.schema([("start", pa.int64()), *[(n, pa.string()) for n in ("value", "before", "after", "path")]])
    rows = sample.select("text", (F.col(path) if path else F.lit("")).alias("path"))
    got = rows.mapInArrow(run, "start long, value string, before string, after string, path string").collect()
    return [(Finding(r.start, r.value, r.before, r.after), r.path) for r in got]


def sure_label(f: Finding, usage: Usage) -> int | None:
    """The label of a finding where a rule is sure of it."""
    v, keyed = f.value, bool(NEAR_CREDENTIAL.search(f.before))
    if MADE_UP.search(v) or SHAPES.match(v) or covered(v, usage) > 0.6:
        return 0
    if KNOWN.match(v):
        return 1
    if keyed and len(v) >= LONG and any(c.isdigit() for c in v) and len(set(v)) >= 8:
        return 1
    return 0 if NEAR_DIGEST.search(f.before) and HEX.match(v) else None


def labelled_findings(found: list[tuple[Finding, str]], usage: Usage, seed: int = 7) -> tuple[list[tuple[Finding, str]], np.ndarray]:
    """Sure findings, and VARIANTS of either class: values drawn at random or made up of words, in contexts that were found."""
    rng = np.random.default_rng(seed)
    pick = lambda items: items[int(rng.integers(len(items)))]
    rows, labels = [], []
    for f, path in found:
        label = sure_label(f, usage)
        if label is not None:
            rows.append((f, path))
            labels.append(label)
    contexts = [(f.before, f.after, p) for f, p in found if NEAR_CREDENTIAL.search(f.before)] or [('token = "', '"', "")]
    plain = [(f.before, f.after, p) for f, p in found if not NEAR_CREDENTIAL.search(f.before)] or [("see", "", "")]
    lexicon = sorted(usage.words) or ["some", "words"]
    named = ("api_key =", "password:", "secret =", "access_key =", "token =", "auth_key:", "passwd=")
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    for _ in range(VARIANTS):
        random = "".join(pick(alphabet) for alphabet in [pick(alphabets)] for _ in range(int(rng.integers(14, 65))))
        before, after, path = pick(contexts)
        if rng.random() < 0.5:
            before = " ".join([*before.split()[:1], pick(named)])
        rows.append((Finding(0, random, before, after), path))
        labels.append(1)
        kind = int(rng.integers(5))
        if kind == 0:
            value = pick("-_. ").join(pick(lexicon) for _ in range(int(rng.integers(2, 5)))).replace(" ", "")
        elif kind == 1:
            value = pick(("your_token_here", "changeme1234", "xxxxxxxxxxxxxxxx", "example-key-000", "dummy_secret_123", "placeholder12345"))
        elif kind == 2:
            value, before = "".join(pick("0123456789abcdef") for _ in range(pick((32, 40, 64)))), pick(("commit", "sha256:", "md5 checksum", "digest:", "uuid"))
        elif kind == 3:
            value, (before, after, path) = "".join(pick("0123456789") for _ in range(int(rng.integers(12, 20)))), pick(plain)
        else:
            value, (before, after, path) = f"{pick(lexicon)}.{int(rng.integers(100))}@{pick(lexicon)}.example.com", pick(plain)
        rows.append((Finding(0, value, before, after), path))
        labels.append(0)
    return rows, np.array(labels, float)


def fit(docs: DataFrame, path: str | None = None, labelled: list[tuple[Finding, str, int]] | None = None, group: str | None = None) -> Scanner:
    """Train on ``labelled`` findings (finding, path, 0 or 1), or on those of a sample of ``docs``; ``group``: see usage_of()."""
    usage = usage_of(docs, group)
    if labelled:
        rows, y = [(f, p) for f, p, _ in labelled], np.array([float(x) for *_, x in labelled])
    else:
        rows, y = labelled_findings(found_in(sampled(docs), path), usage)
    return Scanner(usage, Forest(features(rows, usage), y))


FOUND = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("sha256", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("secret", T.BooleanType()),
]))
ARROW_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("sha256", pa.string()), ("score", pa.float64()), ("secret", pa.bool_())]))


def scan(docs: DataFrame, scanner: Scanner, path: str | None = None, least: float = 0.5) -> DataFrame:
    """The rows, ``_found`` (all candidates, with scores; values as digests) and ``_masked``, the text without its secrets.

    The two replace columns of those names.
    """
    docs = docs.drop("_found", "_masked")
    shared = docs.sparkSession.sparkContext.broadcast(scanner)
    names = [*docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            column = b.column(names.index("text"))
            paths = b.column(names.index(path)).to_pylist() if path else [""] * len(column)
            found = list(find(column))
            flat = [(f, p or "") for own, p in zip(found, paths, strict=True) for f in own]
            scores = iter(s.forest.score(features(flat, s.usage)).tolist() if flat else [])
            rows, texts = [], []
            for i, own in enumerate(found):
                scored = [(f, next(scores)) for f in own]
                rows.append([
                    {"start": f.start, "length": len(f.value), "sha256": hashlib.sha256(f.value.encode()).hexdigest(), "score": x, "secret": x >= least}
                    for f, x in scored
                ])
                texts.append(masked(column[i].as_py(), [f for f, x in scored if x >= least]) if any(x >= least for _, x in scored) else None)
            # texts without secrets are taken as they are
            out = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, ARROW_FOUND), pc.coalesce(out, column)], [*names, "_found", "_masked"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_found", FOUND), T.StructField("_masked", T.StringType())])
    return docs.mapInArrow(run, schema)


def masked(text: str, found: list[Finding]) -> str:
    out, at = [], 0
    for f in found:
        out += [text[at : f.start], MASK]
        at = f.start + len(f.value)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, scanner: Scanner, path: str | None = None, least: float = 0.5) -> DataFrame:
    """The rows with secrets masked in ``text``; a column ``n_chars`` follows the text."""
    shared, at, by = docs.sparkSession.sparkContext.broadcast(scanner), docs.columns.index("text"), docs.columns.index(path) if path else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            column = b.column(at)
            paths = b.column(by).to_pylist() if path else [""] * len(column)
            found = list(find(column))
            flat = [(i, f, p or "") for i, (own, p) in enumerate(zip(found, paths, strict=True)) for f in own]
            bad: dict[int, list[Finding]] = {}
            for (i, f, _), x in zip(flat, s.forest.score(features([x[1:] for x in flat], s.usage)) if flat else (), strict=True):
                if x >= least:
                    bad.setdefault(i, []).append(f)
            texts = pa.array([masked(column[i].as_py(), bad[i]) if i in bad else None for i in range(len(column))], column.type)
            yield b.set_column(at, b.schema.field(at), pc.coalesce(texts, column))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents with their scores and verdicts; a document's source stands for its path."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    found = scan(docs, fit(docs, "source", group="source"), "source").select("doc_id", F.explode("_found").alias("f"))
    return found.select("doc_id", "f.*")
