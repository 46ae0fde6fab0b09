"""MinHash near-dedup by chosen-path set similarity join.

A text's set is its distinct shingles of ``width`` words. Equal sets are one
class. Classes are branched into the nodes of independent random trees: a node
picks a coordinate of the min-hash signature, and classes with the same minwise
token there go on together. Small nodes are compared exhaustively, large ones
against one of their members and then branched further; so many trees that a
pair at the threshold meets in one of them with probability RECALL.

Comparing goes in two passes. The first takes, by signatures, a spanning forest
of each small node's likely pairs, and stars in large nodes: at most one pair per
member and node. Pairs are confirmed on full sets of whole texts, and
confirmed ones joined into components. The second pass takes the nodes that
still hold several components, branches large ones until few members are outside
their largest component, and compares members across components on full sets
until none is left to join; members of one component need no comparison. A large
node is compared in blocks, its few other members against all. Nothing is capped.

No group of rows is gathered beyond LIMIT members, or BLOCK on either side of a
block; texts move only for classes that have a likely partner, and few others that a
filter of bounded size lets pass; links stay distributed.

Defined cases: null, empty and blank texts have no shingles, are linked with
nothing and kept; texts with fewer words than ``width`` have one shingle, the
whole sequence; rows without doc_id take no part (component null, kept);
repeated rows are equal texts; documents of one doc_id with different texts are
separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import words
from maskwright.llm.components import components
from maskwright.sources.sinks import as_table

SIGNATURE, LIMIT, DEPTH, RECALL = 96, 192, 6, 0.9999
BRANCHES, TRIED = 3, 24
#: Rows on either side of a block of a large node, and shingles compared at a time.
BLOCK, COLUMNS = 1024, 2048
#: Bits of the filter that keeps unwanted texts from being shuffled: 16 MB at most, and useless rather than wrong when it is full.
FILTER_BITS = 1 << 27
ROOT = 2
#: Standard errors below the threshold down to which a signature makes a pair likely.
SLACK = 4.5
_FACTORS = words.mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(words.BASE)) | np.uint64(1)
_MASKS = words.mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_ODDS = words.mix(_MASKS) | np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """Texts are linked whose sets of shingles of ``width`` words have 100 * both >= ``percent`` * either."""

    width: int = 5
    percent: int = 80

    def trees(self) -> int:
        return math.ceil(math.log(1 - RECALL) / math.log(1 - (self.percent / 100) ** ROOT))

    def likely(self) -> float:
        s = self.percent / 100
        return s - SLACK * math.sqrt(s * (1 - s) / SIGNATURE)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def sets_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for _, n, data, offsets in words.chunks(column):
        h, first = words.word_hashes(words.LOWER[data], offsets)
        rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            # the place of a word in a shingle matters
            rolled += words.mix(h[k : k + len(rolled)] + np.uint64(k + 1)) * _FACTORS[k % 4]
        rolled = words.mix(rolled)
        for i in range(n):
            count = first[i + 1] - first[i]
            if count >= width:
                yield np.unique(rolled[first[i] : first[i + 1] - width + 1])
            elif count:
                few = words.mix(h[first[i] : first[i + 1]] + np.arange(1, count + 1, dtype=np.uint64)) * _FACTORS[:1]
                yield words.mix(few.sum(keepdims=True, dtype=np.uint64) ^ np.uint64(count))
            else:
                yield np.zeros(0, np.uint64)


def keys_of(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hash signatures of sets that are not empty."""
    out = np.zeros((len(sets), SIGNATURE), np.uint32)
    if sets:
        every, at = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        for k in range(SIGNATURE):
            out[:, k] = np.minimum.reduceat((every ^ _MASKS[k]) * _ODDS[k], at) >> np.uint64(32)
    return out


def _child(node: np.ndarray, pick: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Node keys below ``node`` at the picked coordinates."""
    token = sig[np.arange(len(sig)), pick].astype(np.uint64)
    return words.mix(words.mix(node ^ pick.astype(np.uint64)) + token)


def _pick(node: np.ndarray, branch: int) -> np.ndarray:
    return (words.mix(node + np.uint64(branch * 2 + 1)) % np.uint64(SIGNATURE)).astype(np.int64)


def paths(sig: np.ndarray, trees: int) -> np.ndarray:
    """The node of each signature at depth ROOT of each tree."""
    out = np.zeros((len(sig), trees), np.uint64)
    for t in range(trees):
        node = np.full(len(sig), words.mix(np.array([t + 1], np.uint64))[0])
        for _ in range(ROOT):
            node = _child(node, _pick(node, 0), sig)
        out[:, t] = node
    return out.view(np.int64)


FEATURES = "rid long, doc_id long, text_hash long, n_shingles long, a long, b long, sig binary, nodes array<long>"


def features(docs: DataFrame, rule: Rule) -> DataFrame:
    trees = rule.trees()
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sets = list(sets_of(b.column("text"), rule.width))
                filled = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in filled])
                nodes = paths(sig, trees)
                bytes_, lists = [None] * len(sets), [[] for _ in sets]
                for j, i in enumerate(filled):
                    bytes_[i], lists[i] = sig[j].tobytes(), nodes[j]
                keys = [keys_of(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("rid"), b.column("doc_id"), b.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()), pa.array(bytes_, pa.binary()), pa.array(lists, pa.list_(pa.int64())),
                    ],
                    names,
                )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, FEATURES)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and where their groups begin, from batches sorted by ``keys``."""
    rest: pa.Table | None = None
    for b in batches:
        table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        starts = _starts(table, keys)
        rest = table.slice(starts[-1]) if len(starts) else None
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    if not table.num_rows:
        return np.zeros(0, np.int64)
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _matrix(table: pa.Table, column: str = "sig") -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), np.uint32).reshape(-1, SIGNATURE)


def alike(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Part of the signature in which rows ``i`` of ``a`` and ``j`` of ``b`` agree."""
    out = np.zeros(len(i))
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = (a[i[part]] == b[j[part]]).mean(1)
    return out


class Union:
    """Union-find over a few items."""

    def __init__(self, labels):
        self.up = {}
        for x in labels:
            self.up.setdefault(x, x)

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def forest(members: DataFrame, least: float) -> DataFrame:
    """``(x, y)``: of each small node a spanning forest of its likely pairs of different labels, the likeliest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in by_group(batches, ["node"]):
            sig, u, label = _matrix(table), table.column("u").to_numpy(), table.column("label").to_numpy()
            sizes = np.diff(starts)
            pairs: list[tuple[int, int]] = []
            for size in np.unique(sizes):
                i, j = np.triu_indices(size, 1)
                of = starts[:-1][sizes == size]
                i, j = (of[:, None] + i).ravel(), (of[:, None] + j).ravel()
                near = alike(sig, sig, i, j)
                go = (near >= least) & (label[i] != label[j])
                i, j, near, group = i[go], j[go], near[go], np.repeat(np.arange(len(of)), size * (size - 1) // 2)[go]
                lower, upper = np.minimum(u[i], u[j]), np.maximum(u[i], u[j])
                at, known = -1, None
                for p in np.lexsort((upper, lower, -near, group)):
                    if group[p] != at:
                        at, known = group[p], Union([])
                    a, b = label[i[p]], label[j[p]]
                    known.up.setdefault(a, a)
                    known.up.setdefault(b, b)
                    if known.join(a, b):
                        pairs.append((lower[p], upper[p]))
            yield _pairs(pairs)

    return _sorted(members.select("node", "u", "label", "sig"), "node").mapInArrow(run, "x long, y long")


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    v = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(v[:, 0]), pa.array(v[:, 1])], ["x", "y"])


def stars(members: DataFrame, least: float) -> DataFrame:
    """``(x, y)``: likely pairs of each large node's members with one of them."""
    first = F.min(F.struct(F.xxhash64("u", "node").alias("h"), F.col("u").alias("u"), F.col("label").alias("label"), F.col("sig").alias("sig")))
    heads = members.groupBy("node").agg(first.alias("m")).select("node", F.col("m.u").alias("y"), F.col("m.label").alias("other"), F.col("m.sig").alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            n = np.arange(t.num_rows)
            near = alike(_matrix(t), _matrix(t, "head"), n, n) >= least
            x, y = t.column("u").to_numpy()[near], t.column("y").to_numpy()[near]
            yield _pairs(np.stack((np.minimum(x, y), np.maximum(x, y)), 1))

    meet = members.join(heads, "node").filter("u <> y and label <> other")
    return meet.select("u", "sig", "y", "head").mapInArrow(run, "x long, y long")


def maybe_in(wanted: DataFrame) -> Callable[[Column], Column]:
    """A test of ids that is true for all of ``wanted`` (doc_id) and few others: a Bloom filter of three bits an id."""
    n = wanted.count()
    bits = min(FILTER_BITS, 1 << max(10, math.ceil(math.log2(16 * n + 1))))
    at = lambda c: [F.pmod(F.xxhash64(c, F.lit(i)), F.lit(bits)) for i in range(3)]
    places = wanted.select(F.explode(F.array(*at(F.col("doc_id")))).alias("p"))
    set_bits = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b"))
    got = set_bits.toPandas()
    table = np.zeros(bits >> 6, np.int64)
    table[got.w.to_numpy(np.int64)] = got.b.to_numpy(np.int64)
    shared = wanted.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        hit = [(shared.value[x >> 6] >> (x & 63)) & 1 for x in (a.to_numpy(), b.to_numpy(), c.to_numpy())]
        return pd.Series((hit[0] & hit[1] & hit[2]).astype(bool))

    return lambda c: test(*at(c))


def texts_of(docs: DataFrame, wanted: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """``(u, text)`` of the wanted classes: a text of a document of the class that has its set."""
    # stored, so that the planner knows its size
    of = as_table(classes.join(wanted, "u").select("u", F.col("rep").alias("doc_id"), "a", "b"), "near-wanted")
    likely = maybe_in(of.select("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(likely(F.col("doc_id"))).join(of, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.array([keys_of(s) for s in sets_of(b.column("text"), rule.width)], np.int64).reshape(-1, 2)
            same = (keys[:, 0] == b.column("a").to_numpy()) & (keys[:, 1] == b.column("b").to_numpy())
            yield b.select(["doc_id", "u", "text"]).filter(pa.array(same))

    # repeated rows: the join has brought a document's rows together
    right = rows.dropDuplicates(["doc_id", "u", "text"]).mapInArrow(run, "doc_id long, u long, text string")
    return as_table(right.select("u", "text"), "near-texts")


def confirm(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose full sets are linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                x, y = b.column("x").to_numpy(), b.column("y").to_numpy()
                # a star's middle comes in many rows
                at_x, at_y = np.unique(x, return_index=True)[1], np.unique(y, return_index=True)[1]
                left = dict(zip(x[at_x], sets_of(b.column("tx").take(pa.array(at_x)), rule.width), strict=True))
                right = dict(zip(y[at_y], sets_of(b.column("ty").take(pa.array(at_y)), rule.width), strict=True))
                good = [(p, q) for p, q in zip(x, y, strict=True) if rule.linked(left[p], right[q])]
                yield _pairs(good)

    side = lambda c: texts.select(F.col("u").alias(c), F.col("text").alias(f"t{c}"))
    return pairs.join(side("y"), "y").join(side("x"), "x").select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long")


def split_nodes(members: DataFrame) -> DataFrame:
    """Members of nodes with several labels: ``minor`` outside the node's largest label, ``r`` their number."""
    sizes = members.groupBy("node", "label").agg(F.count("*").alias("n"))
    nodes = sizes.groupBy("node").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("c"))
    nodes = nodes.select("node", F.col("top.label").alias("major"), "c", (F.col("c") - F.col("top.n")).alias("r")).filter("r > 0")
    return members.drop("c").join(nodes, "node").withColumn("minor", F.col("label") != F.col("major")).drop("major")


def blocked(nodes: DataFrame) -> DataFrame:
    """Nodes in blocks of members and slices of minor members, about BLOCK rows each: every block meets every slice."""
    blocks, slices = F.ceil(F.col("c") / BLOCK).cast("int"), F.ceil(F.col("r") / BLOCK).cast("int")
    each = nodes.withColumns({"_nb": blocks, "_ns": slices, "_h": F.xxhash64("u", "node")})
    keep = [c for c in nodes.columns if c != "minor"]
    as_member = each.select(
        *keep, F.lit(False).alias("minor"), F.pmod("_h", "_nb").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("_ns") - 1)).alias("slice")
    )
    as_minor = each.filter("minor").select(
        *keep, F.lit(True).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("block"), F.pmod("_h", "_ns").cast("int").alias("slice")
    )
    return as_member.unionByName(as_minor)


GROUP = ["node", "block", "slice"]


def _in_likely_pair(table: pa.Table, sig: np.ndarray, lo: int, hi: int, least: float) -> np.ndarray:
    """Rows lo .. hi that are in a likely pair of a minor member and a member of another label."""
    minor, label = (table.column(c).to_numpy(zero_copy_only=False)[lo:hi] for c in ("minor", "label"))
    ours, theirs = np.flatnonzero(minor), np.flatnonzero(~minor)
    keep = np.zeros(hi - lo, bool)
    for at in range(0, len(ours), 64):
        i, j = np.meshgrid(ours[at : at + 64], theirs, indexing="ij")
        i, j = i.ravel(), j.ravel()
        go = label[i] != label[j]
        i, j = i[go], j[go]
        near = alike(sig[lo:hi], sig[lo:hi], i, j) >= least
        keep[i[near]] = keep[j[near]] = True
    return keep


def candidates(groups: DataFrame, least: float) -> DataFrame:
    """The rows of blocked nodes that are in a likely pair."""
    names = [*GROUP, "u", "label", "minor", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in by_group(batches, GROUP):
            sig, keep = _matrix(table), np.zeros(table.num_rows, bool)
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                keep[lo:hi] = _in_likely_pair(table, sig, lo, hi, least)
            yield from table.filter(pa.array(keep)).to_batches()

    schema = "node long, block int, slice int, u long, label long, minor boolean, sig binary"
    return _sorted(groups.select(*names), *GROUP).mapInArrow(run, schema)


def linked_pairs(minor: list[np.ndarray], member: list[np.ndarray], rule: Rule) -> np.ndarray:
    """Which sets of the one list are linked with which of the other, by exact counts of shared shingles."""
    every = np.concatenate([*minor, *member])
    sizes = np.array([*map(len, minor), *map(len, member)])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    column, seen = np.unique(every, return_inverse=True, return_counts=True)[1:]
    # a shingle of one set is in no intersection
    shared = np.flatnonzero(seen > 1)
    place = np.full(len(seen), -1)
    place[shared] = np.arange(len(shared))
    at = place[column]
    rows, at = rows[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    both = np.zeros((len(minor), len(member)), np.float32)
    for low in range(0, len(shared), COLUMNS):
        part = slice(*np.searchsorted(at, (low, low + COLUMNS)))
        has = np.zeros((len(sizes), min(COLUMNS, len(shared) - low)), np.float32)
        has[rows[part], at[part] - low] = 1
        both += has[: len(minor)] @ has[len(minor) :].T
    both = both.astype(np.int64)
    return 100 * both >= rule.percent * (sizes[: len(minor), None] + sizes[None, len(minor) :] - both)


def exhaust(groups: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Links that join the labels of each group, all its minor members compared with all its members on full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in by_group(batches, GROUP):
            text = table.column("text").combine_chunks()
            minor, label, u = (table.column(c).to_numpy() for c in ("minor", "label", "u"))
            pairs = []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                sets = list(sets_of(text.slice(lo, hi - lo), rule.width))
                i, j = lo + np.flatnonzero(minor[lo:hi]), lo + np.flatnonzero(~minor[lo:hi])
                if not len(i) or not len(j):
                    continue
                hit = linked_pairs([sets[k - lo] for k in i], [sets[k - lo] for k in j], rule) & (label[i][:, None] != label[j][None])
                known = Union(label[lo:hi].tolist())
                for a, b in zip(*np.nonzero(hit), strict=True):
                    x, y = i[a], j[b]
                    if known.join(label[x], label[y]):
                        pairs.append((min(u[x], u[y]), max(u[x], u[y])))
            yield _pairs(pairs)

    rows = groups.drop("sig").join(texts, "u").select(*GROUP, "u", "label", "minor", "text")
    return _sorted(rows, *GROUP).mapInArrow(run, "x long, y long")


def parted(nodes: DataFrame, depth: int) -> DataFrame:
    """Add ``picks``, the BRANCHES coordinates that part a node's members best, and ``dense``, whether they hardly do.

    Members of a large node often share a passage, and with it many minwise tokens;
    of TRIED coordinates those with the most different tokens are taken. Where most members agree even there, they are near copies.
    """
    tried = [(depth * TRIED + c) % SIGNATURE for c in range(TRIED)]
    token = lambda c: F.substring("sig", 4 * c + 1, 4)
    kinds = F.array(*[F.struct(F.negative(F.approx_count_distinct(token(c), 0.1)).alias("n"), F.lit(c).alias("c")) for c in tried])
    best = F.slice(F.array_sort("k"), 1, BRANCHES)
    picks = nodes.groupBy("node").agg(kinds.alias("k"), F.count("*").alias("m")).select(
        "node", F.transform(best, lambda e: e["c"]).alias("picks"), (F.negative(F.element_at(best, -1)["n"]) < F.col("m") / 2).alias("dense")
    )
    return nodes.join(picks, "node")


def children(nodes: DataFrame) -> DataFrame:
    """The nodes below parted() ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            sig, node, u = _matrix(t), t.column("node").to_numpy().view(np.uint64), t.column("u").to_numpy()
            picked = b.column("picks").flatten().to_numpy().astype(np.int64).reshape(-1, BRANCHES)
            below = [_child(words.mix(node + np.uint64(k)), picked[:, k], sig).view(np.int64) for k in range(BRANCHES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(below)), pa.array(np.concatenate([u] * BRANCHES))], ["node", "u"])

    return nodes.select("node", "u", "sig", "picks").mapInArrow(run, "node long, u long")


def _merged(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """Components of earlier ``roots`` (u, root) and newly found links, which are drawn between the roots."""
    if roots is None:
        return components(found)
    of = lambda c: roots.select(F.col("u").alias(c), F.col("root").alias(f"{c}_root"))
    lifted = found.join(of("x"), "x", "left").join(of("y"), "y", "left")
    more = components(lifted.select(F.coalesce("x_root", "x").alias("x"), F.coalesce("y_root", "y").alias("y")))
    up = more.select(F.col("u").alias("root"), F.col("root").alias("_up"))
    moved = roots.join(up, "root", "left").select("u", F.coalesce("_up", "root").alias("root"))
    return as_table(moved.unionByName(more.join(roots, "u", "left_anti").select("u", "root")), "near-roots")


def _members(nodes: DataFrame, signed: DataFrame) -> tuple[DataFrame, int]:
    """Nodes of two members or more, with signatures, stored; and the size of the largest."""
    counts = nodes.groupBy("node").agg(F.count("*").alias("c")).filter("c > 1")
    members = as_table(nodes.join(counts, "node").join(signed, "u"), "near-members")
    return members, members.agg(F.max("c")).first()[0] or 0


def links(docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame | None:
    """``(u, root)`` of the classes that are linked with another; null if none are."""
    least = rule.likely()
    signed = classes.select("u", "sig")
    members, largest = _members(classes.select("u", F.explode("nodes").alias("node")), signed)
    if not largest:
        return None

    # first pass: a forest or a star of likely pairs in each node
    alone = members.withColumn("label", F.col("u"))
    pairs = forest(alone.filter(F.col("c") <= LIMIT), least)
    if largest > LIMIT:
        pairs = pairs.union(stars(alone.filter(F.col("c") > LIMIT), least))
    pairs = as_table(pairs.distinct(), "near-pairs")
    roots, texts = None, None
    if not pairs.isEmpty():
        texts = texts_of(docs, pairs.select(F.col("x").alias("u")).union(pairs.select("y")).distinct(), classes, rule)
        sure = as_table(confirm(pairs, texts, rule), "near-links")
        roots = None if sure.isEmpty() else components(sure)

    # second pass: nodes of several components, large ones branched until their minor members are few
    groups: list[DataFrame] = []
    for depth in range(DEPTH):
        if roots is None:
            known = members.withColumn("label", F.col("u"))
        else:
            known = members.join(roots, "u", "left").withColumn("label", F.coalesce("root", "u")).drop("root")
        mixed = split_nodes(known)
        if largest > LIMIT:
            mixed = as_table(mixed, "near-mixed")
            groups.append(mixed.filter(F.col("r") <= LIMIT))
            large = as_table(parted(mixed.filter(F.col("r") > LIMIT), depth), "near-large")
            last = depth == DEPTH - 1
            groups.append((large if last else large.filter("dense")).drop("picks", "dense"))
            if not last:
                members, largest = _members(children(large.filter("not dense")), signed)
        else:
            groups.append(mixed)
            last = True
        if last or not largest:
            break
    likely = as_table(candidates(blocked(reduce(DataFrame.unionByName, groups)), least), "near-groups")
    if likely.isEmpty():
        return roots
    wanted = likely.select("u").distinct()
    if texts is not None:
        wanted = as_table(wanted.join(texts, "u", "left_anti"), "near-missing")
    if texts is None or not wanted.isEmpty():
        others = texts_of(docs, wanted, classes, rule)
        texts = others if texts is None else texts.unionByName(others)
    found = as_table(exhaust(likely, texts, rule).distinct(), "near-links")
    return roots if found.isEmpty() else _merged(roots, found)


def dedup(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, component_id, kept)`` of every row of ``docs`` (doc_id, text)."""
    made = as_table(features(docs, rule), "near-features")
    usable = made.filter("n_shingles > 0 and doc_id is not null")
    classes = as_table(
        usable.groupBy("a", "b").agg(F.min("rid").alias("u"), F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("nodes").alias("nodes")),
        "near-classes",
    )
    roots = links(docs, classes, rule)
    of = classes.select("a", "b", "u", "rep")
    if roots is not None:
        with_root = of.join(roots, "u", "left").withColumn("root", F.coalesce("root", "u"))
        least = with_root.groupBy("root").agg(F.min("rep").alias("component_id"))
        of = with_root.join(least, "root").select("a", "b", "component_id")
    else:
        of = of.select("a", "b", F.col("rep").alias("component_id"))
    linked = usable.select("doc_id", "text_hash", "n_shingles", "a", "b").join(of, ["a", "b"]).drop("a", "b")
    alone = made.filter("n_shingles = 0 or doc_id is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_documents(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document of least id, once."""
    found = dedup(docs.select("doc_id", "text"), rule).filter("kept").select("doc_id", "text_hash")
    same = docs["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["text_hash"])
    return docs.join(found, same, "left_semi").dropDuplicates(["doc_id", "text"])


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, Rule(width=3, percent=85)).drop("text_hash")
