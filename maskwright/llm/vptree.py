"""Approximate nearest neighbours by inner product: vantage-point trees per shard.

Inner products become distances by one more coordinate that gives all candidates
of a band one length; a band is the vectors whose squared norms lie between two
powers of two, and a query is scaled to its band's length, so one long vector
changes nothing for the others. A top tree a band over a bounded sample routes the
vectors to leaves; a leaf's rows are a shard, or several of SHARD rows at most.
Within its shard each search uses a tree built there. The triangle inequality and
the longest norm of a subtree bound its inner products from above. It is left out
if that bound is below the K-th inner product so far, raised by 1 - FACTOR^2 of the
gap to the subtree's shortest norm: factor one is exact, a smaller one visits less.
The gap holds no common offset: for unit vectors the rule is a distance bound
beyond FACTOR times the K-th distance. A query searches its best leaf in each band
first, for a good inner product to prune by, and then the leaves left open.

Equal vectors are one entry with its K + 1 least ids, so masses of copies cost
nothing and cannot fill a shard; equal queries are searched once. Shards are
bounded on both sides: many queries of a leaf meet it in slices of QUERIES. The
driver holds the top trees, ranges of their leaves (LEAVES and one a band at most)
and no rows beyond the sample.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
numbers take no part, nor do those of another length than most; ties go to the
smaller id; a query without candidates gives no rows; repeated rows, and rows of one
id or of a null one, are queries and candidates of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.sources.sinks import as_table

K, FACTOR = 20, 0.8
SHARD, QUERIES, BUCKET = 4096, 4096, 64
LEAVES, PER_LEAF = 1024, 32


@dataclass
class Tree:
    """``inner``: (vantage point, radius, left, right) with leaves as -1 - number; ``paths``: the vantage points above each leaf."""

    points: np.ndarray
    inner: list[tuple[int, float, int, int]]
    paths: list[list[int]]


def grow(x: np.ndarray, size: int, rng: np.random.Generator) -> tuple[Tree, list[np.ndarray]]:
    """A tree with about ``size`` rows a leaf, and each leaf's rows. Vantage points are rows that spread the others most."""
    points, inner, paths, members = [], [], [], []

    def build(rows: np.ndarray, above: list[int]) -> int:
        if len(rows) <= size:
            paths.append(above)
            members.append(rows)
            return -len(paths)
        tried, seen = rows[rng.integers(len(rows), size=4)], rows[rng.integers(len(rows), size=min(128, len(rows)))]
        spread = [distances(x[seen], x[[t]]).std() for t in tried]
        point = x[tried[int(np.argmax(spread))]]
        d = distances(x[rows], point[None])[:, 0]
        radius = float(np.median(d))
        near = d <= radius
        if near.all():
            radius = float(d.max()) if d.max() > d.min() else -1.0
            near = d < radius if radius > 0 else np.arange(len(rows)) < len(rows) // 2
            radius = float(d[near].max()) if radius > 0 else -1.0
        at = len(inner)
        inner.append((len(points), radius, 0, 0))
        points.append(point)
        below = [*above, inner[at][0]]
        left, right = build(rows[near], below), build(rows[~near], below)
        inner[at] = (inner[at][0], radius, left, right)
        return at

    build(np.arange(len(x)), [])
    return Tree(np.array(points).reshape(-1, x.shape[1]), inner, paths), members


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T))


def route(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of each row, and its distances to all vantage points."""
    d = distances(x, tree.points) if len(tree.points) else np.zeros((len(x), 0))
    at = np.full(len(x), 0 if tree.inner else -1)
    while (open_ := at >= 0).any():
        rows = np.flatnonzero(open_)
        nodes = [tree.inner[i] for i in at[rows]]
        near = d[rows, [n[0] for n in nodes]] <= np.array([n[1] for n in nodes])
        at[rows] = np.where(near, [n[2] for n in nodes], [n[3] for n in nodes])
    return -1 - at, d


def bounds(d: np.ndarray, paths: list[list[int]], low: list[np.ndarray], high: list[np.ndarray]) -> np.ndarray:
    """Least distance that the triangle inequality leaves between each query and each leaf."""
    out = np.zeros((len(d), len(paths)))
    for leaf, above in enumerate(paths):
        if above:
            own = d[:, above]
            out[:, leaf] = np.maximum(np.maximum(low[leaf] - own, own - high[leaf]).max(1), 0.0)
    return out


def lifted(x: np.ndarray, square: float) -> np.ndarray:
    """Candidates with one more coordinate, after which all have the squared length ``square``."""
    return np.hstack((x, np.sqrt(np.maximum(0.0, square - (x**2).sum(1)))[:, None]))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(1))


def scaled(q: np.ndarray, square: float) -> np.ndarray:
    """Queries at the squared length ``square``, with a zero for the candidates' last coordinate."""
    return np.hstack((q * (math.sqrt(square) / norms(q))[:, None], np.zeros((len(q), 1))))


def tops(least: np.ndarray, square: float, longest: np.ndarray) -> np.ndarray:
    """Largest inner product with a query of length one that distances of ``least`` and norms of ``longest`` leave, with room for rounding."""
    s = math.sqrt(square)
    return np.minimum(s - least**2 / (2 * s), longest) + 1e-7 * s if s else np.zeros_like(least)


def left_open(top: np.ndarray, kth: np.ndarray, shortest: np.ndarray | float, factor: float) -> np.ndarray:
    """Whether to visit leaves; ``kth``: the K-th inner product so far, for queries of length one."""
    gap = np.where(np.isfinite(kth), np.maximum(shortest - kth, 0.0), 0.0)
    return top >= kth + (1 - factor**2) * gap


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, kth: np.ndarray, square: float, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best rows of a shard for each query, as ids (-1: none) and inner products; ``kth``: inner product to prune by at first."""
    rng = np.random.default_rng(0)
    up, qx, size = lifted(x, square), scaled(q, square), norms(x)
    tree, members = grow(up, BUCKET, rng)
    d, own = distances(qx, tree.points) if len(tree.points) else np.zeros((len(q), 0)), distances(up, tree.points) if len(tree.points) else None
    low = [own[rows][:, above].min(0) if above else None for rows, above in zip(members, tree.paths, strict=True)]
    high = [own[rows][:, above].max(0) if above else None for rows, above in zip(members, tree.paths, strict=True)]
    shortest = [size[rows].min() for rows in members]
    top = tops(bounds(d, tree.paths, low, high), square, np.array([size[rows].max() for rows in members]))
    best, score = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf)
    length = norms(q)
    kth = kth / length

    def visit(queries: np.ndarray, leaf: int) -> None:
        rows = members[leaf]
        s = np.hstack((score[queries], q[queries] @ x[rows].T))
        i = np.hstack((best[queries], np.broadcast_to(ids[rows], (len(queries), len(rows)))))
        order = np.lexsort((i, -s), axis=1)[:, :k]
        score[queries], best[queries] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        kth[queries] = np.maximum(kth[queries], score[queries, -1] / length[queries])

    first = top.argmax(1)
    for leaf in np.unique(first):
        visit(np.flatnonzero(first == leaf), leaf)
    for leaf in np.argsort(-top.max(0)):
        queries = np.flatnonzero(left_open(top[:, leaf], kth, shortest[leaf], factor) & (first != leaf))
        if len(queries):
            visit(queries, leaf)
    return best, score


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vectors take part."""
    v = F.col(column)
    odd = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return rows.filter(v.isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda e: e != 0))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """``(a, b, ids, vec)``: each different vector with its ``k`` least ids; copies are cut to that many before they are shuffled."""
    keyed = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    keyed = keyed.withColumns({"a": F.xxhash64("vec"), "b": F.xxhash64("vec", F.lit(1))})
    few = keyed.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id"))).filter(F.col("r") <= k)
    return few.groupBy("a", "b").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vec").alias("vec"))


@dataclass
class Band:
    """Vectors of similar norm: their largest squared norm, tree, and the number of its first leaf."""

    square: float
    tree: Tree
    base: int


@dataclass
class Index:
    """``low``, ``high``: ranges of the distances to the vantage points above each leaf; ``shortest``, ``longest``: of its norms."""

    bands: dict[int, Band]
    low: list[np.ndarray]
    high: list[np.ndarray]
    shortest: np.ndarray
    longest: np.ndarray
    counts: list[int]
    rows: DataFrame  # leaf, block, cid, vec

    @property
    def squares(self) -> list[float]:
        """Of each leaf."""
        return [band.square for band in self.bands.values() for _ in band.tree.paths]


def matrix(column: pa.Array | pd.Series, width: int) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.array(column.tolist(), np.float64).reshape(-1, width)
    return column.flatten().to_numpy().reshape(-1, width)


def build(vectors: DataFrame, width: int) -> Index:
    """Route all stored ``vectors`` (ids, vec) to the leaves of their band's top tree, and gather the leaves' ranges."""
    norm = F.aggregate("vec", F.lit(0.0), lambda s, e: s + e * e)
    # squares below the smallest number are one band
    vectors = vectors.withColumn("norm", norm).withColumn("band", F.coalesce(F.floor(F.log2("norm")), F.lit(-2000)).cast("int"))
    sizes = vectors.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("square")).orderBy("band").collect()
    n = sum(r.n for r in sizes)
    leaves = {r.band: max(1, min(math.ceil(r.n / SHARD), LEAVES * r.n // n)) for r in sizes}
    parts = {r.band: min(1.0, 2 * leaves[r.band] * PER_LEAF / r.n) for r in sizes if leaves[r.band] > 1}
    place = F.xxhash64("vec", F.lit(9)).bitwiseAND(F.lit((1 << 62) - 1)) / F.lit(float(1 << 62))
    samples = {}
    if parts:
        part = F.element_at(F.create_map(*[F.lit(v) for item in parts.items() for v in item]), F.col("band"))
        sample = vectors.filter(F.col("band").isin(*parts) & (place < part)).select("band", "vec").limit(4 * sum(leaves[i] for i in parts) * PER_LEAF).toPandas()
        samples = {i: matrix(own.vec, width) for i, own in sample.groupby("band")}
    bands, base, rng = {}, 0, np.random.default_rng(4)
    for r in sizes:
        tree = Tree(np.zeros((0, width + 1)), [], [[]])
        if len(own := samples.get(r.band, ())):
            tree, _ = grow(lifted(own, r.square), max(1, math.ceil(len(own) / leaves[r.band])), rng)
        bands[r.band] = Band(r.square, tree, base)
        base += len(tree.paths)
    shared = vectors.sparkSession.sparkContext.broadcast(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            band, x = b.column("band").to_numpy(), matrix(b.column("vec"), width)
            leaf, far = np.zeros(len(x), np.int32), [[]] * len(x)
            for own in np.unique(band):
                at, t = np.flatnonzero(band == own), shared.value[own]
                local, d = route(t.tree, lifted(x[at], t.square))
                leaf[at] = t.base + local
                for i, row, j in zip(at, d, local, strict=True):
                    far[i] = row[t.tree.paths[j]].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf), b.column("cid"), b.column("vec"), b.column("norm"), pa.array(far, pa.list_(pa.float64()))], ["leaf", "cid", "vec", "norm", "far"]
            )

    named = vectors.select(F.col("ids")[0].alias("cid"), "vec", "norm", "band")
    routed = as_table(named.mapInArrow(run, "leaf int, cid long, vec array<double>, norm double, far array<double>"), "ann")
    paths = [p for band in bands.values() for p in band.tree.paths]
    deep = max((len(p) for p in paths), default=0)
    ends = [f(F.try_element_at("far", F.lit(i + 1))).alias(f"{n}{i}") for i in range(deep) for n, f in (("l", F.min), ("h", F.max))]
    ranges = routed.groupBy("leaf").agg(F.count("*").alias("n"), F.min("norm").alias("shortest"), F.max("norm").alias("longest"), *ends)
    got = {r.leaf: r for r in ranges.collect()}
    low, high, counts, shortest, longest = [], [], [], np.zeros(len(paths)), np.zeros(len(paths))
    for leaf, above in enumerate(paths):
        r = got.get(leaf)
        low.append(np.array([r[f"l{i}"] for i in range(len(above))]) if r else np.full(len(above), np.inf))
        high.append(np.array([r[f"h{i}"] for i in range(len(above))]) if r else np.full(len(above), -np.inf))
        counts.append(r.n if r else 0)
        if r:
            shortest[leaf], longest[leaf] = math.sqrt(r.shortest), math.sqrt(r.longest)
    blocks = _by_leaf([max(1, math.ceil(c / SHARD)) for c in counts])
    rows = routed.select("leaf", F.pmod(F.xxhash64("cid"), blocks(F.col("leaf"))).cast("int").alias("block"), "cid", "vec")
    return Index(bands, low, high, shortest, longest, counts, rows)


def _by_leaf(values: list[int]):
    array = F.array(*[F.lit(v) for v in values])
    return lambda leaf: F.element_at(array, leaf + 1)


def visits(index: Index, queries: DataFrame, width: int, first: bool, factor: float) -> DataFrame:
    """Stored ``queries`` (a, b, vec) with ``homes``, their best leaf of each band; or ``(leaf, a, b, vec, kth)``, those with ``homes`` and ``kth`` with the leaves still open."""
    shared = queries.sparkSession.sparkContext.broadcast((index.bands, index.low, index.high, index.shortest, index.longest, index.counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, low, high, shortest, longest, counts = shared.value
        filled = np.array(counts) > 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                q = matrix(b.column("vec"), width)
                top, homes = np.zeros((len(q), len(counts))), []
                for band in bands.values():
                    own = slice(band.base, band.base + len(band.tree.paths))
                    d = distances(scaled(q, band.square), band.tree.points) if len(band.tree.points) else np.zeros((len(q), 0))
                    top[:, own] = np.where(filled[own], tops(bounds(d, band.tree.paths, low[own], high[own]), band.square, longest[own]), -np.inf)
                    homes.append(band.base + top[:, own].argmax(1))
                if first:
                    found = pa.array(np.stack(homes, 1).astype(np.int32).tolist(), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("a", "b", "vec")], found], ["a", "b", "vec", "homes"])
                    continue
                kth = b.column("kth").to_numpy(zero_copy_only=False)
                go = filled & left_open(top, (kth / norms(q))[:, None], shortest, factor)
                seen = b.column("homes").flatten().to_numpy().reshape(len(q), -1)
                go[np.arange(len(q))[:, None], seen] = False
                i, leaf = np.nonzero(go)
                take = pa.array(i, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf.astype(np.int32)), *[b.column(c).take(take) for c in ("a", "b", "vec", "kth")]], ["leaf", "a", "b", "vec", "kth"]
                )

    if first:
        return queries.select("a", "b", "vec").mapInArrow(run, "a long, b long, vec array<double>, homes array<int>")
    return queries.select("a", "b", "vec", "homes", "kth").mapInArrow(run, "leaf int, a long, b long, vec array<double>, kth double")


def searched(index: Index, going: DataFrame, width: int, k: int, factor: float) -> DataFrame:
    """``(a, b, cid, score)``: the best entries of each visited shard."""
    slices = {r.leaf: max(1, math.ceil(r["count"] / QUERIES)) for r in going.groupBy("leaf").count().collect()}
    per_leaf = _by_leaf([slices.get(i, 0) for i in range(len(index.counts))])
    blocks = _by_leaf([max(1, math.ceil(c / SHARD)) for c in index.counts])
    # every block of a leaf meets every slice of its queries
    x = index.rows.withColumn("piece", F.explode(F.sequence(F.lit(1), per_leaf(F.col("leaf"))))) if slices else index.rows.withColumn("piece", F.lit(1))
    x = x.filter(F.array_contains(F.array(*[F.lit(i) for i in sorted(slices)]), F.col("leaf"))) if slices else x.limit(0)
    q = going.withColumn("piece", (F.pmod(F.xxhash64("a", "b"), per_leaf(F.col("leaf"))) + 1).cast("int"))
    q = q.withColumn("block", F.explode(F.sequence(F.lit(0), blocks(F.col("leaf")) - 1)))
    squares = index.squares

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"a": [], "b": [], "cid": [], "score": []}).astype({"a": "int64", "b": "int64", "cid": "int64"})
        found, score = search(
            matrix(x.vec, width), x.cid.to_numpy(), matrix(q.vec, width), q.kth.to_numpy(float), squares[q.leaf.iloc[0]], k, factor
        )
        i, j = np.nonzero(np.isfinite(score))
        return pd.DataFrame({"a": q.a.to_numpy()[i], "b": q.b.to_numpy()[i], "cid": found[i, j], "score": score[i, j]})

    key = ("leaf", "block", "piece")
    return q.groupBy(*key).cogroup(x.groupBy(*key)).applyInPandas(run, "a long, b long, cid long, score double")


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for ``queries``, a part of ``rows`` (vec_id, embedding); a row is not its own neighbour.

    Rows that share their id are told apart by numbers in the order of the ids, and each is a
    candidate of the others. A row equal to a query in id and vector is that query, once for each such row.
    """
    rows, queries = rows.select("vec_id", "embedding"), queries.select("vec_id", "embedding")
    if rows.groupBy("vec_id").count().filter("count > 1 or vec_id is null").isEmpty():
        return _nearest(rows, queries, k, factor)
    number = rows.orderBy("vec_id").withColumn("_row", F.monotonically_increasing_id())
    named = as_table(number, "ann-rows")
    same = lambda df: df.select(F.col("vec_id").alias("_id"), F.xxhash64("embedding").alias("_h"), F.xxhash64("embedding", F.lit(1)).alias("_g")).distinct()
    asks = named["vec_id"].eqNullSafe(F.col("_id")) & (F.xxhash64("embedding") == F.col("_h")) & (F.xxhash64("embedding", F.lit(1)) == F.col("_g"))
    asked = named.join(same(queries), asks, "left_semi")
    by_row = lambda df: df.select(F.col("_row").alias("vec_id"), "embedding")
    out = _nearest(by_row(named), by_row(asked), k, factor)
    ids = lambda row, name: named.select(F.col("_row").alias(row), F.col("vec_id").alias(name))
    return (
        out.withColumnsRenamed({"query_id": "_q", "vec_id": "_n"}).join(ids("_q", "query_id"), "_q").join(ids("_n", "vec_id"), "_n")
        .select("query_id", "rank", "vec_id", "score")
    )


def _nearest(rows: DataFrame, queries: DataFrame, k: int, factor: float) -> DataFrame:
    """nearest() where every id is one row's."""
    spark = rows.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(rows.select(F.col("vec_id").cast("long"), "embedding"))
    width = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not width:
        return none
    width = width[0].w
    vectors = as_table(entries(rows.filter(F.size("embedding") == width), k + 1), "ann-entries")
    index = build(vectors, width)

    asked = usable(queries.select(F.col("vec_id").cast("long"), "embedding")).filter(F.size("embedding") == width)
    asked = asked.select("vec_id", F.col("embedding").cast("array<double>").alias("vec")).withColumns({"a": F.xxhash64("vec"), "b": F.xxhash64("vec", F.lit(1))})
    once = as_table(visits(index, asked.groupBy("a", "b").agg(F.first("vec").alias("vec")), width, True, factor), "ann-queries")
    none_yet = F.lit(float("-inf"))
    home = as_table(once.select(F.explode("homes").alias("leaf"), "a", "b", "vec", none_yet.alias("kth")), "ann-homes")
    near = as_table(searched(index, home, width, k + 1, factor), "ann-near")

    best_first = Window.partitionBy("a", "b").orderBy(F.desc("score"), "cid")
    kth = near.withColumn("r", F.row_number().over(best_first)).filter(F.col("r") == k + 1).select("a", "b", F.col("score").alias("kth"))
    closer = once.join(kth, ["a", "b"], "left").withColumn("kth", F.coalesce("kth", none_yet))
    going = as_table(visits(index, closer, width, False, factor), "ann-going")
    both = near.unionByName(searched(index, going, width, k + 1, factor))
    best = both.withColumn("r", F.row_number().over(best_first)).filter(F.col("r") <= k + 1)

    one = vectors.select(F.col("ids")[0].alias("cid"), "ids")
    each = best.select("a", "b", "cid", "score").join(one, "cid").select("a", "b", "score", F.explode("ids").alias("near_id"))
    order = Window.partitionBy("a", "b").orderBy(F.desc("score"), "near_id")
    few = each.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    lists = few.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("r", "near_id", "score"))).alias("found"))
    own = asked.select(F.col("vec_id").alias("query_id"), "a", "b").join(lists, ["a", "b"])
    others = F.slice(F.filter("found", lambda e: e["near_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(others).alias("p", "f"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.near_id").alias("vec_id"), F.col("f.score").alias("score"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.filter(F.pmod("vec_id", F.lit(20)) == 0))
