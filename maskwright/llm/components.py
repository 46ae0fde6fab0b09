"""Connected components of a distributed edge list, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.sources.sinks import as_table


def components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` of every vertex of ``edges`` (x, y); a root stands for its component.

    Each round, every vertex joins its neighbour of least hash, if that is less than
    its own, and edges are redrawn between what they joined; a hash order makes long
    chains shrink by a constant factor a round. Neighbours are reduced before they
    are shuffled, and vertices with many edges are split by the skew join.
    """
    left = as_table(edges.filter("x <> y").select("x", "y").distinct(), "cc-edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("x").alias("u"), F.col("y").alias("v")).union(left.select("y", "x"))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        joined = both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least(rank("u"), "m").alias("m"))
        to = as_table(joined.select("u", F.col("m.id").alias("to")), "cc-map")
        maps.append(to)
        at = lambda c: to.select(F.col("u").alias(c), F.col("to").alias(f"{c}2"))
        moved = left.join(at("x"), "x").join(at("y"), "y").filter("x2 <> y2")
        left = as_table(moved.select(F.least("x2", "y2").alias("x"), F.greatest("x2", "y2").alias("y")).distinct(), "cc-edges")
    if not maps:
        return left.select(F.col("x").alias("u"), F.col("y").alias("root"))
    out = maps[0].select("u", F.col("to").alias("root"))
    for to in maps[1:]:
        step = to.select(F.col("u").alias("root"), F.col("to").alias("_to"))
        out = out.join(step, "root", "left").select("u", F.coalesce("_to", "root").alias("root"))
    return as_table(out, "cc-roots")
