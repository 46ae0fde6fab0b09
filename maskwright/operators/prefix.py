"""Ordered prefixes of a table: "the first rows, while a running total is below a limit".

A global order without a global sort: keys are unique 64-bit integers, so a block
of 2**16 neighbouring keys holds at most 65,536 rows. Totals per block are summed
where the rows lie; the block where the limit is crossed is then found level by
level, each level a window over at most 65,536 groups. The result is the last
key to keep, and keeping is a plain filter: payload columns are never shuffled.
The cut is found when it is asked for, one small job, so that plans which use it stay small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEP = 16


def last_kept(
    df: DataFrame, key: str, measures: dict[str, Column], keep: Callable[[dict[str, Column]], Column]
) -> DataFrame:
    """One row with ``cut``: the largest key that is kept, null if none is.

    ``keep`` gets, per measure, the total of all rows before a row. It must not
    turn true again once it is false.
    """
    names = list(measures)
    slim = df.select(F.col(key).cast("bigint").alias("k"), *[m.cast("bigint").alias(n) for n, m in measures.items()])
    sums = lambda cols: [F.sum(c).alias(c) for c in cols]
    blocks = slim.groupBy(F.shiftright("k", STEP).alias("k")).agg(*sums(names))

    def crossing(level: DataFrame) -> DataFrame:
        """The last group of a level that still begins below the limit, with its totals before."""
        w = W.partitionBy("parent").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
        before = {n: F.coalesce(F.sum(n).over(w), F.lit(0)) + F.col(f"from_{n}") for n in names}
        kept = level.select("k", *[b.alias(n) for n, b in before.items()]).filter(keep({n: F.col(n) for n in names}))
        return kept.agg(F.max_by(F.struct("k", *names), "k").alias("x")).select(
            F.col("x.k").alias("parent"), *[F.col(f"x.{n}").alias(f"from_{n}") for n in names]
        )

    at = None
    for source, shift in ((blocks, 2 * STEP), (blocks, STEP), (blocks, 0), (slim, 0)):
        group = F.shiftright("k", shift)
        if at is None:
            level = source.select(group.alias("k"), *names, F.lit(0).alias("parent"), *[F.lit(0).alias(f"from_{n}") for n in names])
        else:
            # One row by construction, so broadcasting it is safe at any scale. Null-safe
            # equality adds no filter below the join, so all levels share one exchange of blocks.
            same = F.shiftright("k", shift + STEP).eqNullSafe(F.col("parent"))
            level = source.join(F.broadcast(at), same).withColumn("k", group)
        if shift:
            level = level.groupBy("parent", *[f"from_{n}" for n in names], "k").agg(*sums(names))
        at = crossing(level)
    return at.select(F.col("parent").alias("cut"))


def last_key(df: DataFrame, key: str, measures: dict[str, Column], keep: Callable[[dict[str, Column]], Column]) -> int | None:
    """The last key to keep, found now. Keys must be integers."""
    if dict(df.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be an integer to cut by it")
    return last_kept(df, key, measures, keep).first()["cut"]


def cut_at(df: DataFrame, key: str, measures: dict[str, Column], keep: Callable[[dict[str, Column]], Column]) -> Column:
    """last_key() as a literal; the key at the cut must be one row's."""
    cut = last_key(df, key, measures, keep)
    if cut is not None and df.filter(F.col(key) == cut).limit(2).count() > 1:
        raise ValueError(f"{key} = {cut} is the key of several rows: no cut lies between them")
    return F.lit(cut).cast("bigint")


def head(df: DataFrame, key: str, n: Column | int) -> DataFrame:
    """The first ``n`` rows by ``key``."""
    n = F.lit(n) if isinstance(n, int) else n
    return df.filter(F.col(key) <= cut_at(df, key, {"rows": F.lit(1)}, lambda before: before["rows"] < n))


def row_count(df: DataFrame) -> Column:
    """Number of rows of a table, as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()
