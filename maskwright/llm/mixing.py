"""Mixing sources to target weights: temperature, repetition limit, budgeted block permutations.

The share p of a source's tokens becomes the weight p^a / sum p^a. The exponent
is bisected until the weights have a target entropy: between 0 (all sources
alike) and 1 (as they are), or above 1 where the shares are more even than the target.
If a source would then be repeated too often, it is bisected back towards 1 until
the repetition limit holds. ``target_met`` says whether both targets are met: shares
that are all alike have one entropy only, and keep exponent 1. The weights are realised by blocks: a source's documents
fall into blocks, every epoch puts the blocks in an order of its own, whole
epochs take all blocks, and the last one takes blocks up to the budget (the last
block only if that comes nearer to it).

Built-in SQL functions only. Bisection reads the table of sources, one row each;
several halvings share one aggregate. Only block totals are sorted, at most
BLOCKS of a source in one window. Documents move once, to meet their blocks, and
a source with most of the rows is spread over its blocks.

Defined cases: a null source is a source of its own; a document without words
has no tokens but belongs to a block and is taken with it; a source without
tokens is taken once; repeated rows are separate documents, rows of one id or of none are spread
by their texts, and only rows that share both lie in one block; an empty table gives
an empty result; other columns pass through inside ``row``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.sources.sinks import as_table

BLOCKS = 1024
# halvings in all, and those that one aggregate decides
HALVINGS, AT_ONCE = 24, 4
# the greatest exponent that is tried, a power of two
MOST = 1024
SEED = 11


@dataclass(frozen=True)
class Mix:
    """``entropy``: the target as a part of the greatest possible, null for none; ``repeats``: most epochs of a source.

    ``budget``: tokens of the mix; "same" takes as many as there are, "cover" the
    least number that leaves no document out.
    """

    entropy: float | None = 0.9
    repeats: float | None = 4.0
    budget: int | str = "same"


def tokens(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Shares:
    """What the bisection knows of the sources: number, tokens, and the largest and smallest source's."""

    n: int
    total: float
    high: float
    low: float

    @property
    def spread(self) -> float:
        return self.low / self.high


@dataclass(frozen=True)
class Temper:
    """An exponent, its sum of powers of (tokens / largest), the entropy of its weights, and whether the targets are met."""

    a: float
    z: float
    entropy: float
    met: bool = True


def _shares(totals: DataFrame) -> Shares:
    n, total, low, high = totals.filter("tokens > 0").agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    return Shares(n, float(total), float(high), float(low)) if n else Shares(0, 0.0, 0.0, 0.0)


def _tempered(totals: DataFrame, s: Shares, exponents: list[float]) -> list[Temper]:
    """Sum of powers and entropy for each exponent, in one aggregate."""
    # relative to the largest source, so that no power is too small
    q = F.col("tokens") / F.lit(s.high)
    sums = [x for a in exponents for x in (F.sum(F.pow(q, F.lit(a))), F.sum(F.pow(q, F.lit(a)) * F.log(q)))]
    got = totals.filter("tokens > 0").agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()
    # w = q^a / z, so the entropy is log z - a / z * sum q^a log q
    return [Temper(a, got[2 * i], math.log(got[2 * i]) - a * got[2 * i + 1] / got[2 * i]) for i, a in enumerate(exponents)]


def _budget(t: Temper, s: Shares, mix: Mix) -> float:
    if mix.budget == "cover":
        # the source with the fewest epochs, the largest below an exponent of 1 and the smallest above, has one
        return t.z * s.high / min(1.0, s.spread ** (t.a - 1))
    return s.total if mix.budget == "same" else float(mix.budget)


def _repeats(t: Temper, s: Shares, mix: Mix) -> float:
    """Epochs of the source that has most."""
    return _budget(t, s, mix) / (t.z * s.high) * max(1.0, s.spread ** (t.a - 1))


def _first(totals: DataFrame, s: Shares, wrong: Callable[[Temper], bool], low: float, high: Temper) -> Temper:
    """The nearest exponent to ``low``, where ``wrong`` holds, at which it does not, as at ``high``."""
    for _ in range(HALVINGS // AT_ONCE):
        step = (high.a - low) / 2**AT_ONCE
        grid = _tempered(totals, s, [low + step * i for i in range(1, 2**AT_ONCE)])
        for _ in range(AT_ONCE):
            half = len(grid) // 2
            if wrong(grid[half]):
                low, grid = grid[half].a, grid[half + 1 :]
            else:
                high, grid = grid[half], grid[:half]
    return high


def bisect(totals: DataFrame, mix: Mix, s: Shares) -> Temper:
    """The exponent at which the entropy is the target; where the repetition limit does not hold there, the nearest to it where it does."""
    powers = [0.0, *[float(1 << i) for i in range(MOST.bit_length())]]
    tried = dict(zip(powers, _tempered(totals, s, powers), strict=True))
    target = math.inf if mix.entropy is None else mix.entropy * math.log(s.n)

    def too_even(t: Temper) -> bool:
        return t.entropy > target * (1 + 1e-9) + 1e-9

    def too_often(t: Temper) -> bool:
        return mix.repeats is not None and _repeats(t, s, mix) > mix.repeats * (1 + 1e-9)

    plain, even = tried[1.0], [a for a in powers if too_even(tried[a])]
    reached = len(even) < len(powers)
    if not even:
        best = tried[0.0]
    elif reached:
        best = _first(totals, s, too_even, even[-1], tried[powers[len(even)]])
    else:
        best = plain
    if too_often(best) and best.a != plain.a:
        reached = False
        best = plain if too_often(plain) else _first(totals, s, too_often, best.a, plain)
    # without a target the least exponent that the limit allows is the right one
    met = (reached or mix.entropy is None) and not too_often(best)
    return replace(best, met=met and (mix.entropy is None or even != [] or abs(best.entropy - target) <= 1e-3 * target))


def weights(totals: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``(source, tokens, weight, epochs, target_met)`` for stored totals."""
    s = _shares(totals)
    if not s.n:
        return totals.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs"), F.lit(True).alias("target_met"))
    t = bisect(totals, mix, s)
    has = F.col("tokens") > 0
    weight = F.pow(F.col("tokens") / F.lit(s.high), F.lit(t.a)) / F.lit(t.z)
    epochs = weight * F.lit(_budget(t, s, mix)) / F.col("tokens")
    return totals.select(
        "source", "tokens", F.when(has, weight).otherwise(F.lit(0.0)).alias("weight"),
        F.when(has, epochs).otherwise(F.lit(1.0)).alias("epochs"), F.lit(t.met).alias("target_met"),
    )


def _block(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(SEED)), F.lit(BLOCKS)).cast("int")


def realise(blocks: DataFrame, weighted: DataFrame) -> DataFrame:
    """Block totals ``(source, block, tokens)`` and weights -> the taken ``(source, block, epoch, weight, target_met, position)``.

    ``position`` in [0, 1) orders the mix: a source's blocks lie evenly, in each epoch's own order.
    """
    of = weighted.select(F.col("source").alias("_s"), F.col("tokens").alias("_all"), "weight", "epochs", "target_met")
    each = blocks.join(of, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # 1e-9: the share of a source may miss a whole number of epochs by rounding only
    last = F.ceil(F.col("epochs") - 1e-9).cast("int")
    each = each.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1)))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("block", "epoch", F.lit(SEED)), "block")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = (F.col("epochs") - F.col("epoch")) * F.col("_all")
    taken = each.withColumn("_before", before).filter(
        (F.col("_all") == 0) | (F.col("epoch") + 1 <= F.col("epochs") + 1e-9) | (F.col("_before") + F.col("tokens") / 2 <= left)
    )
    part = F.when(F.col("_all") > 0, F.col("_before") / F.col("_all")).otherwise(F.lit(0.0))
    return taken.select("source", "block", "epoch", "weight", "target_met", ((F.col("epoch") + part) / F.greatest("epochs", F.lit(1e-9))).alias("position"))


def mixed(docs: DataFrame, mix: Mix = Mix(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(row, tokens, block, epoch, weight, position, target_met)``, one for each taken document and epoch; ``row`` holds its columns."""
    dealt = docs.select(F.struct("*").alias("row"), F.col("source").alias("_source"), tokens(F.col(text)).alias("tokens"), _block(F.col(key), F.col(text)).alias("_block"))
    blocks = as_table(
        dealt.groupBy(F.col("_source").alias("source"), F.col("_block").alias("block")).agg(F.sum("tokens").alias("tokens")), "mix-blocks"
    )
    totals = as_table(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-totals")
    plan = realise(blocks, weights(totals, mix))
    meets = F.col("_source").eqNullSafe(F.col("source")) & (F.col("_block") == F.col("block"))
    taken = plan.select("source", "block", "epoch", "weight", "position", "target_met")
    return dealt.join(taken, meets).select("row", dealt["tokens"], "block", "epoch", "weight", "position", "target_met")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, without their texts: entropy at 0.9 of the greatest, at most four epochs, as many tokens as before; target_met if so."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed(docs).select("row.doc_id", "row.source", "tokens", "block", "epoch", "weight", "position", "target_met")
