"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# the upper half of a hash's range would be negative
RANGE = float(1 << 63)


def fold(key: str, of: int):
    """crc32 of the key as text, modulo ``of``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(of))


def per_class(rows: DataFrame, label: str, key: str, most: int, seed: int = 5) -> tuple[DataFrame, dict[object, int]]:
    """About ``most`` rows of each class at most, chosen by a hash of the key, and the sizes of the classes.

    The sizes come from one aggregate; each class then has its own hash
    threshold, so no class is gathered or sorted. The row number is hashed too, so that
    a key of many rows counts by its share only.
    """
    sizes = {r[0]: r[1] for r in rows.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}
    place = F.xxhash64(F.col(key).cast("string"), F.monotonically_increasing_id(), F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1)) / F.lit(RANGE)
    chosen = F.lit(False)
    for value, n in sizes.items():
        chosen = chosen | ((F.col(label) == F.lit(value)) & (place < F.lit(min(1.0, most / n))))
    return rows.filter(chosen), sizes
