"""Train / validation / test splits with exact sizes and no global sort.

Rows are in random order by md5(seed, id). Only the two cut points of that order
are computed: a histogram of hash buckets (summed where the rows lie) tells in
which bucket each cut falls, and only that bucket is sorted. The assignment is
then a comparison of each row's hash with the cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_DIGITS = 4  # 65,536 buckets


def check_ratios(val: float, test: float) -> tuple[float, float]:
    """Ratios clamped to [0, 1]; together they must leave something to train on."""
    val, test = max(0.0, min(1.0, val)), max(0.0, min(1.0, test))
    if val + test >= 1.0:
        raise ValueError("val and test ratios must sum to less than 1")
    return val, test


def random_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))


def _apportion(sizes: DataFrame, count: str, drawn: Column) -> Column:
    """Rows to draw per stratum: proportional, remainders to the largest fractions."""
    everyone, ranked = W.partitionBy("all"), W.partitionBy("all").orderBy(F.desc("_frac"), "stratum")
    total = F.sum(count).over(everyone)
    exact = F.col(count) / total * drawn
    work = sizes.withColumns({"_floor": F.floor(exact), "_frac": exact - F.floor(exact)})
    missing = drawn - F.sum("_floor").over(everyone)
    return work.withColumn("_extra", (F.row_number().over(ranked) <= missing).cast("bigint"))


def split_plan(strata: DataFrame, val: float, test: float) -> DataFrame:
    """``(stratum, n_test, n_validation)`` from ``(stratum, n)``.

    The whole test set has ceil(n * test) rows, the validation set
    ceil(rest * val / (1 - test)); what is not drawn to train falls to the set.
    """
    val, test = check_ratios(val, test)
    everyone = W.partitionBy("all")
    left, plan = "n", strata.withColumn("all", F.lit(1))
    for name, ratio in (("n_test", test), ("n_validation", val / (1.0 - test) if val > 0 else 0.0)):
        total = F.sum(left).over(everyone)
        train = (total - F.ceil(total * F.lit(ratio))).cast("bigint")
        plan = _apportion(plan, left, train)
        plan = plan.withColumn("_keep", F.col("_floor") + F.col("_extra")).withColumn(name, F.col(left) - F.col("_keep"))
        plan = plan.withColumn(f"_left_{name}", F.col("_keep")).drop("_floor", "_frac", "_extra", "_keep")
        left = f"_left_{name}"
    return plan.select("stratum", "n_test", "n_validation")


def assign_splits(
    df: DataFrame, key: str = "sent_id", val: float = 0.1, test: float = 0.1, seed: int = 42, stratify: str | None = None
) -> DataFrame:
    """Add ``split``: train, validation or test; ``stratify`` names a boolean column.

    ``key`` must be unique. A row without a stratum is an error. With one stratum
    only, the split is not stratified. The cuts are found when the split is asked for, so derived tables should be stored before. One bucket of a cut is sorted in one task: rows / 65,536 of them.
    """
    check_ratios(val, test)
    if stratify and dict(df.dtypes)[stratify] != "boolean":
        raise TypeError(f"{stratify} must be boolean to stratify by it")
    missing = F.raise_error(F.lit(f"a row without {stratify}")).cast("int")
    stratum = F.coalesce(F.col(stratify).cast("int"), missing) if stratify else F.lit(0)
    slim = df.select(stratum.alias("stratum"), random_key(key, seed).alias("h"))
    bucket = F.substring("h", 1, BUCKET_DIGITS)
    histogram = slim.groupBy("stratum", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # at most two strata times 65,536 buckets from here on
    plan = split_plan(histogram.groupBy("stratum").agg(F.sum("n").alias("n")), val, test)
    wanted = plan.select(
        "stratum",
        F.explode(
            F.array(
                F.struct(F.lit("test").alias("which"), F.col("n_test").alias("rank")),
                F.struct(F.lit("validation").alias("which"), (F.col("n_test") + F.col("n_validation")).alias("rank")),
            )
        ).alias("c"),
    ).select("stratum", "c.*").filter("rank > 0")
    before = F.coalesce(
        F.sum("n").over(W.partitionBy("stratum").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    crossed = (
        histogram.withColumn("before", before)
        .join(F.broadcast(wanted), "stratum")
        .filter((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("n")))
        .select("stratum", "bucket", "which", (F.col("rank") - F.col("before")).alias("nth"))
    )
    # four rows at most, whatever the size of the table
    inside = slim.withColumn("bucket", bucket).join(F.broadcast(crossed), ["stratum", "bucket"])
    nth = F.row_number().over(W.partitionBy("stratum", "which").orderBy("h"))
    cuts = (
        inside.withColumn("i", nth).filter("i = nth").groupBy("stratum")
        .agg(
            F.max(F.when(F.col("which") == "test", F.col("h"))).alias("_test"),
            F.max(F.when(F.col("which") == "validation", F.col("h"))).alias("_validation"),
        )
    )
    # found now, one row a stratum and two strata at most: the split is then a comparison with literals, a plan without a join
    h, of = random_key(key, seed), (F.col(stratify).cast("int") if stratify else F.lit(0))
    split = F.when(of.isNull(), F.raise_error(F.lit(f"a row without {stratify}")))
    for r in cuts.collect():
        for name, cut in (("test", r["_test"]), ("validation", r["_validation"])):
            if cut is not None:
                split = split.when((of == F.lit(r["stratum"])) & (h <= F.lit(cut)), name)
    return df.withColumn("split", split.otherwise("train"))


def hash_splits(df: DataFrame, key: str = "sent_id", val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``split`` by hash thresholds: one map-only pass, sizes hold on average only."""
    val, test = check_ratios(val, test)
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / 1e6
    return df.withColumn("split", F.when(u < test, "test").when(u < test + val, "validation").otherwise("train"))


def split_sizes(df: DataFrame, *by: str) -> DataFrame:
    """Rows per corpus and split."""
    return df.groupBy(*(by or ("corpus", "split"))).agg(F.count(F.lit(1)).alias("n_rows"))


def split_table(df: DataFrame, by: str = "corpus") -> DataFrame:
    """Rows per corpus, a column for each split and ``total``; the splits are named, so no pass looks for them."""
    names = ["train", "validation", "test"]
    counts = split_sizes(df, by, "split").groupBy(by).pivot("split", names).agg(F.sum("n_rows")).fillna(0, names)
    return counts.withColumn("total", sum((F.col(n) for n in names), F.lit(0)))


def eval_sets(df: DataFrame) -> DataFrame:
    """Rows of the held-out sets with their name and ``is_pii``; absent sets give no rows."""
    name = (
        F.when((F.col("corpus") == "pii") & (F.col("split") == "validation"), "pii_val")
        .when((F.col("corpus") == "pii") & (F.col("split") == "test"), "pii_test")
        .when((F.col("corpus") == "conll") & (F.col("split") == "validation"), "conll_valid")
        .when((F.col("corpus") == "conll") & (F.col("split") == "test"), "conll_test")
    )
    return (
        df.filter(F.col("split").isin("validation", "test"))
        .withColumn("eval_set", name).filter("eval_set is not null")
        .withColumn("is_pii", F.col("corpus") == "pii")
    )
