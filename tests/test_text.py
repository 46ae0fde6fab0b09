import random
import re

from pyspark.sql import functions as F

from maskwright.functions import text as tx
from maskwright.sources import fixed_values as fixed

ALPHABET = list("aZ09_ .-'@#:,/\n\t\r+()") + ["é", "ß", "İ", "Σ", "😀", "²", "Ⅷ", "́", " ", "\x1c", "\x85", "٣", "‿", "Ⓐ", "Ltd", "Singapore 123456", "ſ"]


def strings(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_patterns_mean_the_same_in_java(spark):
    values = strings(1500)
    values += [v.encode("ascii", "ignore").decode() for v in values[:600]]
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    patterns = [p for _, _, p in fixed.TEXT_RULES] + [p for *_, p in fixed.CONTEXT_RULES] + [
        r"\b\w+\b", r"\B\d", r"[\w.]+\s$", r"(?i)s.", r"^[^\W\d]+$", fixed.PERSON_GAP, fixed.ADDRESS_GAP, "[[&]+",
    ]
    cols = []
    for i, p in enumerate(patterns):
        exact = F.regexp_extract_all("v", F.lit(tx.java_regex(p)), F.lit(0))
        fast = F.when(tx.same_words(F.col("v")), F.regexp_extract_all("v", F.lit(tx.java_regex(p, True)), F.lit(0)))
        plain = F.when(tx.is_ascii(F.col("v")), F.regexp_extract_all("v", F.lit(tx.java_regex(p, True, True)), F.lit(0)))
        cols += [exact.alias(f"e{i}"), fast.alias(f"f{i}"), plain.alias(f"a{i}")]
    for v, row in zip(values, df.select(*cols).collect()):
        for i, p in enumerate(patterns):
            want = [m.group(0) for m in re.finditer(p, v) if m.group(0)]
            assert [x for x in row[f"e{i}"] if x] == want, (p, v)
            for fast in (row[f"f{i}"], row[f"a{i}"]):
                assert fast is None or [x for x in fast if x] == want, (p, v)


def test_words_strip_and_case(spark):
    values = [v for v in strings(500, 5) if "Σ" not in v]
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    v = F.col("v")
    rows = df.select(tx.words(v).alias("w"), tx.strip(v).alias("s"), tx.swap_case(v).alias("c"), tx.words_at(v).alias("a")).collect()
    for text, r in zip(values, rows):
        assert r.w == text.split() and r.s == text.strip() and r.c == text.swapcase(), repr(text)
        assert [x.word for x in r.a] == text.split() and all(text[x.start:x.end] == x.word for x in r.a)


def test_running_totals_and_cuts_of_long_input(spark):
    n = 3 * tx.BLOCK + 5
    totals = spark.range(1).select(tx.running_totals(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x % 7)).alias("t")).first().t
    assert totals == [sum(i % 7 for i in range(1, k + 1)) for k in range(n)]
    text = "".join(random.Random(1).choice("ab😀é") for _ in range(3 * tx.CHUNK + 17))
    df = spark.createDataFrame([(text,)], "v string").select(tx.chunks(F.col("v")).alias("p"))
    for start, length in [(0, 5), (tx.CHUNK - 2, 4), (tx.CHUNK, 2 * tx.CHUNK), (len(text) - 3, 40), (10, 0)]:
        assert df.select(tx.cut(F.col("p"), F.lit(start), F.lit(length)).alias("c")).first().c == text[start:start + length]
