import random
import re

from pyspark.sql import functions as F

from maskwright.operators import interval, labels


def test_equals_the_tags_made_in_the_row(spark):
    rng = random.Random(4)
    docs, spans = [], []
    for i in range(120):
        text = "".join(rng.choice("ab  é😀\n") for _ in range(rng.choice([0, 5, 40, 900])))
        mine = []
        for _ in range(rng.randint(0, 8)):
            s = rng.randint(0, len(text))
            mine.append((s, min(len(text), s + rng.choice([0, 1, 3, 9, 600])), rng.choice("XY")))
        docs.append((i, text, mine))
        spans += [(i, k, *s) for k, s in enumerate(mine)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, s array<struct<start:int,end:int,label:string>>")
    want = {(r.sent_id, k + 1): t for r in labels.spans_to_bio(frame, "s").collect() for k, t in enumerate(zip(r.tokens, r.labels))}
    words = interval.word_rows(frame.select("doc_id", "text"))
    rows = spark.createDataFrame(spans, "doc_id bigint, ord int, start int, end int, label string")
    for width in (7, interval.BIN):
        got = interval.tag_rows(words, rows, width=width)
        assert {(r.doc_id, r.no): (r.word, r.tag) for r in got.collect()} == want


def test_a_long_document_is_spread(spark):
    """One document with nearly all rows: the join deals it to many bins, and no plan compares all with all."""
    n = 20_000
    words = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") + 1).cast("int").alias("no"), (F.col("id") * 4).cast("int").alias("start"), (F.col("id") * 4 + 3).cast("int").alias("end"), F.lit("abc").alias("word"))
    spans = spark.range(0, n, 3).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("ord"), (F.col("id") * 4).cast("int").alias("start"), (F.col("id") * 4 + 6).cast("int").alias("end"), F.lit("X").alias("label"))
    out = interval.tag_rows(words, spans)
    assert {r.tag: r["count"] for r in out.groupBy("tag").count().collect()} == {"B-X": 6667, "I-X": 6667, "O": 6666}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    bins = words.select(F.floor(F.col("start") / interval.BIN).alias("b")).distinct().count()
    assert bins > 300


def test_empty_null_and_touching_ranges(spark):
    left = spark.createDataFrame([(1, 1, 0, 3), (1, 2, 3, 3), (1, 3, None, 4), (2, 4, 0, 3), (None, 5, 0, 3)], "doc_id int, no int, start int, end int")
    right = spark.createDataFrame([(1, 1, 3, 9), (1, 2, 2, 3), (1, 6, 2, 2), (1, 7, 3, 3), (1, 8, 5, 1), (2, 3, -5, 1), (3, 4, 0, 9), (None, 5, 0, 3)], "doc_id int, ord int, start int, end int")
    assert sorted((r.doc_id, r.no, r.ord) for r in interval.overlaps(left, right, width=2).collect()) == [(1, 1, 2), (1, 1, 6), (2, 4, 3)]


def by_pairs(words, spans):
    """The rule, word by word: all words of a document and number count as one, and all spans of a document and ``ord``."""
    met = {(k, no, o, x) for k, no, ws, we, _ in words for d, o, s, e, x in spans if None not in (k, ws, we) and k == d and ws <= we and s <= e and ws < e and we > s}
    first, top = {}, {}
    for k, no, o, x in met:
        first[k, o] = min(no, first.get((k, o), no))
        top[k, no] = max((o, x), top.get((k, no), (o, x)))
    out = []
    for k, no, _, _, word in words:
        o, x = top.get((k, no), (None, None))
        lasts = o is not None and first[k, o] < no and top.get((k, no - 1), (0, None))[1] == x
        out.append((k, no, word, "O" if o is None else ("I-" if lasts else "B-") + x))
    return sorted(out, key=str)


def test_words_over_many_bins_repeated_and_null_keys(spark):
    rng = random.Random(9)
    words, spans = [], []
    for k in [*range(60), None]:
        at, mine, found = 0, [], []
        for no in range(1, rng.randint(2, 25)):
            at += rng.choice([1, 1, 2, 9])
            end = at + rng.choice([1, 2, 3, 5, 17, 40])
            mine.append((k, no, at, end, f"w{k}.{no}"))
            at = end
        for o in range(rng.randint(0, 9)):
            s = rng.randint(0, at)
            found.append((k, o, s, s + rng.choice([0, 1, 4, 12, 60]), rng.choice("XY")))
        # every fifth document comes twice
        words, spans = words + mine * (2 if k and k % 5 == 0 else 1), spans + found * (2 if k and k % 5 == 0 else 1)
    words += [(1, 99, None, 4, "n"), (1, 100, 5, 4, "r")]
    frames = [spark.createDataFrame(words, "doc_id bigint, no int, start int, end int, word string"), spark.createDataFrame(spans, "doc_id bigint, ord int, start int, end int, label string")]
    for width in (4, 16, interval.BIN):
        assert sorted(map(tuple, interval.tag_rows(*frames, width=width).collect()), key=str) == by_pairs(words, spans)


def test_one_key_with_two_texts(spark):
    words = [(1, 1, 0, 3, "abc"), (1, 2, 4, 6, "de"), (1, 1, 0, 1, "x"), (1, 2, 2, 9, "yyyyyyy"), (1, 3, 10, 12, "zz")]
    spans = [(1, 0, 0, 3, "X"), (1, 1, 4, 6, "Y"), (1, 0, 0, 6, "X"), (1, 1, 7, 11, "X")]
    frames = [spark.createDataFrame(words, "doc_id bigint, no int, start int, end int, word string"), spark.createDataFrame(spans, "doc_id bigint, ord int, start int, end int, label string")]
    assert sorted(map(tuple, interval.tag_rows(*frames).collect()), key=str) == by_pairs(words, spans)


def test_words_are_shuffled_once(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0, 3, "abc"), (1, 2, 4, 6, "de"), (1, 3, 300, 301, "f")], "doc_id int, no int, start int, end int, word string").write.parquet(f"{tmp_path}/w")
    spark.createDataFrame([(1, 0, 0, 400, "X")], "doc_id int, ord int, start int, end int, label string").write.parquet(f"{tmp_path}/s")
    out = interval.tag_rows(spark.read.parquet(f"{tmp_path}/w"), spark.read.parquet(f"{tmp_path}/s"))
    assert [r.tag for r in out.orderBy("no").collect()] == ["B-X", "I-X", "I-X"]
    plan = out._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    nodes = [re.sub(r"^[\s:+*-]*(?:\*?\(\d+\))?\s*", "", x) for x in plan.toString().split("Initial Plan")[0].splitlines()]
    count = lambda name: len([x for x in nodes if x.startswith(name)])
    # before, words and spans were dealt anew for each of the joins and aggregates
    assert (count("Exchange hashpartitioning"), count("ReusedExchange"), count("SortMergeJoin") + count("BroadcastHashJoin")) == (2, 1, 0)
