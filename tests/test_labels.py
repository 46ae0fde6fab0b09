import math
import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions import bio
from maskwright.functions import text as tx
from maskwright.operators import evaluate, labels, mixes, splits
from maskwright.operators.prefix import head, last_kept
from tests import model

CORPUS = "sent_id bigint, tokens array<string>, labels array<string>"


def test_repair_and_entities_match_the_model(spark):
    rng = random.Random(11)
    rows = [[rng.choice(["O", "B-A", "I-A", "B-B", "I-B", "A", "I-x-y", "B-x-y"]) for _ in range(rng.randint(0, 12))] for _ in range(1500)]
    df = spark.createDataFrame([(r,) for r in rows], "l array<string>").coalesce(1)
    out = df.select(bio.sanitize(F.col("l")).alias("s")).select("s", tx.let(F.col("s"), bio.entities).alias("e")).collect()
    for raw, r in zip(rows, out):
        assert r.s == model.repaired(raw)
        assert [tuple(e) for e in r.e] == model.bio_entities(r.s)


def test_word_tags_match_the_model(spark):
    rng = random.Random(13)
    rows = []
    for _ in range(800):
        text = "".join(rng.choice("ab  é😀\n") for _ in range(rng.randint(0, 40)))
        spans = []
        for _ in range(rng.randint(0, 6)):
            s = rng.randint(0, len(text))
            spans.append((s, min(len(text), s + rng.randint(0, 9)), rng.choice("XY")))
        rows.append((text, spans))
    df = spark.createDataFrame(rows, "text string, s array<struct<start:int,end:int,label:string>>").withColumn("doc_id", F.monotonically_increasing_id())
    for (text, spans), r in zip(rows, labels.spans_to_bio(df, "s").orderBy("sent_id").collect()):
        assert (r.tokens, r.labels) == model.word_tags(text, spans), (text, spans)


def test_vocabulary_and_encoding(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["I-B", "O"]), (2, [], []), (3, ["c"], ["B-A"])], CORPUS)
    vocab = labels.label_vocab(df)
    assert [(r.label, r.id) for r in vocab.collect()] == [("O", 0), ("B-A", 1), ("I-B", 2)]
    coded = {r.sent_id: r.ner_tags for r in labels.encode_labels(df, vocab).collect()}
    assert coded == {1: [2, 0], 2: [], 3: [1]}
    with pytest.raises(Exception, match="unknown label I-B at position 0"):
        labels.encode_labels(df, vocab.filter("id < 2")).collect()
    with pytest.raises(Exception, match="unknown label <null> at position 1"):
        labels.encode_labels(spark.createDataFrame([(1, ["a", "b"], ["O", None])], CORPUS), vocab).collect()
    twice = spark.createDataFrame([(7, ["a"], ["B-A"]), (7, ["b", "c"], ["O", "I-B"])], CORPUS)
    assert sorted(r.ner_tags for r in labels.encode_labels(twice, vocab).collect()) == [[0, 2], [1]]


def test_repair_by_hand(spark):
    rows = [(["I-A", "I-A"], ["B-A", "I-A"]), (["A", "I-A"], ["B-A", "I-A"]), (["B-A", "O", "I-A"], ["B-A", "O", "B-A"]), (["B-A", "I-B", "I-B"], ["B-A", "B-B", "I-B"])]
    df = spark.createDataFrame([(a, b) for a, b in rows], "l array<string>, want array<string>")
    assert all(r.s == r.want for r in df.select("want", bio.sanitize(F.col("l")).alias("s")).collect())


def test_repeated_or_odd_keys_are_no_cut(spark):
    df = spark.createDataFrame([(5, ["a"], ["O"])] * 10 + [(1, ["a"], ["O"])], CORPUS)
    with pytest.raises(ValueError, match="several rows"):
        mixes.cap_by_ratio(df, 0.2, 10)
    assert mixes.cap_by_ratio(df, 0.1, 10).count() == 1
    with pytest.raises(TypeError):
        head(df.withColumn("sent_id", F.col("sent_id").cast("string")), "sent_id", 2)


def test_strata_must_be_known(spark):
    flags = spark.createDataFrame([(i, None if i == 3 else i % 2 == 0) for i in range(20)], "sent_id bigint, has_pii boolean")
    with pytest.raises(Exception, match="a row without has_pii"):
        splits.assign_splits(flags, stratify="has_pii").collect()
    with pytest.raises(TypeError):
        splits.assign_splits(flags.withColumn("has_pii", F.lit("x")), stratify="has_pii")


def test_training_plan(spark, tmp_path):
    from maskwright.plans import training

    pii = spark.range(60).select(
        F.col("id").alias("sent_id"), F.array(F.lit("Ann"), F.lit("x")).alias("tokens"),
        F.when(F.col("id") % 3 > 0, F.array(F.lit("B-PERSON"), F.lit("O"))).otherwise(F.array(F.lit("O"), F.lit("O"))).alias("labels"),
    )
    docs = spark.createDataFrame([(9, "Ann b\r\n\r\nc d"), (4, "Ann"), (5, None)], "doc_id bigint, text string")
    span = F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("PERSON").alias("label"))
    pseudo = training.pseudo_corpus(docs, lambda t: F.when(t.startswith("Ann"), F.array(span)).otherwise(F.array().cast("array<struct<start:int,end:int,label:string>>")))
    rows = pseudo.collect()
    assert len({r.sent_id for r in rows}) == 3 and sorted((r.tokens, r.labels) for r in rows)[0] == (["Ann"], ["B-PERSON"])
    for strategy in ("joint", "curriculum", "sequential"):
        mix, held_out, vocab = training.training_mix(pii, pii, pseudo, training.Options(strategy, stratify=True, factor=1.5, general_ratio=0.5, pseudo_ratio=1.0))
        assert held_out.count() == 12 and [r.label for r in vocab.orderBy("id").collect()] == ["O", "B-PERSON"]
        plan = mix._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") < 50
        training.write_training(mix, held_out, vocab, str(tmp_path / strategy))
        assert spark.read.parquet(f"{tmp_path}/{strategy}/train").count() == mix.count()
    with pytest.raises(ValueError):
        training.training_mix(pii, options=training.Options("none"))


def test_align_truncate_and_swapcase(spark):
    df = spark.createDataFrame([([5, 6, 7], [None, 0, 0, 2, 1, 1, None, 1])], "ner_tags array<int>, word_ids array<int>")
    assert labels.align_subwords(df).first().aligned == [-100, 5, -100, 7, 6, -100, -100, 6]
    assert labels.align_subwords(df, label_all=True).first().aligned == [-100, 5, 5, 7, 6, 6, -100, 6]
    rows = spark.createDataFrame([(1, ["aB", "12", "ß"], ["B-A", "O", "O"], True), (2, ["x"], ["O"], True), (3, ["y"], ["B-A"], False)], CORPUS + ", is_pii boolean")
    got = [(r.sent_id, r.augmented, r.tokens) for r in labels.add_swapcase(rows).orderBy("sent_id", "augmented").collect()]
    assert got == [(1, False, ["aB", "12", "ß"]), (1, True, ["Ab", "12", "SS"]), (2, False, ["x"]), (3, False, ["y"])]
    assert labels.truncate(rows, 2).orderBy("sent_id").first().tokens == ["aB", "12"]


def test_prefixes_of_dense_sparse_and_negative_keys(spark):
    rng = random.Random(17)
    for keys in (range(-20, 3000), {rng.randint(-(2**62), 2**62) for _ in range(3000)}):
        keys = sorted(keys)
        df = spark.createDataFrame([(k, abs(k) % 5) for k in rng.sample(keys, len(keys))], "sent_id bigint, w int")
        for n in (0, 1500, len(keys) + 9):
            assert sorted(r.sent_id for r in head(df, "sent_id", n).collect()) == keys[:n]
        cut = last_kept(df, "sent_id", {"rows": F.lit(1), "w": F.col("w")}, lambda b: (b["rows"] < 2500) & (b["w"] < 1000)).first().cut
        total, want = 0, None
        for i, k in enumerate(keys):
            if i < 2500 and total < 1000:
                want = k
            total += abs(k) % 5
        assert cut == want


def test_caps_and_copies(spark):
    df = spark.range(100).select(F.col("id").alias("sent_id"), F.array(F.lit("a")).alias("tokens"), F.array(F.lit("B-A")).alias("labels"))
    for ratio, base, want in ((None, 10, 100), (0.0, 10, 100), (0.5, 0, 100), (0.01, 10, 100), (0.55, 11, 6), (9.0, 50, 100)):
        assert mixes.cap_by_ratio(df, ratio, base).count() == want, (ratio, base)
    assert mixes.oversample(df, 1.0).count() == 100 and mixes.oversample(df, 2.25).count() == 225
    assert mixes.pseudo_limit(df, limit=7).count() == 7 and mixes.pseudo_limit(df, token_limit=5).count() == 5
    small, pseudo = df.filter("sent_id < 10"), df.filter("sent_id < 50")
    mix = mixes.joint_mix(small, pseudo, df, pseudo_ratio=0.5, general_ratio=2.0, factor=1.8, augment=True)
    got = {(r.corpus, r.augmented): r["count"] for r in mix.groupBy("corpus", "augmented").count().collect()}
    # 15 PII and pseudo rows, int(15 * 0.8) = 12 repeated: all PII and two pseudo rows
    assert got == {("pii", False): 20, ("pii", True): 20, ("pseudo", False): 7, ("pseudo", True): 7, ("conll", False): 20}
    stages = mixes.sequential_mix(small, df, pseudo, factor=2.0).groupBy("stage").count().collect()
    assert {r.stage: r["count"] for r in stages} == {1: 100, 2: 120}
    with pytest.raises(ValueError):
        mixes.sequential_mix(small, None)


def test_split_sizes(spark):
    df = spark.range(1003).select(F.col("id").alias("sent_id"), (F.col("id") % 10 == 0).alias("has_pii"))
    for val, test in ((0.1, 0.1), (0.15, 0.2), (0.0, 0.3), (0.2, 0.0), (-1.0, 0.0)):
        v, t = max(0.0, val), max(0.0, test)
        n_test = math.ceil(1003 * t)
        n_val = math.ceil((1003 - n_test) * (v / (1 - t)))
        for by in (None, "has_pii"):
            out = splits.assign_splits(df, "sent_id", val, test, 1, stratify=by)
            got = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
            want = {"train": 1003 - n_test - n_val, "test": n_test, "validation": n_val}
            assert got == {k: n for k, n in want.items() if n}
            if by and t:
                share = out.filter("split = 'test' and has_pii").count()
                assert abs(share - n_test * 101 / 1003) < 1.01
    with pytest.raises(ValueError):
        splits.assign_splits(df, "sent_id", 0.5, 0.5)
    sizes = {r.split: r["count"] for r in splits.hash_splits(df).groupBy("split").count().collect()}
    assert sum(sizes.values()) == 1003 and 50 < sizes["test"] < 150


def test_scores(spark):
    rows = [("a", ["B-X", "I-X", "O", "B-Y"], ["B-X", "I-X", "O", "B-X"]), ("a", ["O", "B-Y"], ["I-Y", "O"]), ("b", ["O"], ["O"])]
    df = spark.createDataFrame(rows, "eval_set string, true_tags array<string>, pred_tags array<string>")
    by_type = {r.entity_type: (r.precision, r.recall, r.f1) for r in evaluate.scores_by_type(df).collect()}
    assert by_type == {"X": (0.5, 1.0, pytest.approx(2 / 3)), "Y": (0.0, 0.0, 0.0)}
    overall = evaluate.scores_overall(df).first()
    assert (overall.precision, overall.recall) == (pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert evaluate.macro_f1(df).first().macro_f1 == pytest.approx(1 / 3)
    nothing = evaluate.scores_overall(df.filter("eval_set = 'b'")).first()
    assert (nothing.precision, nothing.recall, nothing.f1) == (0.0, 0.0, 0.0)
    assert {(r.eval_set, r.entity_type) for r in evaluate.report(df).collect()} == {("a", "X"), ("a", "Y"), ("a", "overall"), ("b", "overall")}


def test_decode(spark):
    df = spark.createDataFrame([([[0.1, 0.9], [0.5, 0.5], [0.0, 1.0]], [1, 0, -100])], "logits array<array<float>>, label_ids array<int>")
    r = evaluate.decode_predictions(df, ["O", "B-X"]).first()
    assert (r.true_tags, r.pred_tags) == (["B-X", "O"], ["B-X", "O"])
