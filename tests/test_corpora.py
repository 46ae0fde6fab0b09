import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright import default_catalog, load_catalog, redact_documents
from maskwright.operators import detect, labels
from maskwright.sources import corpora, sinks
from maskwright.sources.spans import ner_spans_in, ner_spans_rejected, valid_documents


def test_tagged_csv(spark, tmp_path):
    good = [["it's", 'say "x"', "a,b", "back\\slash", "nb\xa0sp", "é😀"], ["B-A", "I-A", "O", "I-B", "X", "O"]]
    rows = [(repr(good[0]), repr(good[1])), ("[1, 2.5]", "['O', 'O']"), ("['a']", "['O', 'O']"), ("junk", "['O']"), ("('a',)", "('O',)"), ("{'a': 1}", "['O']"), ("[]", "[]")]
    spark.createDataFrame(rows, "tokens string, labels string").coalesce(1).write.csv(f"{tmp_path}/c", header=True, escape='"')
    got = [(r.tokens, r.labels) for r in corpora.read_tagged_csv(spark, f"{tmp_path}/c").orderBy("sent_id").collect()]
    assert got == [(good[0], ["B-A", "I-A", "O", "B-B", "B-X", "O"]), (["1", "2.5"], ["O", "O"]), ([], [])]
    odd = [("['a', None, True, -3,]", "['O', 'O', 'O', 'O', ]"), ("['None', 'b]']", "['O', 'O']"), ("[1 2]", "['O']"), ("['a']", "[]"), (None, "[]")]
    raw = spark.createDataFrame(odd, "tokens string, labels string")
    assert [r.tokens for r in corpora.parse_tagged(raw).collect()] == [["a", "None", "True", "-3"], ["None", "b]"]]
    assert {r.reason: r.n for r in corpora.rejected_tagged(raw).collect()} == {"not a list literal": 2, "lists of different length": 1}
    with pytest.raises(ValueError):
        corpora.read_tagged_csv(spark, f"{tmp_path}/c", tokens="words")


CONLL = "-DOCSTART- -X- O O\n\nEU NNP B-NP B-ORG\nrejects VB x O\n \nshort line\nGerman JJ B-NP I-MISC\n\n\n\nend NN x O"


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_conll(spark, tmp_path, newline):
    (tmp_path / "train.txt").write_bytes(CONLL.replace("\n", newline).encode())
    (tmp_path / "test.txt").write_bytes(b"")
    (tmp_path / "valid.txt").write_bytes(b"a b c O")
    got = [(r.split, r.tokens, r.labels) for r in corpora.read_conll(spark, str(tmp_path)).orderBy("sent_id").collect()]
    assert got == [("train", ["EU", "rejects", "German"], ["B-ORG", "O", "I-MISC"]), ("train", ["end"], ["O"]), ("validation", ["a"], ["O"])]
    ids = [r.sent_id for r in corpora.read_conll(spark, str(tmp_path)).collect()]
    assert len(set(ids)) == 3
    assert corpora.read_conll(spark, str(tmp_path / "none")).count() == 0


def plain_blocks(data):
    """Runs of non-empty lines, as a reader in text mode sees them."""
    return [b.strip("\n") for b in re.split(r"\n\n+", re.sub("\r\n|\r", "\n", data.decode())) if b.strip("\n")]


def test_mixed_line_ends(spark, tmp_path):
    sentence = lambda i, end: end.join([f"w{i} X Y B-A", f"v{i} X Y O"]) + end + end
    both = "".join(sentence(i, "\n") for i in range(40)) + "".join(sentence(i, "\r\n") for i in range(40, 80)) + "".join(sentence(i, "\r") for i in range(80, 90))
    (tmp_path / "train.txt").write_bytes(both.encode())
    got = corpora.read_conll(spark, str(tmp_path)).orderBy("sent_id").collect()
    assert [r.tokens for r in got] == [[f"w{i}", f"v{i}"] for i in range(90)]
    # a folder of part files of either kind
    (tmp_path / "valid.txt").mkdir()
    for i, end in enumerate(["\n", "\r\n", "\r"]):
        (tmp_path / "valid.txt" / f"part-{i}").write_bytes((end * i + sentence(i, end)).encode())
    parts = corpora.read_conll(spark, str(tmp_path)).filter("split = 'validation'").collect()
    assert sorted(r.tokens[0] for r in parts) == ["w0", "w1", "w2"]


@pytest.mark.parametrize("size", [97, 1000])
def test_runs_over_the_splits_of_a_file(spark, tmp_path, size):
    rng = random.Random(size)
    ends, lines = ["\n", "\r\n", "\r"], ["", "", "a b c O", " ", "x" * 150, "é 😀 y B-Z"]
    for name in ("one.txt", "two.txt"):
        (tmp_path / name).write_bytes("".join(rng.choice(lines) + rng.choice(ends) for _ in range(120)).encode())
    (tmp_path / "none.txt").write_bytes(b"")
    (tmp_path / "blank.txt").write_bytes(b"\n\r\n\r\r")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        docs = corpora.read_raw_text(spark, str(tmp_path))
        assert size == 1000 or corpora._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert len({i for i, _ in rows}) == len(rows)
        want = [plain_blocks((tmp_path / n).read_bytes()) for n in ("one.txt", "two.txt")]
        assert sorted(t for _, t in rows) == sorted(sum(want, []))
        one = [r.text for r in corpora.read_raw_text(spark, str(tmp_path / "one.txt")).orderBy("doc_id").collect()]
        assert one == want[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_chunks_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "raw.txt").write_text("\n\n".join(f"p{i} a b c" for i in range(300)))
    chunks = corpora.numbered_chunks(corpora.paragraph_chunks(corpora.read_raw_text(spark, str(tmp_path / "raw.txt")), chunk_words=2))
    assert [r.text for r in chunks.orderBy("sent_id").collect()] == [t for i in range(300) for t in (f"p{i} a", "b c")]


def test_paragraph_chunks(spark):
    docs = spark.createDataFrame([(1, "a b c d e\n\n \n\n\n f\tg ")], "doc_id bigint, text string")
    got = [(r.para_no, r.chunk_no, r.text, r.n_words) for r in corpora.paragraph_chunks(docs, chunk_words=2).orderBy("para_no", "chunk_no").collect()]
    assert got == [(0, 0, "a b", 2), (0, 1, "c d", 2), (0, 2, "e", 1), (2, 0, "f g", 2)]
    assert corpora.paragraph_chunks(docs, chunk_words=0).count() == 7


def test_documents_and_spans(spark):
    docs = spark.createDataFrame([(1, ""), (2, " "), (3, None)], "doc_id bigint, text string")
    assert [r.doc_id for r in valid_documents(docs).collect()] == [2]
    spans = spark.createDataFrame([(2, 0, 1, "A", 0.1), (9, 0, 1, "A", 0.1)], "doc_id bigint, start int, end int, label string, score double")
    assert [r.doc_id for r in ner_spans_in(docs, spans).collect()] == [2]


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_raw_text(spark, tmp_path, newline):
    (tmp_path / "raw.txt").write_bytes(f"one two{newline}three{newline}{newline}four five".encode())
    docs = corpora.read_raw_text(spark, str(tmp_path / "raw.txt"))
    assert [r.text for r in docs.orderBy("doc_id").collect()] == ["one two\nthree", "four five"]
    one = spark.createDataFrame([(1, f"a b{newline}{newline}c")], "doc_id bigint, text string")
    assert [r.text for r in corpora.paragraph_chunks(one).orderBy("para_no").collect()] == ["a b", "c"]


def test_bad_spans(spark):
    docs = spark.createDataFrame([(1, "Mr Ong was here")], "doc_id bigint, text string")
    bad = [(-3, 2, "X"), (None, 4, "X"), (3, None, "X"), (4, 4, "X"), (6, 2, "X"), (3, 99, "X"), (50, 60, "X"), (0, 2, None), (2**40, 2**41, "X")]
    spans = spark.createDataFrame([(1, s, e, lab, 0.9) for s, e, lab in [*bad, (7, 10, "Z")]], "doc_id bigint, start bigint, end bigint, label string, score double")
    out = redact_documents(docs, ner_spans=spans).first()
    assert out.redacted_text == "***[PERSON#1]*** ***[Z#1]*** here"
    reasons = sorted(r.reason for r in ner_spans_rejected(docs, spans).collect())
    assert reasons == sorted(["before the text", "no offset", "no offset", "empty", "empty", "beyond the text", "beyond the text", "no label", "beyond the text"])
    assert [r.label for r in ner_spans_in(docs, spans).collect()] == ["Z"]


def test_pattern_dialect(spark, tmp_path):
    rules = {"A": r"(?P<my_id>ab)-(?P=my_id)", "B": r"x{,2}y", "C": r"(?m)end$", "D": r"(a)?(?(1)b|c)", "E": r"(?i:straße)z"}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps([{"label": k, "pattern": p} for k, p in rules.items()]))
    catalog = load_catalog(spark, str(path))
    assert [r.label for r in catalog.rules] == ["A", "B", "C", "E"]
    text = "ab-ab xxxy end\nSTRAßEz end"
    found = spark.createDataFrame([(text,)], "text string").select(detect.text_spans("text", catalog.rules).alias("s")).first().s
    want = [(r.label, m.span()) for r in catalog.rules for m in re.finditer(r.pattern, text)]
    assert sorted((s.label, (s.start, s.end)) for s in found) == sorted(want) and len(want) == 5


def test_catalogs(spark, tmp_path):
    base = default_catalog()
    assert [r.specificity for r in base.rules] == sorted((r.specificity for r in base.rules), reverse=True)
    assert [(r.label, r.ord) for r in base.rules if r.specificity == 95] == [("NRIC_SG", 0), ("ADDRESS_LINE", 1)]
    assert len(base.keys) == 22 and base.synonyms["GPE"] == "LOCATION" and base.synonyms["LOCATION"] == "LOCATION"
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps([{"label": "A", "pattern": "a+"}, {"label": "BAD", "pattern": "("}, {"label": "E", "pattern": "x*"}, {"label": "B", "pattern": "b\\b", "specificity": 60}]))
    names = tmp_path / "names.json"
    names.write_text(json.dumps({"X": ["a", "b"], "Y": ["B"]}))
    broken = tmp_path / "broken.json"
    broken.write_text("[{")
    own = load_catalog(spark, str(rules), str(broken), str(names))
    assert [(r.label, r.specificity) for r in own.rules] == [("B", 60), ("A", 50)]
    assert own.keys == [] and own.synonyms == {"A": "X", "B": "Y", "X": "X", "Y": "Y"}
    assert load_catalog(spark, str(tmp_path / "none.json")).rules == base.rules
    out = redact_documents(spark.createDataFrame([(1, "aab c")], "doc_id bigint, text string"), own).first()
    assert out.redacted_text == "***[X#1]******[Y#1]*** c"


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "en", "a@b.example.com x"), (2, "fr", "y")], "doc_id bigint, lang string, text string")
    sinks.write_redaction(redact_documents(docs), f"{tmp_path}/out", partition_by=["lang"])
    assert {r.lang: r.redacted_text for r in spark.read.parquet(f"{tmp_path}/out/redacted").collect()} == {"en": "***[EMAIL#1]*** x", "fr": "y"}
    assert spark.read.parquet(f"{tmp_path}/out/vault").columns == ["doc_id", "placeholder", "original"]
    vocab = labels.label_vocab(spark.createDataFrame([(["I-B", "B-B", "B-A"],)], "labels array<string>"))
    sinks.write_labels(vocab, f"{tmp_path}/labels")
    assert [r.value for r in spark.read.text(f"{tmp_path}/labels/labels").collect()] == ["O", "B-A", "B-B", "I-B"]


def test_stream_equals_batch(spark, tmp_path):
    from maskwright.streaming.redact_stream import start_table_sink, start_text_sink

    docs = spark.createDataFrame([(i, f"Mr Ong{'a' * (i % 3)} wrote to u{i}@mail.example.com") for i in range(40)], "doc_id bigint, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    start_text_sink(stream(), f"{tmp_path}/text", f"{tmp_path}/c1").awaitTermination()
    start_table_sink(stream(), f"{tmp_path}/tables", f"{tmp_path}/c2").awaitTermination()
    want = {(r.doc_id, r.redacted_text) for r in redact_documents(docs).collect()}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/text").collect()} == want
    assert {(r.doc_id, r.redacted_text) for r in spark.read.parquet(f"{tmp_path}/tables/redacted").collect()} == want
    assert spark.read.parquet(f"{tmp_path}/tables/vault").count() == 80


def test_fields_of_plain_and_odd_lines(spark):
    """Plain lines are cut at their spaces, not split into words; both ways give the fields of Python's split()."""
    blocks = [
        "-DOCSTART- -X- -X- O\nAda X Y B-PER\nmet X Y O\nshort X Y\ndocstart X Y O\nfive a b c I-X", "é X Y O\n😀 X Y B-Z", " led X Y O", "end X Y O ", "two  X Y O\na b  c d",
        "tab\tX Y O\na X Y", "no\u00a0break X Y O", "x\u2003y X O", "a X Y O\n\nb X Y O", "\u001fz X Y O\n   \nb X Y O", "doc\u017ftart X Y O\nk X Y O", "a X Y O\r\nb X Y O\r", "", "   ", "one",
    ]

    def fields(block):
        kept = [f for x in block.split("\n") if "DOCSTART" not in x.upper() and len(f := x.split()) >= 4]
        return [f[0] for f in kept], [f[-1] for f in kept]

    frame = spark.createDataFrame([*enumerate(blocks), (99, None)], "i int, value string")
    found = corpora.conll_sentences(frame)
    got = {r.i: (r.tokens, r.labels) for r in found.collect()}
    assert got == {i: f for i, b in enumerate(blocks) if (f := fields(b))[0]}
    # before, each line was split by a regex
    assert "substring_index" in found._jdf.queryExecution().optimizedPlan().toString()


def test_runs_of_a_batch_are_joined_at_once():
    """Runs between empty lines, over batches, splits and files; those closed within a batch leave as one batch."""
    def batch(rows):
        value, file, block, line = zip(*rows, strict=True)
        columns = [pa.array(value), pa.array(file), pa.array(block, pa.int64()), pa.array(line, pa.int64()), pa.array(["k"] * len(rows))]
        return pa.RecordBatch.from_arrays(columns, ["value", "file", "block", "line", "split"])

    text = ["", "a", "b", "", "", "c", "", "d", "e", "f", "", "g"]
    rows = [(x, "p", 0, i) for i, x in enumerate(text)] + [(x, "p", 50, 100 + i) for i, x in enumerate(["h", "", "i", ""])] + [("j", "q", 0, 200)]
    want = [("p", 0, 1, 1, False, "a\nb"), ("p", 0, 3, 5, False, "c"), ("p", 0, 4, 7, False, "d\ne\nf"), ("p", 0, 5, 11, True, "g")]
    want += [("p", 50, 0, 100, False, "h"), ("p", 50, 1, 102, False, "i"), ("p", 50, 2, None, True, ""), ("q", 0, 0, 200, True, "j")]
    for size in (1, 2, 3, 5, len(rows)):
        out = list(corpora._runs_of(iter([batch(rows[i : i + size]) for i in range(0, len(rows), size)])))
        got = [tuple(r[c] for c in ("file", "block", "run", "first", "last", "value")) for b in out for r in b.to_pylist()]
        assert got == want and all(r["split"] == "k" for b in out for r in b.to_pylist())
    assert [b.num_rows for b in out] == [3, 1, 1, 1, 1, 1]
