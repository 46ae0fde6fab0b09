import hashlib

from pyspark.sql import functions as F

from maskwright.llm import fingerprint as fp
from tests.llm import messy


def test_sums_and_order(spark):
    a, b = "first line\nsecond line that is rather long, longer than a piece\n", "third\n\nfifth\n"
    df = spark.createDataFrame([(a, b, a + b, b + a)], "a string, b string, ab string, ba string")
    f = {c: fp.fingerprint(F.col(c)) for c in df.columns}
    row = df.select(
        (f["ab"] == f["ba"]).alias("order"), (fp.plus(f["a"], f["b"]) == f["ab"]).alias("plus"), (fp.minus(f["ab"], f["b"]) == f["a"]).alias("minus"),
        (f["a"] == f["b"]).alias("same"), fp.likeness(f["ab"], f["ba"]).alias("one"), F.concat(*[F.array_join(fp.pieces(F.col(c)), "") for c in ("a", "b")]).alias("whole"),
    ).first()
    assert (row.order, row.plus, row.minus, row.same, row.one, row.whole) == (True, True, True, False, 1.0, a + b)


def test_likeness_follows_shared_paragraphs(spark):
    lines = [f"paragraph number {i}" for i in range(400)]
    rows = [(n, "\n".join(lines[:200]) + "\n", "\n".join(lines[200 - n : 400 - n]) + "\n") for n in (0, 50, 100, 150)]
    df = spark.createDataFrame(rows, "n int, a string, b string")
    for r in df.select("n", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("l")).collect():
        assert abs(r.l - r.n / 200) < 0.25


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        k = len(t) // 3
        out.append((i, len(t), hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()))
    return out


def test_query_against_a_plain_walk(spark, tmp_path):
    texts = [(i * i % 3001 * 7 - 500, f"text {i}\n" * (i % 9) + "é😀" * (i % 4)) for i in range(1200)]
    texts = list({i: (i, t) for i, t in texts}.values()) + [(None, "the last"), (10**15, None), (-(10**15), messy.LONG)]
    messy.documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    out = fp.op9_fingerprint(spark, str(tmp_path))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(edited(texts), key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text = {}
    for r in got:
        text = dict(texts)[r.doc_id] or ""
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)


def test_messy_and_empty(spark, tmp_path):
    messy.documents(spark).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert fp.op9_fingerprint(spark, f"{tmp_path}/a").count() == len(messy.TEXTS)
    messy.none(spark).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert fp.op9_fingerprint(spark, f"{tmp_path}/b").count() == 0
    messy.documents(spark, [(1, "only one")]).write.parquet(f"{tmp_path}/c/documents.parquet")
    assert fp.op9_fingerprint(spark, f"{tmp_path}/c").first().near_next == 1.0
