from datetime import datetime, timedelta

from checks import queries as registered
from maskwright import redact_documents
from maskwright.streaming.redact_stream import Wait, start_joined_sink

START = datetime(2024, 1, 1)
DOCS = "doc_id bigint, at timestamp, text string, extra string"
SPANS = "doc_id bigint, start bigint, end bigint, label string, score double, found_at timestamp"
WAIT = Wait("10 minutes", "1 minute")


def at(minutes):
    return START + timedelta(minutes=minutes)


def run(spark, base, docs, spans):
    """Streams of one file a batch; a far later row on either side lets all others leave."""
    sides = {"docs": ([*docs, [(10**6, at(10_000), "end", "x")]], DOCS), "spans": ([*spans, [(10**6 + 1, 0, 1, "X", 0.1, at(10_000))]], SPANS)}
    streams = []
    for name, (batches, schema) in sides.items():
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/{name}/n={i:02d}")
        streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/{name}/n=*"))
    for q in start_joined_sink(*streams, f"{base}/out", f"{base}/state", WAIT):
        q.awaitTermination()
    return [spark.read.parquet(f"{base}/out/{t}").filter("doc_id < 1000000").collect() for t in ("redacted", "rejects")]


def test_stream_result_is_the_batch_result(spark, tmp_path):
    texts = [(i, at(i), f"Mr Ong number {i} met Zed at u{i}@mail.example.com", "x") for i in range(30)]
    found = [(i, 18 + len(str(i)) , 21 + len(str(i)), "Z", 0.5, at(i + 1 + i % 3)) for i in range(30) if i % 3] + [(i, 0, 3, None, 0.5, at(i)) for i in range(0, 30, 2)]
    redacted, rejects = run(spark, tmp_path, [texts[:10], texts[10:20], texts[20:]], [found[:8], found[8:20], found[20:]])
    docs, spans = spark.createDataFrame(texts, DOCS), spark.createDataFrame(found, SPANS)
    want = {r.doc_id: r.redacted_text for r in redact_documents(docs, ner_spans=spans).collect()}
    assert {r.doc_id: r.redacted_text for r in redacted} == want and len(redacted) == 30
    assert any("Z#1" in t for t in want.values()) and rejects == []


def test_late_and_missing_spans(spark, tmp_path):
    docs = [[(1, at(0), "Zed came", "x"), (2, at(0), "Zed went", "x"), (3, at(1), "Zed sat", "x"), (4, at(2), None, "x")]]
    spans = [[(1, 0, 3, "Z", 0.5, at(10)), (2, 0, 3, "Z", 0.5, at(11)), (9, 0, 3, "Z", 0.5, at(1)), (3, 0, 3, "Z", 0.5, at(0)), (4, 0, 1, "Z", 0.5, at(3))]]
    redacted, rejects = run(spark, tmp_path, docs, spans)
    assert {r.doc_id: r.redacted_text for r in redacted} == {1: "***[Z#1]*** came", 2: "Zed went", 3: "Zed sat", 4: None}
    # found too late, before the document, and for none
    assert sorted(r.doc_id for r in rejects) == [2, 3, 9]


def test_query_runs_by_period_with_bounded_state(spark, tmp_path, monkeypatch):
    n = 400
    orders = [(i, i % 17, datetime(2024, 1, 1 + i % 28)) for i in range(1, n + 1)] + [(7, 3, START), (None, 1, START)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(registered, "PERIOD_ROWS", 100)
    most, runs = [], []

    def started(*args, **kw):
        both = start_joined_sink(*args, **kw)
        runs.append(1)
        for q in both:
            q.awaitTermination()
            most.extend(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"])
        return both

    monkeypatch.setattr(registered, "start_joined_sink", started)
    got = {(r.doc_id, r.redacted_text) for r in registered.redact_span_stream(spark, str(tmp_path)).collect()}
    want = {(r.doc_id, r.redacted_text) for r in registered.redact_text(spark, str(tmp_path)).filter("doc_id <> 7").collect() if r.doc_id is not None}
    assert want == {x for x in got if x[0] != 7} and len(want) == n - 1
    # a run before took all notes with their spans at once
    assert len(runs) >= 4 and max(most) < 2 * n


def test_query_keeps_few_state_stores_and_batches(spark, tmp_path, monkeypatch):
    orders = [(i, i % 17, datetime(2024, 1, 1 + i % 28)) for i in range(1, 301)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(registered, "PERIOD_ROWS", 100)
    runs = []

    def started(*args, **kw):
        both = start_joined_sink(*args, **kw)
        for q in both:
            q.awaitTermination()
            runs.append([{o["numShufflePartitions"] for o in p["stateOperators"]} for p in q.recentProgress])
        return both

    monkeypatch.setattr(registered, "start_joined_sink", started)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {(r.doc_id, r.redacted_text) for r in registered.redact_span_stream(spark, str(tmp_path)).collect()}
        assert spark.conf.get("spark.sql.shuffle.partitions") == "23"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = {(r.doc_id, r.redacted_text) for r in registered.redact_text(spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 300
    # before, state was dealt to all 23, and each period took a second batch for what the watermark let go
    assert {n for run in runs for batch in run for n in batch} == {spark.sparkContext.defaultParallelism}
    assert len(runs) == 6 and all(len(run) == 1 for run in runs[:4])
