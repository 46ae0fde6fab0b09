import random

from pyspark.sql import functions as F

from maskwright import default_catalog, redact_documents
from maskwright.operators import adjudicate, detect, redact
from maskwright.plans.redaction import find
from maskwright.sources.spans import attach_spans
from tests import model

CATALOG = default_catalog()
FRAGMENTS = [
    "Dr. Alice Tan", " and ", "Mr Ong", "Zoé", "é", "😀", "\u0001", "²", "é", "NRIC: ", "nric is ", "S1234567A", "T7654321Z",
    "E1234567X", "bob@mail.example.com", " ", "  ", "\n", ", ", ". ", "'", "-", "+65 91234567", "81234567", "123-456-7890-1",
    "1234567890", "2024-01-31", "Ref: AB-12", "Order #A1", "12 Orchard Road, Singapore 123456", "CVC of 123", "cvc", "Security Code of 9999",
    "Big Corp Pte Ltd", "Payment to Lim Solutions", "İstanbul", "account no. ", "e-mail", "reference code ", "x_1", "and", "van", "O'Neil Brown", "Ⅷ", "\x1c",
]
LABELS = ["PERSON", "per", "GPE", "LOC", "ORG", "CARDINAL", "EMAIL", "ADDRESS_LINE", "misc"]


def documents(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "".join(rng.choice(FRAGMENTS) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 30)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 5))))
        ner = [(a, b, rng.choice(LABELS)) for a, b in zip(cuts[::2], cuts[1::2])]
        rows.append((i, text, ner))
    return rows


def test_detection_adjudication_and_rendering_match_the_model(spark):
    rows = documents(1500, 7)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").repartition(4)
    spans = spark.createDataFrame(
        [(i, s, e, lab, 0.5) for i, _, ner in rows for s, e, lab in ner], "doc_id bigint, start int, end int, label string, score double"
    )
    found = find(attach_spans(docs, spans), CATALOG, ner="ner")
    out = redact.respond(redact.mark(found, CATALOG)).select("doc_id", "spans", "final", "redacted_text", "map")
    got = {r.doc_id: r for r in out.collect()}
    for i, text, ner in rows:
        row, cand = got[i], model.candidates(text, CATALOG, ner)
        assert sorted((s.start, s.end, s.label, s.specificity) for s in row.spans) == sorted(cand), text
        assert all(s.text == text[s.start:s.end] for s in row.spans), text
        final = model.adjudicated(text, cand)
        assert [(s.start, s.end, s.label, s.specificity) for s in row.final] == final, text
        want, vault = model.rendered(text, final, CATALOG)
        assert (row.redacted_text, row.map) == (want, vault), text


def test_long_documents_with_many_spans(spark):
    text = " ".join(f"u{i}@mail.example.com nric S{i:07d}A" for i in range(1200))
    row = redact_documents(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    cand = model.candidates(text, CATALOG)
    assert row.redacted_text == model.rendered(text, model.adjudicated(text, cand), CATALOG)[0]
    assert len(row.entities) == 2400


def test_plan_has_no_shuffle_and_no_python(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a@b.example.com").alias("text"))
    plan = redact_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_worked_example(spark):
    docs = spark.createDataFrame([(1, "Contact me at alice@example.com, nric s1234567a"), (2, "plain"), (3, "😀 Mr Ong")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in redact_documents(docs).collect()}
    assert rows[1].redacted_text == "Contact me at ***[EMAIL#1]***, nric s1234567a"
    assert rows[1].entities[0].value_preview == "alice@exam..." and rows[1].entities[0].confidence is None
    assert rows[2].redacted_text == "plain" and rows[2].entities == [] and rows[2].map == {}
    assert rows[3].redacted_text == "😀 ***[PERSON#1]***"


def test_window_is_cut_before_matching(spark):
    text = "cvc 123456 and more cvc of 1234567 account no 123456789012345678"
    spans = spark.createDataFrame([(text,)], "text string").select(detect.context_spans("text", CATALOG.keys).alias("s")).first().s
    assert sorted((s.start, s.end, s.label, s.specificity) for s in spans) == sorted(
        c for c in model.candidates(text, CATALOG) if c[3] == 85
    )


def test_false_positive_first_defeats_others(spark):
    docs = spark.createDataFrame([(1, "NRIC\n x", [(0, 5, "ORG", 0.1), (0, 3, "PERSON", 0.1)])],
                                 "doc_id bigint, text string, ner array<struct<start:int,end:int,label:string,score:double>>")
    found = adjudicate.adjudicate(docs.select("text", detect.recogniser_spans(F.col("text"), F.col("ner"), CATALOG).alias("spans")))
    assert found.first().final == []


def test_reveal_and_size_class(spark):
    docs = spark.createDataFrame([(1, "mail bob.the.builder.of.houses@construction.example.com")], "doc_id bigint, text string")
    out = redact_documents(docs)
    entities = redact.entity_rows(out, "doc_id")
    assert redact.reveal(entities, redact.vault_rows(out, "doc_id")).first().shown == "bob.the.builder.of.houses@constr…"
    assert redact.reveal(entities, redact.vault_rows(out, "doc_id").limit(0)).first().shown == "bob.the.bu..."
    sizes = spark.createDataFrame([("a" * 9000,), ("a" * 9001,), ("😀" * 5001,)], "t string").select(redact.size_class(F.col("t")).alias("c"))
    assert [r.c for r in sizes.collect()] == ["ok", "near-limit", "over-limit"]


EDGE_TEXTS = [
    "Contact: john.doe@example.com", "Masked email j***@example.com", "Call +1-202-555-0199 now", "Masked phone +1 (202) ***-****",
    "Card 4242 4242 4242 4242", "SSN 078-05-1120", "IBAN GB82 WEST 1234 5698 7654 32", "Visit https://example.com today", "Ping me @handle",
    "Date 2024-09-01 and 01/09/2024", "Plate ABC-1234", "Initials J.D.", "ID A1234567 and 123456789", "Address 97 Lincoln Street, Springfield, IL 62704",
    "ACCT-0098776 open", "employee ID # 11207", "IP 192.168.0.101", "Main line (202) 555-0000 ext. 4521",
    "Reach me at john (dot) doe (at) example (dot) co (dot) uk", "Server IP 10.0.0.1 not a phone 10.0.0.1", "Address 221B Baker Street, London",
    "Duplicate email a@b.com and a@b.com",
]
KEYED = {
    "Her ic number is S1234567A": "NRIC_SG", "passport no E1234567X": "PASSPORT_ID", "passport: E7654321": "PASSPORT_ID",
    "handphone no 91234567": "PHONE_SG", "acct no 123456789012345": "BANK_ACCOUNT_SG",
}


def test_edge_texts_and_rare_keywords(spark):
    texts = [*EDGE_TEXTS, *KEYED]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in redact_documents(docs).collect()}
    for i, text in enumerate(texts):
        want, vault = model.rendered(text, model.adjudicated(text, model.candidates(text, CATALOG)), CATALOG)
        assert (got[i].redacted_text, got[i].map) == (want, vault), text
    assert got[0].redacted_text == "Contact: ***[EMAIL#1]***" and got[5].redacted_text == "SSN 078-05-1120"
    assert got[21].redacted_text == "Duplicate email ***[EMAIL#1]*** and ***[EMAIL#2]***"
    found = {t: [s[2] for s in model.candidates(t, CATALOG) if s[3] == 85] for t in KEYED}
    assert all(label in found[t] for t, label in KEYED.items())
    assert all(got[len(EDGE_TEXTS) + i].entities[0].type == label for i, label in enumerate(KEYED.values()))


def test_filters_do_not_repeat_detection(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a@b.example.com").alias("text"))
    out = redact_documents(docs)
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("[STFG]")
    plain = count(out.select("redacted_text"))
    for df in (out.filter(F.size("entities") > 0), out.filter("redacted_text <> text").select("doc_id", "entities"), out.groupBy("redacted_text").count()):
        assert count(df) == plain


def test_streamed_tables_hold_the_values(spark, tmp_path):
    from maskwright.streaming.redact_stream import start_table_sink

    docs = spark.createDataFrame([(1, "mail bob@mail.example.com"), (2, "plain")], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    start_table_sink(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    read = {t: spark.read.parquet(f"{tmp_path}/out/{t}").drop("batch_id").collect() for t in ("redacted", "entities", "vault")}
    assert sorted((r.doc_id, r.redacted_text) for r in read["redacted"]) == [(1, "mail ***[EMAIL#1]***"), (2, "plain")]
    assert [(r.doc_id, r.type) for r in read["entities"]] == [(1, "EMAIL")] and read["vault"][0].original == "bob@mail.example.com"
