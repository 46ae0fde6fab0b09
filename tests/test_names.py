import pytest

from maskwright import default_catalog, redact_documents
from maskwright.sources import fixed_values as fixed
from maskwright.sources import names as nm


def table(spark):
    lists = [(k, v, i) for i, (k, v) in enumerate(fixed.SYNONYMS.items())]
    return nm.invert(spark.createDataFrame(lists, "canonical string, names array<string>, pos int"))


def test_inverts_like_the_catalog(spark):
    assert {r.name: r.canonical for r in table(spark).collect()} == default_catalog().synonyms
    lists = spark.createDataFrame([("X", ["a", "b", None], 0), ("Y", ["B"], 1), ("Z", None, 2)], "canonical string, names array<string>, pos int")
    assert {r.name: r.canonical for r in nm.invert(lists).collect()} == {"A": "X", "B": "Y", "X": "X", "Y": "Y", "Z": "Z"}


@pytest.mark.parametrize("sent", [nm.SENT, 150, 2])
def test_three_ways_of_one_result(spark, monkeypatch, sent):
    monkeypatch.setattr(nm, "SENT", sent)
    many = spark.range(100_000).selectExpr("concat('NAME ', id) as name", "concat('C', id % 1000) as canonical")
    rows = [(i, f"name {i % 100}" if i % 3 else ["Unknown", None, "NAME 7"][i // 3 % 3]) for i in range(3000)]
    out = nm.canonical_rows(spark.createDataFrame(rows, "doc_id int, label string"), many)
    assert out.columns == ["doc_id", "label"]
    want = {i: None if x is None else f"C{int(x.split()[1]) % 1000}" if x.upper().startswith("NAME") else x.upper() for i, x in rows}
    assert {r.doc_id: r.label for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastExchange" in plan) or sent < 150
    assert "NestedLoop" not in plan and len(plan) < 20_000


def test_redaction_with_100_000_names(spark):
    many = spark.range(100_000).selectExpr("concat('KIND ', id) as name", "if(id % 2 = 0, 'PERSON', 'ignore') as canonical").unionByName(table(spark))
    many = many.unionByName(spark.createDataFrame([("SEEN", "gpe"), ("IGNORE TOO", "IGNORE")], "name string, canonical string")).dropDuplicates(["name"])
    docs = spark.createDataFrame([(1, "Zed and Kim saw Oslo at u@mail.example.com")], "doc_id bigint, text string")
    spans = spark.createDataFrame([(1, 0, 3, "kind 8", 0.5), (1, 8, 11, "Kind 9", 0.5), (1, 16, 20, "seen", 0.5)], "doc_id bigint, start int, end int, label string, score double")
    catalog = nm.catalog_for(default_catalog(), many, spans)
    assert len(catalog.synonyms) < 40 and catalog.synonyms["KIND 8"] == "PERSON"
    # the second mapping, of final labels, makes gpe a LOCATION
    assert redact_documents(docs, catalog, ner_spans=spans).first().redacted_text == "***[PERSON#1]*** and ***[IGNORE#1]*** saw ***[LOCATION#1]*** at ***[EMAIL#1]***".replace("***[IGNORE#1]***", "Kim")


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(nm, "LABELS", 5)
    many = spark.range(100).selectExpr("concat('N', id) as name", "'X' as canonical")
    with pytest.raises(ValueError, match="different labels"):
        nm.catalog_for(default_catalog(), many, many.selectExpr("name as label"))
