import random

import corpus_pipeline
from maskwright.llm import queries
from tests.llm import messy
from tests.llm.test_packing import packing


def rows(n=220):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(n)]
    out = []
    for i, t in enumerate(texts):
        if i % 4 == 0:
            t += " scoundrel"
        if i % 10 == 3:
            t += f' token = "{rng.getrandbits(160):040x}" and so on'
        out.append((i, t))
    # an exact copy, a near copy and a repeated row
    out += [(1000, out[1][1]), (1001, out[2][1] + " more"), out[5]]
    return out + [(2000, None), (2001, ""), (None, "no id")]


def test_stages_take_effect(spark, tmp_path):
    docs = messy.documents(spark, rows())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(220)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, counts = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, kept, str(tmp_path)).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns
        counts[name] = {(r.doc_id, r.text) for r in kept.collect()}
    assert not any("scoundrel" in (t or "") for _, t in counts["toxicity"]) and len(counts["toxicity"]) == 170
    ids = [i for i, _ in counts["near_duplicates"]]
    assert {1000, 1001} & set(ids) == set() and len(ids) == 168 and {2000, 2001, None} <= set(ids)
    secret = [t for _, t in counts["secret_scan"] if "token" in (t or "")]
    assert secret and all("[SECRET]" in t for t in secret)
    assert {i for i, _ in counts["mix_sources"]} == {i for i, _ in counts["secret_scan"]}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(ids)
    assert all(r.length <= packing.LENGTH for r in pieces)


def test_all_operators_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == ["pipeline", *[f"op{i}" for i in range(1, 14)]]
    assert set(queries.oracle_sql()) <= set(names) and corpus_pipeline.ORACLE_SQL is None
