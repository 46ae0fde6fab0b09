import hashlib

from maskwright.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string, segments int, formatted string, valid string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", "v") for r in rows], TURNS).repartition(3)


def test_round_trip_of_hard_texts(spark):
    hard = ["", None, "\\", "\\h\\t\\b", "####", "</turn>\n", "</turn</turn>>", "### Assistant:\n", "a\\</turn> ### b", "x" * 200_000]
    rows = [(i, t, r, x) for i, x in enumerate(hard) for t, r in enumerate(["system", "user", "assistant"])]
    rows += [(50, 0, None, "n"), (50, 0, "a:\n b", "odd role"), (50, 0, "a:\n b", "odd role"), (50, None, "User", "as a name"), (None, 1, "user", "no id")]
    out = chat.format_conversations(table(spark, rows))
    got = {r.conv_id: r for r in out.select("conv_id", chat.read_turns(out.formatted).alias("t"), chat.loss_text(out.segments).alias("loss"), "valid", "fault").collect()}
    for i, x in enumerate(hard):
        assert [tuple(t) for t in got[i].t] == [(r, x or "") for r in ("system", "user", "assistant")]
        assert got[i].loss == (x or "") and got[i].valid and got[i].fault is None
    assert sorted(tuple(t) for t in got[50].t) == sorted([("", "n"), ("a:\n b", "odd role"), ("a:\n b", "odd role"), ("User", "as a name")])
    assert not got[50].valid and got[50].fault == 0 and got[None].fault == 1


def test_the_machine(spark):
    orders = {1: "ua", 2: "sua", 3: "uaua", 4: "u", 5: "a", 6: "uau", 7: "suua", 8: "usa"}
    names = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(i, t, names[c], "x") for i, o in orders.items() for t, c in enumerate(o)]
    faults = {r.conv_id: r.fault for r in chat.format_conversations(table(spark, rows)).collect()}
    assert faults == {1: None, 2: None, 3: None, 4: 1, 5: 0, 6: 3, 7: 2, 8: 1}


def test_digests_and_native_plan(spark):
    out = chat.digests(chat.format_conversations(chat.with_probe(table(spark, []))))
    row = out.collect()[0]
    said = "\\### Assistant: </turn> ok"
    both = f"user\n{said}\nassistant\n{said}\n"
    assert (row.conv_id, row.n_turns, row.loss_chars, row.valid) == (-7, 2, len(said), True)
    assert row.turns_sha256 == hashlib.sha256(both.encode()).hexdigest() and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
