import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from maskwright.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place int, dropped int, audit string, fault string, _case int"
BLANK = " \t\n\x0b\x0c\r"


def cheapest(key, gone):
    """All ways through the grammar's states, turn by turn: (cost, audit) of the best one."""
    ways = {"none": (0, "")}

    def keep(into, state, way):
        if state not in into or way < into[state]:
            into[state] = way

    def inserted(ways):
        for _ in range(3):
            more = dict(ways)
            for state, (cost, audit) in ways.items():
                keep(more, "assistant" if state == "user" else "user", (cost + 5, audit + "I"))
            ways = more
        return ways

    letters = iter(key)
    for g in gone:
        after, c = {}, None if g else next(letters)
        for state, (cost, audit) in inserted(ways).items():
            keep(after, state, (cost + 2, audit + "D"))
            if not g:
                due, more = ("a" if state == "user" else "u"), 5 * c.isupper()
                edit = (cost + more, audit + "K") if c.lower() == due else (cost + more + 1, audit + "R")
                keep(after, "assistant" if state == "user" else "user", edit)
                if state == "none" and c.lower() == "s":
                    keep(after, "system", (cost + more, audit + "K"))
        ways = after
    # a way that ends after "user" lacks the assistant
    return min(way for state, way in inserted(ways).items() if state in ("none", "assistant"))


def random_key(rng):
    if rng.random() < 0.5:
        return "".join(rng.choice("ssuuuuaaaaxSUAX") for _ in range(rng.randint(0, 12)))
    out = ""
    for _ in range(rng.randint(1, 4)):
        run = ("ua" * 30)[rng.randint(0, 1) :]
        out += run[: rng.randint(0, 40)] + "".join(rng.choice("suaxUAu") for _ in range(rng.choice([0, 1, 1, 2, 5])))
    return out


@pytest.mark.parametrize("cells", [repair.CELLS, 40])
def test_cost_and_audit_against_all_ways(monkeypatch, cells):
    monkeypatch.setattr(repair, "CELLS", cells)
    repair._short.cache_clear()
    rng = random.Random(cells)
    for _ in range(1200):
        key = random_key(rng)
        gone = [g for _ in key for g in [*[True] * (rng.random() < 0.1), False]] + [True] * (rng.random() < 0.2)
        assert repair.repair(key, np.array(gone, bool)) == cheapest(key, gone), (key, gone)


def test_long_conversations_are_cut(monkeypatch):
    rng = random.Random(9)
    key = "".join("ua" * rng.randint(3, 40) + rng.choice(["u", "a", "x", "U", "s", "uu"]) for _ in range(400))
    assert max(map(len, repair.pieces(key))) < 400 and "".join(repair.pieces(key)) == key
    assert repair.repair(key, np.zeros(len(key), bool)) == cheapest(key, [False] * len(key))
    bare = "".join(rng.choice("ua") for _ in range(2000))
    assert repair.repair(bare, np.zeros(2000, bool)) == cheapest(bare, [False] * 2000)


def plain(rows):
    """The contract, read row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if fate:
                row = (turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
                turns += [row] * (1 + (fate == 3))
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in turns:
            body = text.rstrip(BLANK)
            faults.append("B" if not body else "D" if (role, text) in seen else "T" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in turns]
        key = "".join((c if c and c in "sua" else "x") if f != "T" else (c if c and c in "sua" else "x").upper() for c, f in zip(initials, faults, strict=True) if f not in ("B", "D"))
        cost, audit = cheapest(key, [f in ("B", "D") for f in faults])
        lines, left = [], iter(turns)
        opened = 0
        for e in audit:
            role, text = (None, "") if e == "I" else next(left)[1:]
            if e == "D":
                continue
            if not lines:
                opened = e == "K" and role[:1] == "s"
            lines.append((role if e == "K" else ["user", "assistant"][(len(lines) - opened) % 2]) + ":" + text)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        counts = (gaps, *(faults.count(f) for f in "BDT"), illegal, cost, audit)
        out[conv] = (*counts, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(spark, rows):
    table = spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in rows], SCHEMA).repartition(3)
    out = repair.mended(repair.damaged(table)).collect()
    assert len(out) == len({r.conv_id for r in out})
    return {r.conv_id: tuple(r)[1:] for r in out}


def test_whole_tables_against_a_plain_reading(spark):
    rng = random.Random(11)
    roles = ["system", "user", "user", "user", "assistant", "assistant", "assistant", None, "", "usher", "User", "tool"]
    texts = ["Yes.", "No!", "Why? \n", "cut off", None, "", " \t", "é.", "a\x85", "😀?", ". . .", "x" * 50_000 + ".", "\\n:\n."]
    rows = []
    for conv in [None, *range(60)]:
        for t in range(rng.choice([1, 2, 5, 9, 40])):
            good = rng.random() < 0.6
            role = ["user", "assistant"][t % 2] if good else rng.choice(roles)
            rows.append((conv, rng.choice([t, t, t, t, None, 3, -(1 << 40)]), role, f"{t}." if good else rng.choice(texts)))
    rows += rows[:7]
    assert result(spark, rows) == plain(rows)


def test_one_long_conversation_and_an_empty_table(spark):
    rng = random.Random(12)
    rows = [(7, t, ["user", "assistant"][t % 2] if rng.random() < 0.9 else "user", f"text {t % 4000}{rng.choice('..?!,')}") for t in range(30_000)]
    rows += [(conv, 0, "user", "alone.") for conv in range(20, 24)]
    assert result(spark, rows) == plain(rows)
    assert result(spark, []) == {}


def test_repaired_turns(spark):
    turns = [(1, 0, "system", "S."), (1, 1, "user", "A."), (1, 2, "user", "B."), (1, 3, "assistant", "C."), (2, 0, "assistant", "D."), (3, 0, "user", "")]
    table = spark.createDataFrame([(*r, False) for r in turns], "conv_id bigint, turn bigint, role string, text string, dropped boolean")
    rows = repair.numbered(table)
    decided = repair.audits(rows)
    assert {r.conv_id: (r.cost, r.audit) for r in decided.collect()} == {1: (2, "KDKK"), 2: (2, "D"), 3: (2, "D")}
    out = repair.repaired(rows, decided).collect()
    assert [tuple(r) for r in out] == [(1, 1, "K", "system", "S."), (1, 2, "K", "user", "B."), (1, 3, "K", "assistant", "C.")]
