import random
from types import SimpleNamespace

import pytest

from maskwright import default_catalog
from maskwright.operators import detect
from maskwright.sources.catalog import ContextKey
from tests import model



def key(i, text, label="L", pattern=r"\b\d+", window=6):
    return ContextKey(**{"ord": 100_000 + i, "key": text, "window": window, "label": label, "pattern": pattern})


def check(spark, texts, keys):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", detect.context_spans("text", keys).alias("s")).collect()
    catalog = SimpleNamespace(rules=[], keys=keys, synonyms={})
    for r in rows:
        assert sorted((s.start, s.end, s.label, s.specificity) for s in r.s) == sorted(model.candidates(texts[r.i], catalog)), texts[r.i]
        assert all(s.text == texts[r.i][s.start : s.end] for s in r.s)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlapping_keys(spark, seed):
    """Keys that begin with, hold, and overlap each other and themselves; the value may be anywhere in the window."""
    rng = random.Random(seed)
    letters = ["a", "b", " ", "é", "😀", "[", "^"] if seed > 1 else ["a", "b"]
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(25)}
    keys = [key(i, w, f"L{i % 3}", [r"\d+", r"[ab]\d", r"\b\d"][i % 3], rng.choice([1, 3, 8])) for i, w in enumerate(sorted(words))]
    # one key in two rules
    keys += [key(100 + i, k.key, "M", r"\d", 4) for i, k in enumerate(keys[:5])]
    texts = ["".join(rng.choice([*letters, "A", "B", "1", "2", "\u0001", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    check(spark, ["", *texts, "ab1 " * 2000], keys)


def test_keys_of_odd_letters(spark):
    odd = ["a.b", "a*", "$1", "\\d", "\\E", "(x", "-", "]", "[a-z]", "x^", "&&", "it's", "\"q\"", "K.D.", "n°", "i̇d"]
    check(spark, [f"{o} 12 {o.upper()}7 z{o}{o}8" for o in odd], [key(i, o) for i, o in enumerate(odd)])
    assert detect.context_spans("text", [key(0, "")]) is not None


def test_cost_does_not_grow_with_the_keys(spark):
    """The plan holds one pass over the text, for 22 keys as for 2,000."""
    few = default_catalog().keys
    many = [key(i, f"{a}{b} {c} no", few[i % 22].label, few[i % 22].pattern, 16) for i, (a, b, c) in enumerate((a, b, c) for a in "abcdefghijklm" for b in "nopqrstuvwxyz" for c in "abcdefghijkl")][:2000]
    frame = spark.createDataFrame([("kn a no 12, and ao b no 77 " * 3,)], "text string")
    for keys in (few, many):
        plan = frame.select(detect.context_spans("text", keys).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("contains(lambda low") + plan.count("Contains(lambda low") <= 1
    check(spark, ["kn a no 12, and ao b no 77 " * 3, "KN L NO 5"], many)
