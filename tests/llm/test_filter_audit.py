import random
import re
from collections import defaultdict
from itertools import permutations

import pytest
from tests.llm import messy

from maskwright.llm import filter_audit

LABELS = "doc_id bigint, quality int, toxic int, part string, mask int, n int"


def flags(rows):
    """A plain reading of the contract: (part, id, text, failed letters) per row."""
    out = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * any(i is not None and j is not None and j < i and (other or "") == text for j, other, _ in rows)
        out.append((lang or "", i, fails))
    return out


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out, shapley = defaultdict(lambda: [0] * 6), defaultdict(int)
    for part, i, fails in flags(rows):
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                early = any(b in fails for b in order[:k])
                gone = f in fails and not early
                row = out[part, order, k + 1]
                for c, hit in enumerate([f not in fails and not early, gone, f in fails and early, fails == f, gone and i in good, gone and i in toxic]):
                    row[c] += hit
                shapley[part, f] += gone
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def table(spark, rows):
    full = [(i, t, lang, "s", None, *messy.EXTRA) for i, t, lang in rows]
    return spark.createDataFrame(full, messy.SCHEMA).repartition(3)


def result(spark, rows, labels, **more):
    counts = filter_audit.outcomes(table(spark, rows), spark.createDataFrame([(*r, "p", 1, 2) for r in labels], LABELS), **more)
    out = filter_audit.replayed(counts)
    assert [f.name for f in out.schema][:3] == ["part", "filter_order", "step"]
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()}


def random_rows(seed):
    rng = random.Random(seed)
    vocabulary = ["Aa", "bb", "cc|", "dé", "E", "f\x00", "f", "ffffffffg", "ffffffffh", "日本", "x" * 300, "x" * 299 + "y"]
    texts = [None, "", " \n ", "\x85\xa0"] + [
        "".join(rng.choice(vocabulary[: rng.randint(1, 12)]) + rng.choice([" ", "\n", "  ", "\t\r"]) for _ in range(rng.choice([0, 3, 150, 199, 200, 201, 400])))
        for _ in range(25)
    ]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(120)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(50)]
    return rows, labels


# 3 bits: nearly all words share their id with others
@pytest.mark.parametrize(("seed", "bits"), [(1, filter_audit.BITS), (2, 3)])
def test_all_orders_against_a_plain_replay(spark, seed, bits):
    rows, labels = random_rows(seed)
    assert result(spark, rows, labels, bits=bits) == brute(rows, labels)


def test_messy_and_empty_tables(spark):
    rows = [(i, t, None if k % 3 else "en") for k, (i, t) in enumerate(messy.TEXTS)]
    assert result(spark, rows, [(1, 1, 0), (1, 0, 1)]) == brute(rows, [(1, 1, 0), (1, 0, 1)])
    assert result(spark, [], []) == {}


def test_dictionary_and_shards(spark):
    docs = table(spark, [(1, "a b a", "en"), (2, None, "en"), (3, "b c", None)])
    words = {r.word: (r.id, r.n) for r in filter_audit.dictionary(docs).collect()}
    assert {w: n for w, (_, n) in words.items()} == {"a": 2, "b": 2, "c": 1}
    cells = {}
    for r in filter_audit.csr_shards(docs, {}, ["doc_id"]).collect():
        for k, i in enumerate(r.doc_id):
            at = slice(r.indptr[k], r.indptr[k + 1])
            cells[i] = dict(zip(r.indices[at], r.counts[at], strict=True))
    assert cells == {1: {words["a"][0]: 2, words["b"][0]: 1}, 2: {}, 3: {words["b"][0]: 1, words["c"][0]: 1}}
