import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import near_dedup
from maskwright.llm.components import components
from maskwright.llm.near_dedup import Rule
from tests.llm import messy

UPPER = {i: i + 32 for i in range(65, 91)}


def sets_of(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, rule):
    sets = [sets_of(t, rule.width) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= rule.percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = d if d is None else min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least[find(i)], d is None or least[find(i)] == d) for i, (d, _) in enumerate(rows)), key=str)


def found(spark, rows, rule):
    out = near_dedup.dedup(messy.documents(spark, rows), rule).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out), key=str)


def variants(rng, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        yield " ".join(w)


def group_rows(seed, groups, size, edits, length=80):
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(length + g % 7)]
        texts += variants(rng, base, size, edits)
    texts += ["a common passage of words " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(12)) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("rule", [Rule(3, 85), Rule(5, 80)])
def test_components_against_all_pairs(spark, rule):
    rows = group_rows(1, 30, 8, 5)
    assert found(spark, rows, rule) == brute(rows, rule)


def test_large_groups_in_small_nodes(spark, monkeypatch):
    """Groups far beyond the limit of a node, with members that reach each other through few links only."""
    monkeypatch.setattr(near_dedup, "LIMIT", 12)
    rows = group_rows(2, 3, 130, 4)
    assert found(spark, rows, Rule(3, 85)) == brute(rows, Rule(3, 85))


def test_nodes_that_stay_large_are_done_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LIMIT", 6)
    monkeypatch.setattr(near_dedup, "DEPTH", 1)
    rows = group_rows(3, 2, 60, 6, 60)
    assert found(spark, rows, Rule(3, 85)) == brute(rows, Rule(3, 85))


def test_messy_tables(spark):
    assert found(spark, messy.TEXTS, Rule(3, 85)) == brute(messy.TEXTS, Rule(3, 85))
    assert found(spark, [], Rule()) == [] and found(spark, [(1, None), (2, "")], Rule()) == [(1, 0, 1, True), (2, 0, 2, True)]
    docs = messy.documents(spark)
    kept = near_dedup.kept_documents(docs, Rule(3, 85))
    assert kept.columns == docs.columns
    # the two equal rows leave one, 6 goes with 1, 10 is near 5
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "2", "3", "4", "5", "7", "8", "9", "11", "12", "None", "None"])


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    names = rng.sample(range(10**9), 600)
    edges = [(names[i], names[i + 1]) for i in range(299)] + [(names[300], names[i]) for i in range(301, 500)] + [(names[500], names[500])]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    assert len({got[names[i]] for i in range(300)}) == 1 and len({got[names[i]] for i in range(300, 500)}) == 1 and len(set(got.values())) == 2
    assert components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for s in (0.5, 0.85, 0.95):
        near = []
        for _ in range(40):
            pool = rng.integers(0, 2**63, 1000).astype(np.uint64)
            cut = int(1000 * (1 - s) / 2)
            a, b = near_dedup.signatures([pool[: 1000 - cut], pool[cut:]])
            near.append((a == b).mean())
        assert abs(np.mean(near) - s) < 0.03
