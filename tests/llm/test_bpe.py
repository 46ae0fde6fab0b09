import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from tests.llm import messy

from maskwright.llm import bpe, words

PATH = bpe.rank_path()


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(v, texts, size=bpe.CHUNK):
    out = []
    for _, n, data, offsets in words.chunks(pa.array(texts, pa.string()), size):
        ids, at = bpe.encode_chunk(v, data, offsets)
        out += [ids[at[i] : at[i + 1]].tolist() for i in range(n)]
    return out


def hard_texts(seed, n):
    rng = random.Random(seed)
    letters = "abcdeilnorstuv'' \n\t.,sStTrRevmlldD0123éüß中日हिन्दी\U0001f600 \u0085 \x1cİ٠²́\x00 "
    return ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 20, 60]))) for _ in range(n)]


def test_equals_the_library(vocabulary, library):
    texts = hard_texts(1, 4000) + ["a" * n for n in range(1, 140)] + [" " * n + "x" for n in range(70)] + ["\n" * n for n in range(70)]
    texts += ["aaabab" * 400, messy.LONG, "x" * 30_000, "é" * 500 + "中" * 500, "don't we'll they've I'd 'tis ''s 's's 'S"]
    assert encode(vocabulary, texts) == library.encode_ordinary_batch(texts) == encode(vocabulary, texts, 100)


def test_every_code_point_in_context(vocabulary, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}a {c}'s1{c}1\n{c} " for c in points[i : i + 400]) for i in range(0, len(points), 400)]
    assert encode(vocabulary, texts) == library.encode_ordinary_batch(texts)


def test_false_hashes_change_nothing(vocabulary, library, monkeypatch):
    # all bytes of one kind, and a base that forgets the order: many spans share their hash
    monkeypatch.setattr(words, "BYTE", words.BYTE % np.uint64(97))
    monkeypatch.setattr(words, "BASE", 1)
    monkeypatch.setattr(words, "INVERSE", 1)
    texts = hard_texts(2, 300)
    assert encode(bpe.Vocabulary.load(PATH), texts) == library.encode_ordinary_batch(texts)


def library_of(ranks):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_vocabularies_with_other_ties():
    rng = random.Random(3)
    for _ in range(30):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 285:
            ids = library_of(ranks).encode_ordinary("".join(rng.choice("aab") for _ in range(60)))
            k = rng.randrange(len(ids) - 1) if len(ids) > 1 else 0
            token = {r: t for t, r in ranks.items()}
            ranks.setdefault(b"".join(token[i] for i in ids[k : k + 2]), len(ranks))
        texts = ["".join(rng.choice("aabb ") for _ in range(rng.randint(0, 90))) for _ in range(100)]
        assert encode(bpe.Vocabulary.of(ranks), texts) == library_of(ranks).encode_ordinary_batch(texts)


def test_faulty_vocabularies():
    base = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Vocabulary.of({k: v for k, v in base.items() if k != b"a"})
    with pytest.raises(ValueError, match="twice"):
        bpe.Vocabulary.of(base | {b"ab": 7})
    with pytest.raises(ValueError, match="later"):
        bpe.Vocabulary.of(base | {b"abc": 256, b"bc": 257})
    # no merges lead to abc, but the library knows it as a whole
    v = bpe.Vocabulary.of(base | {b"abc": 256})
    assert encode(v, ["abc", "abca", "xabc"]) == [[256], [97, 98, 99, 97], [120, 97, 98, 99]]


def test_appends_and_edits(vocabulary, library):
    rng = random.Random(4)
    for text in hard_texts(5, 40) + ["it's 'r", "a   ", "x" * 400]:
        held = bpe.Encoded(vocabulary, text)
        for _ in range(12):
            start = rng.randint(0, len(text))
            end = rng.choice([start, min(len(text), start + rng.randint(0, 9)), len(text)])
            new = rng.choice(["", "e", " ", "'", "'s", "ve x", "\n\n", *hard_texts(rng.random(), 2)])
            if rng.random() < 0.3:
                start = end = len(text)
            held.replace(start, end, new)
            text = text[:start] + new + text[end:]
            assert held.text == text and held.tokens() == library.encode_ordinary(text)


def test_an_append_keeps_the_table(vocabulary):
    held = bpe.Prefixes(vocabulary, b"internationalis")
    before = list(held.last)
    held.append(b"ierung")
    assert held.last[: len(before)] == before and held.last == bpe.Prefixes(vocabulary, b"internationalisierung").last


def test_query_on_messy_tables(spark, library):
    docs = messy.documents(spark)
    got = {}
    for r in bpe.digests(docs, PATH).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    want = {}
    for i, text in messy.TEXTS:
        ids = library.encode_ordinary(text or "")
        row = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        want.setdefault(i, []).append(row)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert bpe.digests(messy.none(spark), PATH).collect() == []
    kept = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert kept.columns == [c for c in docs.columns if c != "text"] + ["ids", "decoded"] and kept.count() == len(messy.TEXTS)
