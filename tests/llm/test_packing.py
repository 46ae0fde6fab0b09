import zlib
from collections import Counter

import numpy as np
import pytest

from maskwright.llm import packing
from tests.llm import messy


def whole(plan, histogram):
    """Every rest lies in pieces without gaps, and packs are filled from the start."""
    counted, packs = Counter(), [[] for _ in range(plan.packs)]
    for length, lo, hi, pieces in zip(plan.length, plan.lo, plan.hi, plan.pieces):
        counted[int(length)] += int(hi - lo)
        at = 0
        for start, size, first, offset in pieces:
            assert start == at and start % packing.GRID == 0
            at += size
            for r in range(hi - lo):
                packs[first + r].append((offset, size))
        assert at == length
    assert counted == Counter({k: v for k, v in histogram.items() if v})
    for p in packs:
        at = 0
        for offset, size in sorted(p):
            assert offset == at
            at += size
        assert 0 < at <= packing.LENGTH


@pytest.mark.parametrize("histogram", [
    {}, {5: 1}, {2047: 7, 1: 3}, {1500: 300, 1400: 10, 3: 5}, {1100: 3000}, {1: 5000}, {700: 10, 699: 11, 650: 1},
    dict(Counter(np.random.default_rng(0).integers(1, 2048, 5000).tolist())),
])
def test_plans(histogram):
    p = packing.plan(histogram)
    whole(p, histogram)
    tokens = sum(k * v for k, v in histogram.items())
    assert p.packs <= tokens / packing.LENGTH * 1.02 + 1


def test_ids_are_the_tokenizers(spark):
    ids = packing.ids_for(packing.tokenizer_path())
    texts = [t or "" for _, t in messy.TEXTS] + ["Σας ΌΣ İx", "I'll DON'T. ½ 12ab,", "x" * 5000, "a.\x1c.b", "word, word. Word; WORD!"]
    for text, got in zip(texts * 2, ids.of(texts * 2)):
        assert list(np.frombuffer(got, "<u4")) == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_every_code_point_and_mark():
    """Each code point after a letter, at a word's start and end, alone, before each mark, and after capitals."""
    ids = packing.ids_for(packing.tokenizer_path())
    texts = []
    for at in range(0, 0x110000, 256):
        points = [chr(c) for c in range(at, at + 256) if not 0xD800 <= c < 0xE000]
        texts.append(" | ".join(f"{c} {c}a a{c} a{c}. " + " ".join(f"A{c}{m} {c}{m}" for m in ".,:;!?") for c in points))
    for text, got in zip(texts, ids.of(texts)):
        assert list(np.frombuffer(got, "<u4")) == ids.tokenizer.encode(text, add_special_tokens=False).ids, text[:20]


def test_random_texts_and_forgotten_words(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 300)
    monkeypatch.setattr(packing, "CHUNK", 5000)
    rng = np.random.default_rng(5)
    letters = list("abcTHWYJKSΣσİ.,:;!?'\x1c\x1f \n\t\u0331\u0308\u030a\u030c\u0307\u095c\u09dcé½12")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(10_000)]
    ids = packing.Ids(packing.tokenizer_path())
    want = ids.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for text, got, w in zip(texts, ids.of(texts), want):
        assert list(np.frombuffer(got, "<u4")) == w.ids, text
    assert len(ids.known) <= 300 + 5000


def test_other_tokenizers_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError, match="packing needs"):
        packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))


def test_check_sums_of_cuts():
    rng = np.random.default_rng(1)
    for a, b in ((32, 5), (64, 2000), (1, 1), (2016, 32)):
        x, y = rng.integers(0, 50_000, a).astype("<u4").tobytes(), rng.integers(0, 50_000, b).astype("<u4").tobytes()
        assert packing.between(zlib.crc32(x), zlib.crc32(x + y), b) == zlib.crc32(y)


def test_every_id_lies_in_one_piece(spark, monkeypatch):
    texts = messy.TEXTS + [(100 + i, "lorem ipsum dolor " * (1 + i * 37 % 900)) for i in range(60)]
    docs = messy.documents(spark, texts)
    rows = packing.packed(docs, packing.tokenizer_path()).collect()
    tokenizer = packing.ids_for(packing.tokenizer_path()).tokenizer
    want = Counter()
    for i, t in texts:
        want[(i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END]))] += 1
    # pieces of one row share doc_id and number of ids
    sequences = {}
    for r in rows:
        assert any(
            k[0] == r.doc_id and len(k[1]) == r.doc_tokens and zlib.crc32(np.array(k[1][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
            for k in want
        )
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(k[1]) * n for k, n in want.items())
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert len(sequences) <= sum(r.length for r in rows) / packing.LENGTH + 2
    assert packing.packed(messy.none(spark), packing.tokenizer_path()).count() == 0


def test_runs_of_marks_and_latin_words_take_no_pipeline(monkeypatch):
    ids = packing.Ids(packing.tokenizer_path())
    asked, made = [], ids._made
    monkeypatch.setattr(ids, "_made", lambda new: (asked.extend(new), made(new))[1])
    texts = ["abc### né: Zoé%% lé,%%% ÉÇé", "a<|endoftext|> é÷ xİ", "." * 40 + "a" + "." * 40, "é.É# ÀB c'est&&& don's$", "x" + "#!" * 6]
    got = [np.frombuffer(b, "<u4").tolist() for b in ids.of(texts)]
    assert got == [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    # words of Latin letters, and of a-z with marks behind, are read without the normalizer
    assert not {w for w in asked if w.decode().isalpha() and w.decode().lower() in ("né", "zoé", "lé", "éçé", "àb")}
    assert b"abc###" not in asked and b"###" in asked


def test_words_of_letters_are_merged_at_once(monkeypatch):
    ids = packing.Ids(packing.tokenizer_path())
    singly, bare = [], ids._bare
    monkeypatch.setattr(ids, "_bare", lambda word: (singly.append(word), bare(word))[1])
    rng = np.random.default_rng(7)
    letters = list("aaaeeinostthrlzzABéÀßÿÞœ")
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(50)) for _ in range(200)]
    texts += ["a" * n + " " + "ss" * n + " b" + "an" * n for n in range(1, 40)] + ["", "x", "É", "ab" * 200 + " cd"]
    got = [np.frombuffer(b, "<u4").tolist() for b in ids.of(texts)]
    assert got == [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    # long words only, whose merges are done one by one
    assert all(len(w) > packing.WORD for w in singly)


def test_vocabularies_without_ordered_merges_are_read_word_by_word(monkeypatch):
    monkeypatch.setattr(packing.Merges, "of", classmethod(lambda cls, tokenizer: None))
    ids = packing.Ids(packing.tokenizer_path())
    texts = ["Some plain words, Zoé's ÉÇé a" + "b" * 100, "", "###"]
    assert [np.frombuffer(b, "<u4").tolist() for b in ids.of(texts)] == [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
