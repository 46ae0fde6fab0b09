"""Packing: shortest-pack-first over the histogram of lengths.

A document's ids, with an end id, are cut into full sequences and a rest. The
driver sees only the histogram of rests, LENGTH numbers. Rests are placed
longest first, each into the emptiest pattern that has room (many equal packs
are one pattern with a count), or into a new one. Then the emptiest packs are
taken apart, and their rests are cut to fill the gaps of the others. The
patterns are joined back to the documents by rank: the n-th rest of a length
takes the n-th place for that length.

Cuts lie on multiples of GRID ids, at which tokenizing notes check sums of the
rest; so ids are made once and never move. Ranks come from counts of (length,
block of documents) and positions within blocks, so no length's documents meet
in one task.

Defined cases: a null text is empty and has the end id only; repeated rows are
separate documents; documents of equal length rank by a hash, then by doc_id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm import words
from maskwright.sources.sinks import as_table

LENGTH, GRID, END = 2048, 32, 1
# documents that a rank block holds, about, and the fewest blocks a length has
BLOCK, BLOCKS = 1 << 16, 512
# bytes of text handled at a time; words whose ids a task remembers in each of two generations; the longest of them, and of those merged at once
CHUNK, REMEMBERED, WORD = 1 << 21, 150_000, 64
# White_Space of Unicode beyond ASCII, which the tokenizer splits at, in UTF-8
_WIDE = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
MARKS = b".,:;!?"
# further marks, where the tokenizer parts runs of them from letters, and the longest run that is parted
MORE, RUN = b"#$%&*()/+=~^", 8
# words of Latin letters to U+00FF in UTF-8: all in normal form, and of one small letter each
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
_SMALL = np.array([97 <= b <= 122 for b in range(256)])
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
# the second bytes of those letters beyond ASCII; below 0x9F they are capitals, 32 before the small ones
_SECOND = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])


def _spaced(data: np.ndarray) -> np.ndarray:
    """The bytes with all white space beyond ASCII as spaces."""
    if not (data > 127).any():
        return data
    out = data.copy()
    for lead in {w[0] for w in _WIDE}:
        at = np.flatnonzero(data == lead)
        for w in (w for w in _WIDE if w[0] == lead):
            hit = at[at <= len(data) - len(w)]
            for k in range(1, len(w)):
                hit = hit[data[hit + k] == w[k]]
            for k in range(len(w)):
                out[hit + k] = 0x20
    return out


def _byte_letters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


_BYTES = _byte_letters()

def _plain(data: np.ndarray) -> np.ndarray:
    """Spaced bytes with capitals A-Z as small letters, but for those before a byte beyond ASCII, which may join them in normal form."""
    data = _spaced(data)
    alone = np.append(data[1:] < 128, True)
    return np.where(alone, words.LOWER[data], data)


class Merges:
    """The merges of a byte-pair vocabulary with a suffix at word ends, done in many words at once: in each word its first merge, wherever it applies."""

    NONE = np.iinfo(np.int32).max
    BITS = 18

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        letters = [chr(_BYTES[b]) for b in range(256)]
        self.inner, self.final = np.array([vocabulary[c] for c in letters], np.int64), np.array([vocabulary[c + suffix] for c in letters], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.uint64)
        # open addressing; a free place holds a key that no pair has
        self.keys = np.full(1 << self.BITS, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(1 << self.BITS, self.NONE, np.int32)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._place(keys).tolist(), strict=True)):
            while self.ranks[at] != self.NONE:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.ranks[at] = key, rank

    @classmethod
    def of(cls, tokenizer) -> Merges | None:
        """None for a vocabulary of another kind, or where a merge's parts may be made after it."""
        model = json.loads(tokenizer.to_str())["model"]
        suffix, vocabulary = model.get("end_of_word_suffix"), model.get("vocab")
        if model["type"] != "BPE" or not suffix or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("dropout"):
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        known = {chr(c) + end for c in _BYTES.values() for end in ("", suffix)}
        if not known <= vocabulary.keys() or len(merges) > 1 << cls.BITS - 1:
            return None
        for a, b in merges:
            if a not in known or b not in known or a + b in known or a + b not in vocabulary:
                return None
            known.add(a + b)
        return cls(vocabulary, merges, suffix)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(words.BASE) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32 | right).astype(np.uint64)
        at = self._place(keys)
        out, found = self.ranks[at], self.keys[at]
        rest = np.flatnonzero((found != keys) & (out != self.NONE))
        out[found != keys] = self.NONE
        while len(rest):
            at[rest] = (at[rest] + 1) % len(self.keys)
            ranks, found = self.ranks[at[rest]], self.keys[at[rest]]
            same = found == keys[rest]
            out[rest[same]] = ranks[same]
            rest = rest[~same & (ranks != self.NONE)]
        return out

    def read(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of ``sizes`` bytes, none empty, one after the other, and where each word's ids end."""
        ids, last = self.inner[data], np.cumsum(sizes) - 1
        ids[last] = self.final[data[last]]
        ranks = np.full(len(ids), self.NONE, np.int32)
        ranks[:-1] = self._rank(ids[:-1], ids[1:])
        ranks[last] = self.NONE
        # finished words leave
        word, left, done = np.arange(len(sizes)), sizes, []
        while len(word):
            least = np.minimum.reduceat(ranks, np.cumsum(left) - left)
            busy = least != self.NONE
            if not busy.all():
                inside = np.repeat(busy, left)
                done.append((word[~busy], left[~busy], ids[~inside]))
                ids, ranks, word, left, least = ids[inside], ranks[inside], word[busy], left[busy], least[busy]
                if not len(word):
                    break
            hit = ranks == np.repeat(least, left)
            if (hit[1:] & hit[:-1]).any():
                # of pairs that overlap the first, third, ...
                opens = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
                at = np.flatnonzero(hit)
                hit[at[(at - opens[np.searchsorted(opens, at, "right") - 1]) % 2 == 1]] = False
            at = np.flatnonzero(hit)
            ids[at] = self.made[ranks[at]]
            # the end of a word passes to what it is merged into
            closes = np.zeros(len(ids), bool)
            closes[np.cumsum(left) - 1] = True
            closes[at] |= closes[at + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            left = left - np.add.reduceat(hit, np.cumsum(left) - left, dtype=np.int64)
            ids, ranks, closes, new = ids[keep], ranks[keep], closes[keep], at - np.arange(len(at))
            again = np.concatenate((new, new[new > 0] - 1))
            again = again[~closes[again]]
            ranks[new] = self.NONE
            ranks[again] = self._rank(ids[again], ids[again + 1])
        word, left, ids = (np.concatenate(c) for c in zip(*done, strict=True))
        order = np.argsort(word)
        ids, ends = words.gather(ids, (np.cumsum(left) - left)[order], left[order])
        return ids.astype("<u4"), ends[1:]


class Ids:
    """Ids of whole texts; a chunk's words are tokenized once each.

    Rests on what is checked when the tokenizer is loaded: it lower-cases, drops
    white space, joins nothing across it, reads a word of letters a-z as it stands, and parts such a letter from a mark after it. So
    a text's ids are those of its words in a row, and a word's last mark is a word. Words are found
    and told apart on the bytes of a chunk at once; each distinct one is looked up once. Where it is found to do so, it also
    parts runs of marks from letters, and words of Latin letters are read from their bytes as those of a-z are. The pairs of
    such words are merged in all words of a chunk at once; other words' ids are remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges.of(self.tokenizer)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.mark = self._ids("\x1f")
        self._check(path)
        self.marks = self._parted()
        self.latin = self._reads_latin()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _check(self, path: str) -> None:
        letters = "abcdefghijklmnopqrstuvwxyz"
        small = {c: self._ids(c) for c in letters}
        faults = {
            "lower-case": any(self._ids(c.upper() + c) != self._ids(c + c) for c in letters),
            "drop and split at white space": any(self._ids(f"{g}a{g}{g}b{g}") != small["a"] + small["b"] for g in [*"\t\n\x0b\x0c\r ", *(w.decode() for w in _WIDE)]),
            "read a word of letters as it stands": any(self._bare(a + b) != self._ids(a + b) for a in letters for b in letters),
            "part letters from marks": any(self._ids(f"{c}{c}{chr(m)}") != self._ids(c + c) + self._ids(chr(m)) for c in letters for m in MARKS),
        }
        for need, missing in faults.items():
            if missing:
                raise ValueError(f"{path}: packing needs a tokenizer that does {need}")

    def _parted(self) -> np.ndarray:
        """Whether a byte is a mark, of which a run after a letter is parted from it; single ones of MARKS only where runs are not."""
        added = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        marks = [chr(m) for m in MARKS + MORE if chr(m) not in added]
        runs = all(self._ids(f"{c}{c}{m}{n}") == self._ids(c + c) + self._ids(m + n) for c in "az" for m in marks for n in ["", *marks])
        letters = all(self._ids(f"{chr(c)}{m}") == self._ids(chr(c)) + self._ids(m) for c in range(97, 123) for m in marks)
        self.run = RUN if runs and letters else 1
        return np.isin(np.arange(256), [ord(m) for m in marks] if runs and letters else list(MARKS))

    def _reads_latin(self) -> bool:
        letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]]
        return all(self._ids(a + b) == self._from_bytes((a + b).encode()) for a in letters for b in ["", *letters])

    def _from_bytes(self, word: bytes) -> list[int]:
        """Ids of a word of Latin letters, by its bytes."""
        small = word.decode().lower()
        return self._bare(small if small.isascii() else small.encode().decode("latin-1").translate(_BYTES))

    def _bare(self, word: str) -> list[int]:
        """Ids of a word of letters a-z, which needs no normal form and is not cut."""
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _letters(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the words, that lie one after the other, are of letters that are read from their bytes."""
        good = _SMALL[data]
        if self.latin:
            second = np.concatenate(([False], (data[:-1] == 0xC3) & _SECOND[data[1:]])) if len(data) else good
            good = good | _CAPITAL[data] | second | np.append(second[1:], False)
        wrong = np.concatenate(([0], np.cumsum(~good)))
        return wrong[at[1:]] == wrong[at[:-1]]

    def _distinct(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: all ids, and where each word's begin and how many they are."""
        own, at = words.gather(data, starts, sizes)
        # a long word may take very many merges, one after the other
        plain = self._letters(own, at) & (sizes <= WORD) if self.merges else np.zeros(len(starts), bool)
        odd, raw = np.flatnonzero(~plain), own.tobytes()
        looked_up = self._look_up([raw[a:b] for a, b in zip(at[odd].tolist(), at[odd + 1].tolist(), strict=True)])
        n = np.zeros(len(starts), np.int64)
        n[odd] = np.fromiter(map(len, looked_up), np.int64, len(odd)) // 4
        ids = np.frombuffer(b"".join(looked_up), "<u4")
        if plain.any():
            letters = own[np.repeat(plain, sizes)]
            lead = np.concatenate(([False], letters[:-1] == 0xC3))
            small = np.where(_CAPITAL[letters] | lead & (letters < 0x9F), letters + np.uint8(32), letters)
            merged, ends = self.merges.read(small, sizes[plain])
            n[plain] = np.diff(ends, prepend=0)
            ids = np.concatenate((merged, ids))
        begin = np.zeros(len(starts), np.int64)
        order = np.concatenate((np.flatnonzero(plain), odd))
        begin[order] = np.cumsum(n[order]) - n[order]
        return ids, begin, n

    def _made(self, new: list[bytes]) -> list[bytes]:
        """Ids of each word, made in one text with a mark between them; words that may hold the mark singly."""
        texts = [w.decode() for w in new]
        if len(self.mark) != 1 or any("\x1f" in w for w in texts):
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = self.tokenizer.encode_batch_fast([" \x1f ".join(texts)], add_special_tokens=False)[0].ids
        raw = array("I", ids).tobytes()
        ends = (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == self.mark[0])).tolist()
        return [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)], strict=True)]

    def _look_up(self, distinct: list[bytes]) -> list[bytes]:
        """Ids of each word. Words not asked for while as many others came are forgotten."""
        out = list(map(self.known.get, distinct))
        missing = [i for i, ids in enumerate(out) if ids is None]
        new = []
        for i in missing:
            out[i] = self.older.get(distinct[i])
            if out[i] is None:
                new.append(i)
        odd = []
        for i in new:
            w = distinct[i]
            # of ASCII letters, for bytes
            if w.isalpha() and w.islower():
                out[i] = array("I", self._bare(w.decode())).tobytes()
            elif self.latin and _LATIN(w):
                out[i] = array("I", self._from_bytes(w)).tobytes()
            else:
                odd.append(i)
        for at in range(0, len(odd), 4096):
            part = odd[at : at + 4096]
            for i, ids in zip(part, self._made([distinct[i] for i in part]), strict=True):
                out[i] = ids
        if len(self.known) + len(missing) > REMEMBERED:
            self.known, self.older = {}, self.known
        self.known.update((distinct[i], out[i]) for i in missing if len(distinct[i]) <= WORD)
        return out

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a chunk, one text after the other, and the texts' offsets there."""
        data = _plain(data)
        starts, ends, first = words.word_spans(data, offsets, words.SPACE)
        # where the marks at a word's end begin; longer runs stay with their word
        tail = ends.copy()
        rest = np.flatnonzero(self.marks[data[ends - 1]])
        for _ in range(self.run):
            tail[rest] -= 1
            rest = rest[tail[rest] > starts[rest]]
            rest = rest[self.marks[data[tail[rest] - 1]]]
        marked = (tail < ends) & (tail > starts) & _SMALL[data[tail - 1]]
        both = np.repeat(np.arange(len(starts)), 1 + marked)
        # of the two parts of a marked word the second is its marks
        second = np.concatenate(([False], both[1:] == both[:-1])) if len(both) else marked
        starts, ends, tail, marked = starts[both], ends[both], tail[both], marked[both]
        starts, ends = np.where(second, tail, starts), np.where(marked & ~second, tail, ends)
        first = np.searchsorted(both, first)
        one, code = words.distinct(data, starts, ends, words.hash_of(words.prefix_hash(data), starts, ends))
        ids, begin, size = self._distinct(data, starts[one], ends[one] - starts[one])
        flat, tops = words.gather(ids, begin[code], size[code])
        return flat, tops[first]

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian bytes."""
        for _, n, data, offsets in words.chunks(pa.array(texts, pa.large_string()), CHUNK):
            flat, at = self.chunk(data, offsets)
            for i in range(n):
                yield flat[at[i] : at[i + 1]].tobytes()


@cache
def ids_for(path: str) -> Ids:
    """One for a worker process, over all its tasks."""
    return Ids(path)


def tokenized(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``(key, n, crcs, marks)``: number of ids, check sums of the full sequences, and running ones of the rest at each GRID ids and its end."""
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_for(path)
        for b in batches:
            for first, rows, data, offsets in words.chunks(b.column("text"), CHUNK):
                flat, at = ids.chunk(data, offsets)
                n, crcs, marks = [], [], []
                for i in range(rows):
                    own = flat[at[i] : at[i + 1]].tobytes() + end
                    full = len(own) // (4 * LENGTH)
                    n.append(len(own) // 4)
                    crcs.append([zlib.crc32(own[4 * LENGTH * i : 4 * LENGTH * (i + 1)]) for i in range(full)])
                    marks.append(running(own[4 * LENGTH * full :]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(key).slice(first, rows), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    [key, "n", "crcs", "marks"],
                )

    return docs.select(key, "text").mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, n long, crcs array<long>, marks binary")


def running(rest: bytes) -> bytes:
    """Check sums of the first GRID, 2 GRID, ... ids of a rest and of all of it."""
    crc, out = 0, []
    for at in range(0, len(rest), 4 * GRID):
        crc = zlib.crc32(rest[at : at + 4 * GRID], crc)
        out.append(crc)
    return np.array(out, "<u4").tobytes()


def _times(matrix: list[int], vector: int) -> int:
    out = i = 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@cache
def _zeros(n_bits: int) -> list[int]:
    """What ``n_bits`` zero bits after it make of a check sum, as a matrix over bits."""
    if n_bits == 1:
        return [0xEDB88320, *[1 << i for i in range(31)]]
    half = _zeros(n_bits // 2)
    whole = [_times(half, row) for row in half]
    return [_times(_zeros(1), row) for row in whole] if n_bits % 2 else whole


def between(before: int, upto: int, n_ids: int) -> int:
    """Check sum of the last ``n_ids`` ids, from those of the ids before them and of all together."""
    return upto ^ _times(_zeros(32 * n_ids), before)


@dataclass(frozen=True)
class Plan:
    """Where the rests go, as arrays over runs of ranks: the n-th rest of ``length`` with lo <= n < hi.

    Each run has its pieces ``(start, length, first pack, offset)``; the pack of rank n is first pack + n - lo.
    """

    length: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    pieces: list[list[tuple[int, int, int, int]]]
    packs: int


def _patterns(histogram: dict[int, int]) -> list[tuple[int, int, tuple[tuple[int, int], ...]]]:
    """Shortest pack first: ``(used, count, lengths with their offsets)`` of every pattern."""
    heap: list[tuple[int, int, int, tuple[tuple[int, int], ...]]] = []
    tick = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if heap and heap[0][0] + length <= LENGTH:
                used, _, count, inside = heapq.heappop(heap)
                took = min(count, left)
                if took < count:
                    tick += 1
                    heapq.heappush(heap, (used, tick, count - took, inside))
            else:
                used, took, inside = 0, left, ()
            tick += 1
            heapq.heappush(heap, (used + length, tick, took, (*inside, (length, used))))
            left -= took
    return sorted((used, count, inside) for used, _, count, inside in heap)


def plan(histogram: dict[int, int], grid: int = GRID) -> Plan:
    """Patterns for a histogram of rests, gaps filled, and packs numbered."""
    patterns = _patterns({k: v for k, v in histogram.items() if v})
    # the emptiest packs that fit, cut on the grid, into the gaps of those kept
    room = sum((LENGTH - used) // grid * grid * count for used, count, _ in patterns)
    apart: dict[int, int] = {}
    kept = []
    for used, count, inside in patterns:
        lost = used + (LENGTH - used) // grid * grid
        took = min(count, max(0, room // lost)) if used < LENGTH else 0
        room -= took * lost
        for length, _ in inside if took else ():
            apart[length] = apart.get(length, 0) + took
        if took < count:
            kept.append((used, count - took, inside))
    runs: dict[int, list[tuple[int, list[tuple[int, int, int, int]]]]] = {}
    packs = 0
    gaps: list[tuple[int, int, int]] = []
    for used, count, inside in kept:
        for length, offset in inside:
            runs.setdefault(length, []).append((count, [(0, length, packs, offset)]))
        if used < LENGTH:
            heapq.heappush(gaps, (used, packs, count))
        packs += count
    todo = sorted(((length, count, 0, []) for length, count in apart.items()), key=lambda x: x[:2])
    while todo:
        length, count, done, pieces = todo.pop()
        left = length - done
        if gaps and (LENGTH - gaps[0][0] >= left or LENGTH - gaps[0][0] >= grid):
            used, start, n = heapq.heappop(gaps)
        else:
            used, start, n = 0, packs, count
            packs += count
        took = min(n, count)
        size = left if LENGTH - used >= left else (LENGTH - used) // grid * grid
        if took < n:
            heapq.heappush(gaps, (used, start + took, n - took))
        if used + size < LENGTH:
            heapq.heappush(gaps, (used + size, start, took))
        if took < count:
            todo.append((length, count - took, done, [(s, n, first + took, o) for s, n, first, o in pieces]))
        # pieces of a run of documents: equal cuts, packs in a row
        grown = [*pieces, (done, size, start, used)]
        if size == left:
            runs.setdefault(length, []).append((took, grown))
        else:
            todo.append((length, took, done + size, grown))
    flat = []
    for length in sorted(runs):
        rank = 0
        for count, pieces in runs[length]:
            flat.append((length, rank, rank + count, pieces))
            rank += count
    columns = list(zip(*flat, strict=True)) or [(), (), (), ()]
    return Plan(*[np.array(c, np.int64) for c in columns[:3]], list(columns[3]), packs)


def ranked(ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Stored ids with the ``rank`` of each rest among its length and ``fulls`` before it there; and (rest, documents, fulls)."""
    # a length may have all documents, so its blocks grow with their number
    blocks = max(BLOCKS, -(-ids.count() // BLOCK))
    slim = ids.withColumns({
        "rest": (F.col("n") % LENGTH).cast("int"), "full": F.size("crcs").cast("long"),
        "block": F.pmod(F.xxhash64(F.col(key), F.col("marks")), F.lit(blocks)).cast("int"),
    })
    counts = as_table(slim.groupBy("rest", "block").agg(F.count("*").alias("c"), F.sum("full").alias("f")), "pack-counts")
    before = Window.partitionBy("rest").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("rest").alias("_rest"), F.col("block").alias("_block"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"),
        F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f0"),
    )
    inside = Window.partitionBy("rest", "block").orderBy(F.xxhash64(F.col(key)), F.col(key), "n", "marks")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumns({"r": F.row_number().over(inside) - 1, "g": F.coalesce(F.sum("full").over(upto), F.lit(0))})
    out = placed.join(starts, (F.col("rest") == F.col("_rest")) & (F.col("block") == F.col("_block")))
    totals = counts.groupBy("rest").agg(F.sum("c").alias("c"), F.sum("f").alias("f")).collect()
    slim_out = out.select(key, "n", "crcs", "marks", "rest", (F.col("c0") + F.col("r")).alias("rank"), (F.col("f0") + F.col("g")).alias("fulls"))
    return slim_out, sorted((r.rest, r.c, r.f) for r in totals)


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """One row per piece of a document: ``key`` and PIECE."""
    ids = as_table(tokenized(docs, path, key), "pack-ids")
    rows, totals = ranked(ids, key)
    layout = plan({rest: c for rest, c, _ in totals if rest})
    # full sequences are numbered after the packs, by rest, block and place
    before = np.zeros(LENGTH, np.int64)
    at = layout.packs
    for rest, _, fulls in totals:
        before[rest] = at
        at += fulls
    shared = docs.sparkSession.sparkContext.broadcast((layout, before))
    names = [key, *[c.split()[0] for c in PIECE.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, first_full = shared.value
        # runs are sorted by length, then rank
        edge = p.length * (1 << 48) + p.lo
        for b in batches:
            index, out = [], []
            columns = [b.column(c).to_pylist() for c in ("n", "crcs", "marks", "rest", "rank", "fulls")]
            for i, (n, crcs, marks, rest, rank, fulls) in enumerate(zip(*columns, strict=True)):
                for k, crc in enumerate(crcs):
                    out.append((k * LENGTH, LENGTH, crc, n, int(first_full[rest]) + fulls + k, 0))
                if rest:
                    sums, skip = np.frombuffer(marks, "<u4"), len(crcs) * LENGTH
                    at = int(np.searchsorted(edge, rest * (1 << 48) + rank, "right")) - 1
                    for start, size, pack, offset in p.pieces[at]:
                        crc = int(sums[-(-(start + size) // GRID) - 1])
                        if start:
                            crc = between(int(sums[start // GRID - 1]), crc, size)
                        out.append((skip + start, size, crc, n, pack + rank - int(p.lo[at]), offset))
                index += [i] * (len(out) - len(index))
            values = np.array(out, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(index, pa.int64())), *[pa.array(values[:, j]) for j in range(6)]], names)

    return rows.mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, {PIECE}")


assert sys.byteorder == "little" and array("I").itemsize == 4


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
