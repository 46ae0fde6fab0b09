"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has exactly one token that can end its encoding:
the token that is a suffix of the prefix and may stand after the last token of
what is before it. Two tokens may stand side by side if undoing their merges,
latest first, never shows a pair at the seam that would have been merged
earlier. So an encoding is one number per prefix, read backwards. Appending bytes
adds numbers and changes none; after an edit the numbers before it stay.

``encode`` works on Arrow batches where the texts are: no shuffle. The pieces of
a chunk (about two megabytes) are cut at once from the code points, equal pieces are
found by hash and compared byte by byte, and the numbers of all distinct pieces
are filled in together, prefix length by prefix length, in numpy. Decoded bytes are
compared with the piece, so a false hash can cost time, not a result: such
pieces, and those over ``LONG`` bytes, are encoded one at a time (``Prefixes``).
The vocabulary is one broadcast of a size fixed by its file; it is checked when
loaded (all single bytes, no token merged from later ones) and errors are raised.

Pieces are the matches of the pattern that rank files of this kind are used
with (``PATTERN``); letters, numbers and white space are asked of the tokenizer
library itself. As there, a piece that is a token as a whole is that token, also
if no merges lead to it.

Defined cases: a null text is empty and has no tokens; repeated rows, ties and
null keys are rows like others; very long texts are chunks of their own; an
empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from maskwright.llm import words

#: What the cutter below follows, as a pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 2 << 20
LONG = 64
# token lengths looked up at every byte; longer ones only where a piece is long enough
DENSE = 6
NONE = np.int64(1) << 40
OTHER, LETTER, NUMBER, BLANK = range(4)

_SLOTS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (key * _ODD) >> np.uint64(64 - bits)


def _kinds() -> np.ndarray:
    """For each code point: letter, number, white space or other, as the tokenizer library sees it."""
    import tiktoken

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        single = tiktoken.Encoding("kinds", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = bytes(single.encode_ordinary(everything)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The last two parts that merges by lower ranks make of a token; None if no merges lead to it."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], len(ranks) + own), i) for i in range(len(parts) - 1))
        if rank == own:
            return ranks[parts[0]], ranks[parts[1]]
        if rank > own and _merged(parts, ranks) == [token]:
            raise ValueError(f"token {own} is merged from later ones")
        if rank > own:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return None


def _merged(parts: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """All merges, lowest rank first, leftmost first."""
    parts = list(parts)
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
        if rank == NONE:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@dataclass
class Vocabulary:
    """Tokens by rank, the halves each is merged from, and look-ups by hash."""

    blob: np.ndarray
    offsets: np.ndarray
    left: np.ndarray
    right: np.ndarray
    reached: np.ndarray
    kinds: np.ndarray
    _seen: dict[int, bool] = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Vocabulary:
        tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            if tokens[rank] or not token:
                raise ValueError(f"rank {rank} is given twice, or to an empty token")
            tokens[rank] = token
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("single bytes are missing from the vocabulary")
        left, right = np.full(len(tokens), -1, np.int64), np.full(len(tokens), -1, np.int64)
        reached = np.array([len(t) == 1 for t in tokens])
        for rank, token in enumerate(tokens):
            if len(token) > 1 and (halves := _halves(token, ranks)):
                left[rank], right[rank], reached[rank] = *halves, True
        offsets = np.zeros(len(tokens) + 1, np.int64)
        np.cumsum([len(t) for t in tokens], out=offsets[1:])
        return cls(np.frombuffer(b"".join(tokens), np.uint8), offsets, left, right, reached, _kinds())

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a file of lines ``base64(token) rank``."""
        with open(path, "rb") as lines:
            return cls.of({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token})

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("blob", "offsets", "left", "right", "reached", "kinds")}

    def __setstate__(self, state):
        self.__dict__.update(state, _seen={})

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    @cached_property
    def lengths(self) -> list[int]:
        """Lengths that reached tokens have, ascending."""
        return np.unique(self.sizes[self.reached]).tolist()

    @cached_property
    def whole(self) -> dict[bytes, int]:
        data = self.blob.tobytes()
        return {data[self.offsets[t] : self.offsets[t + 1]]: t for t in np.flatnonzero(self.sizes).tolist()}

    @cached_property
    def by_hash(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in order and their tokens; for each slot one of its tokens, -1 if none, and that token's hash."""
        tokens = np.flatnonzero(self.sizes)
        h = raw(words.prefix_hash(self.blob), self.offsets[tokens], self.offsets[tokens + 1])
        order = np.argsort(h)
        h, tokens = h[order], tokens[order]
        held = np.full(1 << _SLOTS, -1, np.int32)
        held[_slot(h, _SLOTS)] = tokens
        of = np.zeros(self.sizes.size, np.uint64)
        of[tokens] = h
        return h, tokens, held, of

    @cached_property
    def pairs(self) -> np.ndarray:
        """Reached tokens of two bytes, by both as one number; -1 elsewhere."""
        out = np.full(1 << 16, -1, np.int64)
        two = np.flatnonzero((self.sizes == 2) & self.reached)
        at = self.offsets[two]
        out[self.blob[at].astype(np.int64) << 8 | self.blob[at + 1]] = two
        return out

    @cached_property
    def singles(self) -> np.ndarray:
        one = np.flatnonzero(self.sizes == 1)
        out = np.empty(256, np.int64)
        out[self.blob[self.offsets[one]]] = one
        return out

    @cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs in order as one number each, and what they merge to."""
        tokens = np.flatnonzero(self.left >= 0)
        pairs = self.left[tokens] << 32 | self.right[tokens]
        order = np.argsort(pairs)
        # the last one is no pair
        return np.append(pairs[order], np.iinfo(np.int64).max), np.append(tokens[order], 0)

    @cached_property
    def memory(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs judged before; a slot holds the last one that fell there."""
        return np.full(1 << _SLOTS, -1, np.int64), np.zeros(1 << _SLOTS, bool)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are a token's, and that token; its bytes are not compared here."""
        keys, tokens, held, of = self.by_hash
        said = held[_slot(h, _SLOTS)]
        near = np.flatnonzero(said >= 0)
        token, h = said[near].astype(np.int64), h[near]
        # another token of the slot, or none
        other = np.flatnonzero(of[token] != h)
        at = np.minimum(np.searchsorted(keys, h[other]), len(keys) - 1)
        token[other] = np.where(keys[at] == h[other], tokens[at], -1)
        good = token >= 0
        return near[good], token[good]

    def _judge(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the tokens of each pair may stand side by side."""
        keys, merged = self.merges
        out = np.ones(len(pairs), bool)
        at, x, y = np.arange(len(pairs)), pairs >> 32, pairs & 0xFFFFFFFF
        limit = np.full(len(pairs), NONE)
        while len(at):
            pair = x << 32 | y
            k = np.searchsorted(keys, pair)
            early = (keys[k] == pair) & (merged[k] < limit)
            out[at[early]] = False
            # the side merged last is undone; a single byte cannot be, then the other one is
            undo_left = np.where(x > y, self.left[x] >= 0, self.left[y] < 0)
            going = ~early & ((self.left[x] >= 0) | (self.left[y] >= 0))
            # of two merges of one rank the left one comes first
            limit = np.where(undo_left, x, y + 1)[going]
            at, undo_left, x, y = at[going], undo_left[going], x[going], y[going]
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return out

    def side_by_side(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        pairs = x << 32 | y
        known, said = self.memory
        slot = _slot(pairs.view(np.uint64), _SLOTS).astype(np.int64)
        missing = known[slot] != pairs
        out = said[slot]
        if missing.any():
            new, back = np.unique(pairs[missing], return_inverse=True)
            judged = self._judge(new)
            out[missing] = judged[back]
            to = _slot(new.view(np.uint64), _SLOTS).astype(np.int64)
            known[to], said[to] = new, judged
            # two new pairs may meet in one slot; its answer must be that of its pair
            known[to[known[to] != new]] = -1
        return out

    def fits(self, x: int, y: int) -> bool:
        """side_by_side() of one pair."""
        key = x << 32 | y
        if key not in self._seen:
            if len(self._seen) > 1 << 20:
                self._seen.clear()
            self._seen[key] = bool(self._judge(np.array([key], np.int64))[0])
        return self._seen[key]


def raw(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hashes of spans, from words.prefix_hash()."""
    return (prefix[end] - prefix[start]) * words.powers(len(prefix), words.INVERSE)[start]


class Prefixes:
    """One piece with the last token of each of its prefixes; grows at the end, and can be cut anywhere."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        v, old = self.vocabulary, len(self.data)
        self.data += more
        for end in range(old + 1, len(self.data) + 1):
            for n in v.lengths:
                token = v.whole.get(self.data[end - n : end], -1) if n <= end else -1
                if token >= 0 and v.reached[token] and (n == end or v.fits(self.last[end - n - 1], token)):
                    self.last.append(token)
                    break

    def cut(self, length: int) -> None:
        self.data = self.data[:length]
        del self.last[length:]

    def tokens(self) -> list[int]:
        if self.data in self.vocabulary.whole:
            return [self.vocabulary.whole[self.data]]
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= int(self.vocabulary.sizes[out[-1]])
        return out[::-1]


def cuts(v: Vocabulary, points: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pieces start, in code points of the texts that begin at ``texts`` (with the end of the last)."""
    n = len(points)
    kind = np.append(v.kinds[points], 255)
    start = np.ones(n + 1, bool)
    start[1:] = kind[1:] != kind[:-1]
    start[texts] = True
    # the last blank of a run before a word: a space goes to the word, any other stands alone
    ends = np.zeros(n + 1, bool)
    ends[texts] = True
    after = np.flatnonzero(start[1:n] & (kind[: n - 1] == BLANK) & ~ends[1:n]) + 1 if n else np.zeros(0, np.int64)
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    # 's 't 'm 'd 're 've 'll
    mark = np.flatnonzero(start[:n] & (points == 0x27))
    if len(mark):
        ahead = np.append(points, [0, 0])
        stop = texts[np.searchsorted(texts, mark, "right")]
        one, two = np.where(mark + 1 < stop, ahead[mark + 1], 0), np.where(mark + 2 < stop, ahead[mark + 2], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
    return np.flatnonzero(start[:n])


def cut_bytes(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces of the texts of a chunk, in bytes, and for each text its first piece (with the end of the last)."""
    begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    starts = begins[cuts(v, points, np.searchsorted(begins, offsets))]
    return starts, np.searchsorted(starts, offsets)


class Encoded:
    """A text with its pieces and their tables: appends and edits encode only what is new or near.

    A piece hangs on two code points behind it at most, so cutting starts
    ``BACK`` pieces before an edit and ends where an old cut comes back.
    """

    BACK = 3

    def __init__(self, vocabulary: Vocabulary, text: str = "") -> None:
        self.vocabulary, self.text = vocabulary, ""
        self.begins: list[int] = []
        self.pieces: list[Prefixes] = []
        self.append(text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of the code points from ``start`` to ``end``."""
        shift, edited = len(new) - (end - start), start + len(new)
        self.text = self.text[:start] + new + self.text[end:]
        k = max(0, bisect_right(self.begins, start) - 1 - self.BACK)
        again = self.begins[k] if self.begins else 0
        window, back = 64, None
        while True:
            stop = min(len(self.text), edited + window)
            points = np.frombuffer(self.text[again:stop].encode("utf-32-le"), np.uint32)
            cut = (again + cuts(self.vocabulary, points, np.array([0, len(points)]))).tolist()
            for c in cut if stop == len(self.text) else cut[: -self.BACK]:
                i = bisect_left(self.begins, c - shift)
                if c >= edited and i < len(self.begins) and self.begins[i] == c - shift:
                    back = c
                    break
            if back is not None or stop == len(self.text):
                break
            window *= 4
        rest = len(self.begins) if back is None else i
        fresh = cut if back is None else cut[: cut.index(back)]
        made = []
        for j, (at, to) in enumerate(pairwise([*fresh, len(self.text) if back is None else back])):
            data, piece = self.text[at:to].encode(), Prefixes(self.vocabulary)
            if k + j < rest and self.begins[k + j] == at:
                piece = self.pieces[k + j]
                piece.cut(len(os.path.commonprefix([piece.data, data])))
            piece.append(data[len(piece.data) :])
            made.append(piece)
        self.pieces[k:rest] = made
        self.begins[k:] = fresh + [b + shift for b in self.begins[rest:]]

    def tokens(self) -> list[int]:
        return [t for piece in self.pieces for t in piece.tokens()]


def _last_tokens(v: Vocabulary, data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token of each byte prefix of short pieces, one piece after the other, and the pieces' offsets there.

    -1, or a value above all tokens, where a false hash has spoilt it.
    """
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    inner = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
    source = inner + np.repeat(starts, lengths)
    bytes_of = data[source]
    every = np.arange(len(inner))
    found = [(every, v.singles[bytes_of], 1)]
    two = np.concatenate(([-1], v.pairs[bytes_of[:-1].astype(np.int64) << 8 | bytes_of[1:]])) if len(inner) else every
    at = np.flatnonzero((two >= 0) & (inner > 0))
    found.append((at, two[at], 2))
    upto, since, scale = prefix[source + 1], prefix[source], words.powers(len(prefix), words.INVERSE)[source]
    at = None
    for n in v.lengths:
        if n <= 2:
            continue
        if n > len(inner):
            break
        if n <= DENSE:
            # spans over the seams of pieces are looked up along, and put off then
            end, token = v.find((upto[n - 1 :] - since[: len(since) - n + 1]) * scale[: len(since) - n + 1])
            end = end + n - 1
            good = (inner[end] >= n - 1) & v.reached[token] & (v.sizes[token] == n)
        else:
            at = np.flatnonzero(inner >= n - 1) if at is None else at[inner[at] >= n - 1]
            if not len(at):
                break
            end, token = v.find((upto[at] - since[at + 1 - n]) * scale[at + 1 - n])
            end = at[end]
            good = v.reached[token] & (v.sizes[token] == n)
        found.append((end[good], token[good], n))
    end = np.concatenate([f[0] for f in found])
    token = np.concatenate([f[1] for f in found])
    size = np.concatenate([np.full(len(f[0]), f[2], np.int64) for f in found])
    order = np.argsort(inner[end].astype(np.int16), kind="stable")
    end, token, size = end[order], token[order], size[order]
    steps = np.searchsorted(inner[end], np.arange(int(lengths.max(initial=0)) + 1))
    last = np.full(offsets[-1], -1, np.int64)
    for lo, hi in zip(steps[:-1], steps[1:], strict=True):
        e, t, n = end[lo:hi], token[lo:hi], size[lo:hi]
        before = np.where(inner[e] + 1 == n, -1, last[e - n])
        fits = inner[e] + 1 == n
        seam = np.flatnonzero(before >= 0)
        fits[seam] = v.side_by_side(before[seam], t[seam])
        last[e[fits]] = t[fits]
    return last, offsets


def encode_pieces(v: Vocabulary, data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each piece, one piece after the other, and the pieces' offsets there."""
    lengths = ends - starts
    whole = np.full(len(starts), -1, np.int64)
    found, token = v.find(raw(prefix, starts, ends))
    whole[found] = token
    parts = np.flatnonzero((whole < 0) & (lengths <= LONG))
    last, at = _last_tokens(v, data, prefix, starts[parts], lengths[parts])
    # read backwards, all pieces at once
    end, going = at[1:].copy(), np.arange(len(parts))
    rounds: list[tuple[np.ndarray, np.ndarray]] = []
    while len(going):
        token = last[end[going] - 1]
        going, token = going[token >= 0], token[token >= 0]
        rounds.append((going, token))
        end[going] -= v.sizes[token]
        going = going[end[going] > at[going]]
    n = np.where(whole >= 0, 1, 0)
    for piece, _ in rounds:
        n[parts[piece]] += 1
    offsets = np.concatenate(([0], np.cumsum(n)))
    ids = np.empty(offsets[-1], np.int64)
    ids[offsets[:-1][whole >= 0]] = whole[whole >= 0]
    for k, (piece, token) in enumerate(rounds):
        ids[offsets[parts[piece] + 1] - 1 - k] = token
    decoded, tops = words.gather(v.blob, v.offsets[ids], v.sizes[ids])
    tops = tops[offsets]
    wrong = words.unlike(words.eights(decoded), tops[:-1], np.diff(tops), words.eights(data), starts, lengths)
    if not wrong.any():
        return ids, offsets
    alone = {i: Prefixes(v, data[starts[i] : ends[i]].tobytes()).tokens() for i in np.flatnonzero(wrong).tolist()}
    out = [np.array(alone[i], np.int64) if i in alone else ids[offsets[i] : offsets[i + 1]] for i in range(len(n))]
    n[list(alone)] = [len(t) for t in alone.values()]
    return np.concatenate(out), np.concatenate(([0], np.cumsum(n)))


def encode_chunk(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the texts of a chunk, and the texts' offsets there."""
    starts, first = cut_bytes(v, data, offsets)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    prefix = words.prefix_hash(data)
    one, code = words.distinct(data, starts, ends, raw(prefix, starts, ends))
    ids, at = encode_pieces(v, data, prefix, starts[one], ends[one])
    flat, tops = words.gather(ids, at[code], np.diff(at)[code])
    return flat, tops[first]


def _added(docs: DataFrame, column: str, kind) -> StructType:
    return StructType([*docs.schema.fields]).add(column, kind)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` without ``text``, with its token ids."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    kept = docs.drop(text)
    names = [*kept.columns, ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            for first, n, data, offsets in words.chunks(b.column(b.num_columns - 1), CHUNK):
                flat, at = encode_chunk(v, data, offsets)
                column = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[c.slice(first, n) for c in b.columns[:-1]], column], names)

    return docs.select(*kept.columns, text).mapInArrow(run, _added(kept, ids, ArrayType(IntegerType())))


def decode(tokens: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; null ids are none, unknown ids an error."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    names, place = [*tokens.columns, into], tokens.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            lists = b.column(place)
            lists = lists.fill_null([]) if lists.null_count else lists
            at = np.asarray(lists.offsets).astype(np.int64)
            values = np.asarray(lists.values)
            row = 0
            while row < b.num_rows:
                # bounded by tokens; a longer text is decoded alone
                stop = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK // 4, "right")) - 1)
                flat = values[at[row] : at[stop]].astype(np.int64)
                if len(flat) and (flat.min() < 0 or flat.max() >= len(v.sizes) or not v.sizes[flat].all()):
                    raise ValueError("ids that the vocabulary does not have")
                data, tops = words.gather(v.blob, v.offsets[flat], v.sizes[flat])
                bounds = tops[at[row : stop + 1] - at[row]]
                column = pa.Array.from_buffers(pa.large_binary(), stop - row, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([*[c.slice(row, stop - row) for c in b.columns], column.cast(pa.binary())], names)
                row = stop

    return tokens.mapInArrow(run, _added(tokens, into, BinaryType()))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Ids and decoded bytes of each document, as counts and hashes."""
    out = decode(encode(docs.select("doc_id", "text"), path), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def rank_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), rank_path())
