"""Words and hashes of whole texts, on the bytes of an Arrow column at once.

A word's hash is a polynomial over its bytes modulo 2^64, read from one running
sum over the column, and then mixed; nothing is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

# bytes of text handled at a time; a longer text is handled alone
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: For words of letters: ASCII bytes that are no letters; bytes of other scripts count as letters.
NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finish after which all bits are alike."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices ``(first row, rows, bytes, offsets)`` of a string column of about ``size`` bytes; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        last = min(last, len(column))
        yield first, last - first, all_bytes[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial; the hash of bytes i..j is (p[j] - p[i]) / BASE^i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data), BASE), out=out[1:])
    return out


def hash_of(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), INVERSE)[start])


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes outside ``gap``, and for each text where its words begin."""
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words begin (with the end of the last)."""
    starts, ends, first = word_spans(data, offsets, gap)
    return hash_of(prefix_hash(data), starts, ends), first


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans one after the other, and their offsets there; ``data`` may hold values of any type."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)], offsets


def eights(data: np.ndarray) -> np.ndarray:
    """For each byte, it and the seven after it as one little-endian number; behind the end come zeros."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ascontiguousarray(np.ndarray(len(data) + 1, "<u8", padded, 0, (1,)))


def unlike(left: np.ndarray, start: np.ndarray, length: np.ndarray, right: np.ndarray, other: np.ndarray, other_length: np.ndarray) -> np.ndarray:
    """Whether two spans differ, eight bytes at a time; ``left`` and ``right`` come from eights()."""
    out = length != other_length
    rest, at = np.flatnonzero(~out & (length > 0)), 0
    while len(rest):
        bits = np.uint64(8) * np.minimum(8, length[rest] - at).astype(np.uint64)
        out[rest] |= ((left[start[rest] + at] ^ right[other[rest] + at]) << (np.uint64(64) - bits)) != 0
        at += 8
        rest = rest[length[rest] > at]
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal spans found by hash and compared byte by byte: the place of each distinct one's first case, and each span's number.

    Spans that share a hash but not their bytes get numbers of their own.
    """
    code, _ = pd.factorize(hashes)
    code = code.astype(np.int64)
    first = np.zeros(int(code.max()) + 1 if len(code) else 0, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    length, view = ends - starts, eights(data)
    same = first[code]
    others = np.flatnonzero(unlike(view, starts, length, view, starts[same], length[same]))
    if len(others):
        own: dict[tuple[int, bytes], int] = {}
        more = list(first)
        for i in others.tolist():
            key = (int(code[i]), data[starts[i] : ends[i]].tobytes())
            if key not in own:
                own[key] = len(more)
                more.append(i)
            code[i] = own[key]
        first = np.array(more, np.int64)
    return first, code
