"""Words of UTF-8 text as 64-bit hashes, by numpy over Arrow buffers and without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; the temporary arrays are some thirty times as large.
CHUNK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def table(members) -> np.ndarray:
    """A 256-entry truth table of byte values."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Separators of the word pattern [^\x20\x09-\x0D]+.
SPACE = table([0x20, *range(0x09, 0x0E)])
#: Separators of the word pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case.
NOT_ALNUM = table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and those of its inverse."""
    global _powers
    if _powers is None:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        both = []
        for b in (_BASE, inverse):
            p = np.full(CHUNK + 1, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers = tuple(both)
    return _powers


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets.astype(np.int64)


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in data; a word ends where its text does."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; data has CHUNK bytes at most."""
    up, down = powers()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_words(data: np.ndarray, separators: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one text of any length, a chunk at a time; a word may be longer than a chunk."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        stops = np.flatnonzero(separators[data[at:end]]) if end < len(data) else ()
        if len(stops):  # cut before a word that would go on
            end = at + int(stops[-1]) + 1
        elif end < len(data):
            out.append(_long_word(data, at, separators, lower))
            at = int(out[-1][1][0])
            continue
        piece = LOWER[data[at:end]] if lower else data[at:end]
        starts, ends = spans(piece, np.array([0, len(piece)]), separators)
        out.append((starts + at, ends + at, hash_spans(piece, starts, ends)))
        at = end
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _long_word(data: np.ndarray, at: int, separators: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word that starts at and is longer than a chunk; its hash chains those of its chunks."""
    start, h = at, np.zeros(1, np.uint64)
    while at < len(data):
        piece = data[at : at + CHUNK]
        stops = np.flatnonzero(separators[piece])
        piece = piece[: stops[0]] if len(stops) else piece
        if len(piece):
            h = mix(h + _STEP[0]) ^ hash_spans(LOWER[piece] if lower else piece, np.array([0]), np.array([len(piece)]))
        at += len(piece)
        if len(stops):
            break
    return np.array([start]), np.array([at]), h


def runs(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with most bytes in all; a longer text comes alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def batch_words(column: pa.Array, separators: np.ndarray, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, row offsets into them) for runs of rows."""
    for first, _, _, _, hashes, own, _ in batch_spans(column, separators, lower):
        yield first, hashes, own


def batch_spans(column: pa.Array, separators: np.ndarray, lower: bool = True) -> Iterator[tuple]:
    """(first row, bytes, word starts, word ends, word hashes, row offsets into the words, row offsets into the bytes) for runs of rows."""
    data, offsets = texts(column)
    for a, b in runs(offsets):
        lo, hi = offsets[a], offsets[b]
        raw, own = data[lo:hi], offsets[a : b + 1] - lo
        if hi - lo > CHUNK:
            starts, ends, hashes = text_words(raw, separators, lower)
        else:
            piece = LOWER[raw] if lower else raw
            starts, ends = spans(piece, own, separators)
            hashes = hash_spans(piece, starts, ends)
        yield a, raw, starts, ends, hashes, np.searchsorted(starts, own), own


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; of the whole sequence if it is shorter, none if it is empty. Sorted and distinct."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = words[: len(words) - n + 1] * _STEP[1]
    for k in range(1, n):
        out = out + words[k : len(words) - n + 1 + k] * _STEP[1 + k]
    return np.unique(mix(out + np.uint64(n)))
