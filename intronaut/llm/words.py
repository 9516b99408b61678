"""Vectorised word kernels over Arrow string columns.

All documents of a chunk are handled together: the UTF-8 buffer of the column is
looked at as one byte array, word borders come from a byte-class table and each
word gets a 64-bit polynomial fingerprint out of one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Chunk of bytes handled at once, small enough to stay near the caches.
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([not (c >= 0x80 or chr(c).isalnum()) for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.concatenate([[U(1)], np.cumprod(np.full(n, b, U))]) for b in (self.base, self.inverse))
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_WORD_BASE)


@dataclass
class Words:
    """Words of the rows ``first`` to ``last`` (exclusive) of a column; ``offsets[i]`` is the first word of row ``first + i``.

    A row longer than a chunk comes in pieces, alone: ``base`` is the number of its words before the piece's
    first one, and ``more`` tells that a further piece follows.
    """

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    codes: np.ndarray
    base: int = 0
    more: bool = False

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row borders of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    borders = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8), borders


def split_words(column: pa.Array | pa.ChunkedArray, lower: bool = False, chunk: int = CHUNK_BYTES, separators: np.ndarray = SPACE, overlap: int = 0, whole: bool = False) -> Iterator[Words]:
    """Words ``[^\\x20\\x09-\\x0D]+`` (or between other separators) of whole texts with fingerprints, a chunk of rows at a time.

    A row longer than ``chunk`` is cut between words into pieces that begin with the last ``overlap`` words of the
    piece before, so memory stays with the chunk; only a single word longer than a chunk is handled as it is.
    With ``whole``, rows are never cut.
    """
    data, borders = strings(column)
    rows, i = len(borders) - 1, 0
    while i < rows:
        j = max(i + 1, min(rows, int(np.searchsorted(borders, borders[i] + chunk, "right")) - 1))
        part = data[borders[i] : borders[j]]
        if len(part) > chunk and not whole:
            yield from _pieces(part, i, lower, chunk, separators, overlap)
        else:
            yield _words(part, borders[i : j + 1] - borders[i], i, j, lower, separators)
        i = j


def _pieces(row: np.ndarray, i: int, lower: bool, chunk: int, separators: np.ndarray, overlap: int) -> Iterator[Words]:
    at = base = 0
    while True:
        end, found = at, None
        while found is None or (end < len(row) and len(found.starts) <= overlap):
            end = min(len(row), end + chunk)
            while end < len(row):  # on to the next border between words
                gaps = np.flatnonzero(separators[row[end : end + chunk]])
                if len(gaps):
                    end += int(gaps[0])
                    break
                end = min(len(row), end + chunk)
            found = _words(row[at:end], np.array([0, end - at]), i, i + 1, lower, separators)
        found.base, found.more = base, end < len(row)
        yield found
        if not found.more:
            return
        fresh = len(found.starts) - overlap
        base += fresh
        at += int(found.starts[fresh]) if overlap else end - at


def _words(part: np.ndarray, cuts: np.ndarray, i: int, j: int, lower: bool, separators: np.ndarray) -> Words:
    if not len(part):
        none = np.zeros(0, np.int64)
        return Words(i, j, part, none, none, np.zeros(j - i + 1, np.int64), np.zeros(0, U))
    if lower:
        part = LOWER[part]
    inside = ~separators[part]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0] = after[-1] = False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    borders = cuts[(cuts > 0) & (cuts < len(part))]
    before[borders] = False
    after[borders - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _BYTE_POWERS(len(part) + 1)
    sums = np.empty(len(part) + 1, U)
    sums[0] = 0
    np.cumsum((part.astype(U) + U(1)) * up[: len(part)], out=sums[1:])
    codes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
    return Words(i, j, part, starts, ends, np.searchsorted(starts, cuts), codes)


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of ``width`` consecutive codes, for every start, document borders not looked at."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = _WORD_POWERS(len(codes) + 1)
    sums = np.empty(len(codes) + 1, U)
    sums[0] = 0
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n] + U(width))


def sequence_code(codes: np.ndarray) -> int:
    """Fingerprint of a whole short sequence; equal to that of ``windows`` for the same words."""
    return int(windows(codes, len(codes))[0])


def shingle_sets(column: pa.Array | pa.ChunkedArray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle fingerprints of each lower-cased text; fewer words make one shingle, no word none."""
    pieces: list[np.ndarray] = []
    for words in split_words(column, lower=True, overlap=width - 1):
        all_codes = windows(words.codes, width)
        if words.more or words.base:  # a long row: its pieces share no shingle start
            pieces.append(np.unique(all_codes))
            if not words.more:
                yield np.unique(np.concatenate(pieces))
                pieces = []
            continue
        for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(all_codes[a : b - width + 1])
            elif b > a:
                yield np.array([sequence_code(words.codes[a:b])], U)
            else:
                yield np.zeros(0, U)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
