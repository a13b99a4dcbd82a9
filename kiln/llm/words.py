"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow batch.

A batch is handled in slices of a few MB of text (a longer text is a slice of its own), so the memory of a
Python worker follows the longest text, not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers (the SplitMix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class RangeHasher:
    """64-bit hashes of any ranges of a sequence of numbers, from prefix sums of number * R**position.

    A sum modulo 2**64: there are different ranges with the same hash, so equality has to be confirmed.
    """

    _up = np.zeros(0, _U)
    _down = np.zeros(0, _U)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(RangeHasher._up) < n:
            RangeHasher._up, RangeHasher._down = powers(_R, n), powers(_R_INVERSE, n)
        self.sums = np.zeros(n, _U)
        np.cumsum((data.astype(_U) + _U(1)) * RangeHasher._up[: n - 1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * RangeHasher._down[starts]
        return mix64(raw + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


#: Longer byte ranges are hashed one by one.
_LONG = 256
#: The bytes of a 64-bit number that belong to a range of which so many bytes are left.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], _U)


class Hasher:
    """64-bit hashes of any byte ranges of one buffer.

    Eight bytes at a time are mixed into the hash by a bijection that is not linear, so neither repetitive nor
    constructed texts collide more often than random ones; ranges of over 256 bytes are hashed by BLAKE2.
    """

    def __init__(self, data: np.ndarray):
        self.raw = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
        self.windows = np.ndarray(len(data) + 1, "<u8", self.raw, strides=(1,))  # the 8 bytes from every place on

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        h = mix64(size.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(1))
        row = np.flatnonzero((size > 0) & (size <= _LONG))
        at, left = starts[row], size[row]
        while len(row):
            h[row] = mix64(h[row] ^ (self.windows[at] & _BYTES[np.minimum(left, 8)]))
            more = left > 8
            row, at, left = row[more], at[more] + 8, left[more] - 8
        for k in np.flatnonzero(size > _LONG).tolist():
            h[k] ^= _U(int.from_bytes(hashlib.blake2b(self.raw[starts[k] : ends[k]], digest_size=8).digest(), "little"))
        return h


@dataclass
class Words:
    """Words of the texts of a slice: byte ranges, and ``first[i]:first[i + 1]`` are those of text i."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> Words:
    """Runs of bytes that are not ASCII white space (or not in the table ``space``), cut at the text borders ``offsets``."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~space[data]
    begin, end = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begin[inner] |= word[1:-1][inner]
    end[inner - 1] |= word[1:-1][inner - 1]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for Latin-1 letters in UTF-8."""
    out = lower_ascii(data)
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    return np.where(after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), out + 0x20, out).astype(np.uint8)


def text_slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them); a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def sums_by_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges ``first[i]:first[i + 1]`` (0 for an empty range)."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
