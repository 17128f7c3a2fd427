"""Bytes, words and hashes of many texts at once, as numpy arrays."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE, _WORD_BASE, _OTHER_BASE = U(0x9E3779B97F4A7C13), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
#: Fixed value: bytes that separate words.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


#: A 64-bit value for each byte.
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_POWERS: dict = {}


def powers(base, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least (base is odd)."""
    up, down = _POWERS.get(base, (np.ones(1, dtype=U),) * 2)
    if len(up) < n:
        size = max(n, 1 << 16)
        inverse = U(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up, down = (np.multiply.accumulate(np.concatenate(([U(1)], np.full(size - 1, b, dtype=U)))) for b in (base, inverse))
        _POWERS[base] = up, down
    return up, down


def prefix_sums(values: np.ndarray, base) -> np.ndarray:
    """S with S[j] - S[i] = base**i times the polynomial hash of values[i:j]."""
    out = np.zeros(len(values) + 1, dtype=U)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(base, len(values) + 1)[0][:len(values)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (sums[ends] - sums[starts]) * powers(base, len(sums))[1][starts]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts (one entry more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[data]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows whose texts make up about ``most`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and how many words come before each text."""
    inside = ~_IS_SEP[data]
    new = np.zeros(len(data) + 1, dtype=bool)
    new[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | new[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | new[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    with np.errstate(over="ignore"):
        return mix(range_hashes(prefix_sums(_BYTE[data], _BASE), starts, ends, _BASE) + (ends - starts).astype(U) * U(0x2545F4914F6CDD1D))


def byte_windows(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each position on, over the whole array."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    at = np.arange(n)
    return mix(range_hashes(prefix_sums(_BYTE[data], _BASE), at, at + width, _BASE))


def all_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of many texts, worked through in slices, and words before each text."""
    parts, first = [], [np.zeros(1, dtype=np.int64)]
    total = 0
    for i, j in slices(offsets):
        own = data[offsets[i]:offsets[j]]
        s, e, at = words(own, offsets[i:j + 1] - offsets[i])
        parts.append(word_hashes(own, s, e))
        first.append(at[1:] + total)
        total += len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=U)), np.concatenate(first)


def runs(values: np.ndarray, first: np.ndarray, width: int, second: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of each run of ``width`` words within one text, the index of its first word, and its text.

    ``first`` has the number of words before each text.  With ``second``, an independent second hash comes too.
    """
    counts = np.maximum(np.diff(first) - width + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][row] if len(row) else row
    out = [mix(range_hashes(prefix_sums(values, _WORD_BASE), start, start + width, _WORD_BASE) + U(width))]
    if second:
        out.append(mix(range_hashes(prefix_sums(mix(values ^ U(0x5851F42D4C957F2D)), _OTHER_BASE), start, start + width, _OTHER_BASE)))
    return *out, start, row
