"""Text columns as flat numpy arrays: words, their 64-bit hashes and n-gram hashes, without a Python loop per word.

Arrow hands over one byte buffer for a whole batch, so words and hashes are found for all its documents at
once. Batches are cut into slices of a few megabytes, which bounds the memory of a task whatever the rows hold.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def _give_back_memory() -> None:
    """Let a worker return the buffers of a slice to the system at once, so that stages after it start small."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # blocks of 1 MB and more are mapped, and unmapped when freed
    except (OSError, AttributeError):
        pass  # another C library


_give_back_memory()
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: tuple[np.ndarray, np.ndarray] | None = None
#: A prime, and for each of two hashes modulo it a base and the values of the bytes.
_PRIME, _31 = np.uint64(2**31 - 1), np.uint64(31)
_BASES = [int(b) for b in _rng.integers(2**20, 2**31 - 2, 2)]
_VALUES = _rng.integers(1, 2**31 - 1, (2, 256), dtype=np.uint64)
_VALUES_FOLDED = _VALUES.copy()
_VALUES_FOLDED[:, 65:91] = _VALUES[:, 97:123]
_prime_powers: list[tuple[np.ndarray, np.ndarray]] = []

#: Words of a document: whatever is not blank.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, *range(9, 14)]] = False
#: Words of a benchmark: digits, letters and all that is not ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling base and of its inverse, modulo 2^64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 65536)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the named text column of each piece has about that many bytes; a long text stays whole."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row starts (one more entry than rows); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def rough_sums(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """Running sums of byte values times powers of a base, modulo 2^64: quick, for rolling windows and short spans whose bytes are compared or don't matter."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_FOLDED if fold else _BYTE)[data] * powers(len(data))[0], out=sums[1:])
    return sums


def rough_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span. Modulo 2^64 there are words of 1,024 letters that meet whatever the base is: never take it for equality of long spans."""
    down = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * down[start] ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _reduced(x: np.ndarray) -> np.ndarray:
    """Values below 2^63 modulo the prime, or the prime itself for 0."""
    x = (x & _PRIME) + (x >> _31)
    return (x & _PRIME) + (x >> _31)


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = _reduced(out[:more] * np.uint64(step))
        done, step = done + more, step * step % int(_PRIME)
    return out


def prime_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the two bases, the first n powers of it and of its inverse modulo the prime."""
    global _prime_powers
    if not _prime_powers or len(_prime_powers[0][0]) < n:
        size = max(n, SLICE_BYTES + 65536)
        _prime_powers = [(_powers_of(b, size), _powers_of(pow(b, -1, int(_PRIME)), size)) for b in _BASES]
    return _prime_powers


def prefix_hash(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """Two rows of running sums of byte values times powers of a base modulo a prime; differences identify the bytes between."""
    sums = np.zeros((2, len(data) + 1), np.uint64)
    for out, (up, _), values in zip(sums, prime_powers(len(data)), _VALUES_FOLDED if fold else _VALUES, strict=True):
        terms = values[data]
        terms *= up[: len(data)]
        np.cumsum((terms & _PRIME) + (terms >> _31), out=out[1:])  # each below 2^33
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, wherever it stands: 62 bits of two hashes modulo a prime, and the length."""
    both = np.zeros(len(start), np.uint64)
    for row, (_, down) in zip(sums, prime_powers(sums.shape[1]), strict=True):
        value = _reduced(_reduced(row[end] - row[start]) * down[start])
        both = (both << _31) ^ np.where(value >= _PRIME, value - _PRIME, value)
    return mix(both ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of a slice: byte spans, hashes with A-Z folded, and where each row's words start; rough hashes where words are only dealt into buckets."""

    def __init__(self, column: pa.Array, letters: np.ndarray = NOT_BLANK, rough: bool = False):
        self.data, self.rows = flat(column)
        inside = letters[self.data]
        opens, closes = inside.copy(), inside.copy()
        if len(inside):
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            edges = self.rows[1:-1]
            edges = edges[(edges > 0) & (edges < len(inside))]
            opens[edges] = inside[edges]
            closes[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.rows)
        self.sums = (rough_sums if rough else prefix_hash)(self.data, fold=True)
        self.hash = (rough_hash if rough else span_hash)(self.sums, self.start, self.end)

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes().lower()


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive values."""
    out = hashes[: max(0, len(hashes) - n + 1)].copy()
    for k in range(1, n):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + hashes[k : k + len(out)]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
