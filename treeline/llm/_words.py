"""Vectorised hashing of words over Arrow string columns.

Words are maximal runs of bytes that a 256-entry table marks as word bytes. A word's hash is a polynomial in a random
value per byte, taken from prefix sums modulo 2**64, so that a batch of texts is hashed without a Python loop over words.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E6C63D0676A9A99 | 1
_INVERSE = pow(_BASE, -1, 2**64)
SHINGLE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TILE = 1 << 19
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, _TILE), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, null as empty, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def spans(data: np.ndarray, at: np.ndarray, stop: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 offsets of each row's words. `stop` marks the bytes between words."""
    word = ~stop[data]
    if not len(word):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(len(at), np.int64),)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, at)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, given in order of place; with `lower`, A-Z count as a-z."""
    out, table, i = np.empty(len(start), np.uint64), _LOWER if lower else _BYTE, 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _TILE, "right")))
        lo, hi = start[i], end[j - 1]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * _power(_BASE, hi - lo), out=sums[1:])
        a, b = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (sums[b] - sums[a]) * _power(_INVERSE, hi - lo)[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(some, inverse): places of one occurrence of each distinct word, ascending, and each word's place among them."""
    _, some, inverse = np.unique(hashes(data, start, end), return_index=True, return_inverse=True)
    order = np.argsort(some)
    place = np.empty(len(some), np.int64)
    place[order] = np.arange(len(some))
    return some[order], place[inverse]


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its runs of `width` words; a shorter text is one run as a whole."""
    data, at = column_bytes(column)
    start, end, rows = spans(data, at)
    words = hashes(data, start, end)
    n = max(0, len(words) - width + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(width):
        runs += words[k : k + n] * SHINGLE[k]
    runs = mix(runs)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            whole = (words[a:b] * SHINGLE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def trim() -> None:
    """Give freed memory back, as workers live on between tasks and the driver after training."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of a batch, or `column.field` of a struct."""
    column, _, inner = name.partition(".")
    return pc.struct_field(batch.column(column), inner) if inner else batch.column(column)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The batch in runs of rows of about `most` bytes of `column` (or `column.field`); a longer row is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(field(batch, column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)
    trim()
