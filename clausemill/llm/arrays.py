"""Byte-level tokenising and hashing of Arrow string columns with numpy.

Every boundary that the operators know (ASCII space, ASCII punctuation, line
feed) is a single byte in UTF-8 and never part of a longer sequence, so whole
batches are cut into words without decoding.  All functions work on a slice of
a batch of bounded size, whatever the length of single texts.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_P = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_P_INVERSE = pow(_P, -1, 1 << 64)


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words that ASCII white space separates.
NOT_SPACE = ~_bytes_in((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words made of digits, letters and everything beyond ASCII, after lower-casing.
WORD = _bytes_in((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


#: What a worker keeps from one task to the next, by owner.
held: dict[str, object] = {}


def release(owner: str = "") -> None:
    """Gives memory that earlier tasks of this worker have left back to the system, but for what the owner keeps."""
    for name in [n for n in held if n != owner]:
        del held[name]
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def bounded(run: Callable) -> Callable:
    """A function over a task's batches that gives memory back before the first and after the last, for workers outlive their tasks."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        release()
        yield from run(batches)
        release()

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * _GOLDEN)
_STEP = mix(np.arange(1, 65, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, U64(base), U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


#: Bytes of texts at once where a worker holds much besides; hashing them takes some forty times as many.
FEW_BYTES = 250_000


def slices(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about `most` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    content = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, content[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def packed(texts: pa.Array) -> pa.Array:
    """Texts compressed one by one, as they are sent: well below what the compression of shuffled blocks leaves."""
    press = zstandard.ZstdCompressor(level=3).compress
    return pa.array([press(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def unpacked(column: pa.Array) -> pa.Array:
    """Texts that `packed` gave."""
    open_ = zstandard.ZstdDecompressor().decompress
    return pa.array([open_(t) for t in column.to_pylist()], pa.large_binary()).cast(pa.large_string())


def words(content: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words."""
    inside = table[content]
    edge = np.zeros(len(content) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(content: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: differences of one running sum."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(content) + 1, U64)
        np.cumsum(_BYTE[content] * _power(_P, len(content)), out=total[1:])
        inverse = _power(_P_INVERSE, len(content) + 1)
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64) * _GOLDEN)


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of k words of a row; a row of fewer words, but not none, gives one."""
    with np.errstate(over="ignore"):
        m = len(hashes) - k + 1
        if m > 0:
            whole = rows[:m] == rows[k - 1 :]
            at = np.flatnonzero(whole)
            value = np.zeros(len(at), U64)
            for j in range(k):
                value += hashes[at + j] * _STEP[j]
            value, row = mix(value), rows[at]
        else:
            value, row = np.zeros(0, U64), np.zeros(0, np.int64)
        count = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
        first = np.cumsum(count) - count
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            short = np.zeros(len(few), U64)
            for j in range(k - 1):
                some = count[few] > j
                short[some] += hashes[first[few[some]] + j] * _STEP[j]
            short = mix(short + count[few].astype(U64) * _GOLDEN)
            value, row = np.concatenate([value, short]), np.concatenate([row, few])
            order = np.argsort(row, kind="stable")
            value, row = value[order], row[order]
    return value, row


def distinct(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, value) once, ordered by row and then by value."""
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[new], row[new]
    return value, row


def row_sums(value: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Sum of the values of each row modulo 2**64; rows are in order."""
    total = np.zeros(len(value) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(value, out=total[1:])
        bound = np.searchsorted(row, np.arange(n_rows + 1))
        return total[bound[1:]] - total[bound[:-1]]
