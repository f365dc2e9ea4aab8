"""Vector kernels over UTF-8 bytes and word sequences, shared by the operators that run on Arrow batches.

All hashes are polynomial in 64-bit wrap-around arithmetic over random byte values, from prefix sums, so any
substring's hash costs two reads and a multiplication. They only choose candidates or stand for words; 64 bits
make a false match of two texts of one corpus improbable (n^2 / 2^65).
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: Other byte values, for a second hash that fails independently of the first.
_BYTE2 = np.random.default_rng(20280229).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []
_libc = ctypes.CDLL(None)


def lean(run):
    """run, after which the worker gives memory back that it freed: it lives on for other tasks, beside the JVM's heap."""

    def trimmed(*tables):
        out = run(*tables)
        release()
        return out

    one = run.__code__.co_argcount == 1  # Spark asks for just so many arguments
    return (lambda table: trimmed(table)) if one else (lambda table, other: trimmed(table, other))


def release() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(_libc, "malloc_trim", None):  # glibc only
        trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
        _powers[:] = _powers[-2:]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash are fit for use."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text is a block of its own."""
    out, first = [], 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        out.append((first, last))
        first = last
    return out


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of 64-bit values, one more than there are values."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def window_hash(sums: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n values."""
    m = len(sums) - n
    return mix((sums[n:] - sums[:m]) * powers(len(sums))[1][:m]) if m > 0 else np.zeros(0, U64)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word (n + 1 of them)."""
    inside = ~_SEPARATOR[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    before[bounds] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[bounds - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, its start and end, and each text's first word."""
    start, end, first = word_spans(data, offsets)
    sums = prefix_sums(_BYTE[_LOWER[data] if lower else data])
    return span_hash(sums, start, end), start, end, first


def hash_values(tokens: np.ndarray, second: bool = False) -> np.ndarray:
    """What stands in hashes for tokens, which are bytes or words' hashes."""
    if tokens.dtype == np.uint8:
        return (_BYTE2 if second else _BYTE)[tokens]
    return mix(tokens ^ U64(0xA5A5A5A5A5A5A5A5)) if second else tokens


def pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit values: differences by byte plane, compressed."""
    steps = np.diff(values, prepend=U64(0)).astype("<u8")
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").reshape(-1), dtype=U64)
