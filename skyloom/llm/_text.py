"""Vectorised byte-level text kernels shared by the operators.

All kernels work on one flat ``uint8`` buffer plus document offsets, so that a
batch of documents costs a fixed number of numpy passes and no per-word Python
objects.  Hashes are 64-bit prefix polynomial hashes: ``P[i]`` is the sum of
``T[b_j] * B**j`` over ``j < i`` and the hash of ``[s, e)`` is
``(P[e] - P[s]) * B**-s`` modulo 2**64, mixed.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_pow_cache: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word classes: bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` (after lower-casing)
#: and of ``[^\x20\x09-\x0D]``; UTF-8 continuation bytes belong to words in both.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[32] = False
NONSPACE[9:14] = False

CHUNK = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``B**i`` and ``B**-i`` for ``i <= n``."""
    have = _pow_cache.get("p")
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK + 4096)
        for key, base in (("p", _BASE), ("q", _INV)):
            out = np.full(size, U(base))
            out[0] = U(1)
            with np.errstate(over="ignore"):
                _pow_cache[key] = np.multiply.accumulate(out)
    return _pow_cache["p"], _pow_cache["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit (in place on a fresh array)."""
    h = h ^ (h >> U(31))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(32)
    return h


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    p, _ = powers(len(buf))
    out = np.empty(len(buf) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(_TABLE[buf] * p[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, q = powers(len(prefix))
    return (prefix[end] - prefix[start]) * q[start]


def ragged(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Ranges ``[a, b)`` of documents of about ``limit`` bytes; a longer document stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and ``first[d]``: the index of document d's first word (one more at the end)."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = inside[buf]
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = mask[:-1]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(buf)]] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[cuts[(cuts > 0)] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(span_hash(prefix_hash(buf), starts, ends)) if len(starts) else np.empty(0, np.uint64)


_COMBINE = [U(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25)]


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` consecutive word hashes (document bounds are the caller's)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * _COMBINE[j % 8] + U(j // 8)
        out = (out << U(7)) ^ (out >> U(57)) ^ out if k > 8 else out
    return mix(out)


def document_sets(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document, sorted within it, and offsets.

    A document of fewer than ``k`` words, but not none, has its whole sequence
    as its one shingle.
    """
    n_words = np.diff(first)
    docs = len(n_words)
    counts = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    offs = np.concatenate(([0], np.cumsum(counts)))
    if not offs[-1]:
        return np.empty(0, np.uint64), offs
    every = shingle_hashes(h, k)
    where = np.arange(offs[-1]) + np.repeat(first[:-1] - offs[:-1], counts)
    val = every[np.minimum(where, len(every) - 1)] if len(every) else np.zeros(offs[-1], np.uint64)
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):
        code = len(h[first[d] : first[d + 1]]) * 0x5851F42D4C957F2D
        for x in h[first[d] : first[d + 1]].tolist():
            code = (code * _BASE + x) % (1 << 64)
        val[offs[d]] = mix(np.array([code], np.uint64))[0]
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if b - a > 1:
            val[a:b].sort()
    keep = np.ones(len(val), bool)
    keep[1:] = val[1:] != val[:-1]
    keep[offs[:-1][counts > 0]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return val[keep], kept[offs]


def release() -> None:
    """Give freed memory back to the system, so that a reused worker stays small (glibc; elsewhere nothing happens)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
