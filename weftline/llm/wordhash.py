"""Vectorised word splitting and hashing of Arrow string columns.

Works on the UTF-8 bytes of a whole Arrow batch: a byte table says which bytes
belong to words and how they are folded, and polynomial prefix sums give every
word's hash without a Python object for each word.  There are two, modulo 2**64
and modulo a prime, as long words that share the first can be built on purpose.
The hashes are for finding candidates; what must be equal is compared as words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
_libc = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None
_TABLE = np.random.default_rng(73_019).integers(1, 2**64 - 1, 256, dtype=U64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes hashed at a time; the work arrays and the tables of powers, which workers keep, take about 64 bytes for each.
PIECE = 1 << 18
_powers: dict[int, np.ndarray] = {}
#: The second polynomial's modulus, base and byte values.
_PRIME = 2**31 - 1
_BASE2 = 1_220_703_125
_TABLE2 = np.random.default_rng(51_487).integers(1, _PRIME, 256, dtype=U64)


@dataclass(frozen=True)
class Words:
    """Which bytes are word bytes, and what each byte counts as."""

    is_word: np.ndarray
    fold: np.ndarray


def _fold_ascii() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


def _spaces() -> np.ndarray:
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return word


def _letters() -> np.ndarray:
    word = np.zeros(256, bool)
    word[0x30:0x3A] = word[0x41:0x5B] = word[0x61:0x7B] = word[0x80:] = True
    return word


#: Words between ASCII white space, unchanged.
RAW = Words(_spaces(), np.arange(256, dtype=np.uint8))
#: Words between ASCII white space, A-Z lower-cased.
LOWER = Words(_spaces(), _fold_ascii())
#: Runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased.
ALNUM = Words(_letters(), _fold_ascii())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), base, U64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
        if len(have) > 2 * PIECE:  # one enormous word: don't hold on to its table
            _powers.pop(base)
    return have


def _prime_power(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1 modulo the prime."""
    have = _powers.get(-base, np.ones(1, U64))
    while len(have) < n:
        have = np.concatenate([have, have * U64(pow(base, len(have), _PRIME)) % U64(_PRIME)])
    if len(have) <= 2 * PIECE:
        _powers[-base] = have
    return have


def _prime_hashes(data: np.ndarray, table: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The second polynomial of the words that lie at these places of ``data``."""
    n = len(data)
    value = table[data] * _prime_power(_BASE2, n)[:n]
    sums = np.zeros(n + 1, U64)
    np.cumsum((value & U64(_PRIME)) + (value >> U64(31)), out=sums[1:])  # below 2**32 each
    return (sums[end] - sums[start]) % U64(_PRIME) * _prime_power(pow(_BASE2, -1, _PRIME), n)[start] % U64(_PRIME)


@dataclass
class Batch:
    """Words of a batch: byte limits, hashes, and the first word of each document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one more entry than documents

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def last(self) -> np.ndarray:
        """For each word, the end of its document's words."""
        return np.repeat(self.first[1:], self.counts())


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the limits of its rows; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    if len(col) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def split(col: pa.Array, words: Words) -> Batch:
    data, at = text_bytes(col)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Batch(data, none, none, np.zeros(0, U64), np.zeros(len(at), np.int64))
    inside = words.is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    table, table2 = _TABLE[words.fold], _TABLE2[words.fold]
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum(table[data[lo:hi]] * _power(_BASE, hi - lo)[: hi - lo], out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * _power(_INVERSE, hi - lo)[s]) + _prime_hashes(data[lo:hi], table2, s, e) * U64(0x9E3779B97F4A7C15)
        i = j
    return Batch(data, start, end, mix(out), np.searchsorted(start, at))


def shingles(batch: Batch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words and the first of each document.

    A document of fewer words, but not none, has one: its whole sequence.
    """
    n = len(batch.hash)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(batch.first), np.int64)
    index, last = np.arange(n), batch.last()
    padded = np.concatenate([batch.hash, np.zeros(k, U64)])
    total = np.zeros(n, U64)
    for j in range(k):
        part = padded[j : j + n] if j == 0 else np.where(index + j < last, padded[j : j + n], U64(0))
        total = total * U64(0xD6E8FEB86659FD93) + part
    valid = index + k <= last
    counts = batch.counts()
    short = batch.first[:-1][(counts > 0) & (counts < k)]
    valid[short] = True
    before = np.zeros(n + 1, np.int64)
    np.cumsum(valid, out=before[1:])
    return mix(total)[valid], before[batch.first]


def trim() -> None:
    """Give freed memory back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(rb: pa.RecordBatch, col: int = 0, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts in ``col`` hold about ``limit`` bytes; a longer text is a run of its own."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(rb.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < rb.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        to = min(to, at + 4096, rb.num_rows)
        yield rb.slice(at, to - at)
        at = to
    trim()
