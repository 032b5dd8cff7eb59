"""Recompression of word sequences: a grammar whose symbols mean the same everywhere.

Round 0 names runs of an equal token, the later rounds name pairs: a round
deals all symbols to a left and a right class by a hash of their name, and each
left symbol followed by a right one becomes a new symbol.  Names are hashes of
what they stand for, so all tasks give equal sequences equal names.

A symbol carries the span of words that its existence depends on.  When that
span lies inside a passage, every copy of the passage has the same symbol at
the same place, whatever surrounds the copy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from weftline.llm.wordhash import mix

U64 = np.uint64


@dataclass
class Symbols:
    name: np.ndarray
    start: np.ndarray  # words covered
    end: np.ndarray
    low: np.ndarray  # words depended on
    high: np.ndarray


def _merge(s: Symbols, head: np.ndarray, doc: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray, left: np.ndarray, right: np.ndarray, salt: int) -> tuple[Symbols, np.ndarray]:
    """Join each symbol that isn't a head to the one before it.

    left, right: whether a symbol's fate depended on the neighbour on that side.
    """
    n = len(s.name)
    prev_low = np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), doc_start[doc] - 1, np.concatenate([[0], s.low[:-1]]))
    next_high = np.where(np.concatenate([doc[1:] != doc[:-1], [True]]), doc_end[doc] + 1, np.concatenate([s.high[1:], [0]]))
    low = np.where(left, np.minimum(s.low, prev_low), s.low)
    high = np.where(right, np.maximum(s.high, next_high), s.high)
    at = np.flatnonzero(head)
    count = np.diff(np.append(at, n))
    name = s.name[at].copy()
    several = count > 1
    if several.any():
        first = at[several]
        name[several] = mix(s.name[first] * U64(0x9E3779B97F4A7C15) + mix(s.name[first + 1] + U64(salt)) + count[several].astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    ends = np.append(at[1:], n) - 1
    return Symbols(name, s.start[at], s.end[ends], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)), doc[at]


def parse(hashes: np.ndarray, first: np.ndarray, rounds: int, longest: int) -> Symbols:
    """Symbols of at most ``longest`` words after one run round and ``rounds`` pair rounds."""
    n = len(hashes)
    index = np.arange(n)
    s = Symbols(hashes, index, index + 1, index, index + 1)
    if n == 0:
        return s
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin, end = first[:-1], first[1:]
    same = np.zeros(n, bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    run = np.append(np.flatnonzero(~same), n)
    length = np.repeat(np.diff(run), np.diff(run))
    everywhere = np.ones(n, bool)  # each symbol is where it is as its neighbours differ
    s, doc = _merge(s, ~same | (length > longest), doc, begin, end, everywhere, everywhere, 0)
    cut = np.flatnonzero(length[s.start] > longest)  # left single as the whole run is too long, so they depend on all of it
    which = np.searchsorted(run, s.start[cut], "right")
    s.low[cut], s.high[cut] = run[which - 1] - 1, run[which] + 1
    for r in range(1, rounds + 1):
        is_left = (mix(s.name + U64(r * 0x51ED27)) >> U64(63)).astype(bool)
        size = s.end - s.start
        joins = np.zeros(len(size), bool)
        joins[:-1] = is_left[:-1] & ~is_left[1:] & (doc[:-1] == doc[1:]) & (size[:-1] + size[1:] <= longest)
        joined = np.concatenate([[False], joins[:-1]])
        s, doc = _merge(s, ~joined, doc, begin, end, ~is_left & ~joined, is_left & ~joins, r)
    return s


#: Symbols whose windows are marked at a time.
_AT_ONCE = 1 << 17


def anchors(s: Symbols, first: np.ndarray, window: int) -> np.ndarray:
    """For each word, the anchor of the window that starts there, or -1: a place in ``s``.

    That is, of the symbols that depend on words inside the window only, the
    longest, of these the one of the greatest scrambled name, and of equal ones
    the last.  Copies of a window hold the same such symbols at the same places,
    so all have the same anchor.
    """
    out = np.full(int(first[-1]), -1, np.int64)
    counts = np.diff(first)
    begin, last = np.repeat(first[:-1], counts), np.repeat(first[1:], counts) - window
    low, high = np.maximum(s.high - window, begin[s.start]), np.minimum(s.low, last[s.start])  # starts of the windows around a symbol
    some = np.flatnonzero(high >= low)
    rank = ((s.end - s.start)[some].astype(U64) << U64(56)) | (mix(s.name[some]) >> U64(8))
    order = some[np.argsort(rank, kind="stable")]
    for i in range(0, len(order), _AT_ONCE):
        part = order[i : i + _AT_ONCE]
        n = high[part] - low[part] + 1
        out[np.arange(int(n.sum())) + np.repeat(low[part] - (np.cumsum(n) - n), n)] = np.repeat(part, n)  # the last one stays
    return out


def unproven(anchor: np.ndarray, first: np.ndarray, window: int, sole: np.ndarray) -> np.ndarray:
    """For each word, whether the window that starts there may have a copy.

    sole: for each symbol, whether it is an anchor whose name no other anchor
    has.  A window with such an anchor has no copy, which would have it too; any
    other whole window, also one without an anchor, may have.
    """
    last = np.repeat(first[1:], np.diff(first))
    return (np.arange(len(anchor)) + window <= last) & ~np.append(sole, False)[anchor]
