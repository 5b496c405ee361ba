"""Flat numpy views of text columns, used inside tasks.

An Arrow string column is one byte buffer with offsets. Everything here works
on such a buffer for many documents at a time: words, hashes of words and of
windows, and windows' minima. Slices bound the memory, whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE = 1 << 18  # units (bytes or words) handled at once
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    _, offsets, data = column.buffers()[:3]
    if n == 0 or offsets is None:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none
    at = np.frombuffer(offsets, kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at[:-1], at[1:]


def row_slices(starts: np.ndarray, ends: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer row stands alone."""
    n = len(starts)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(ends, starts[lo] + limit, side="right"))
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


@lru_cache(maxsize=2)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    base, inverse = _BASE, pow(_BASE, -1, 1 << 64)
    up, down = np.empty(n, U64), np.empty(n, U64)
    for out, b in ((up, base), (down, inverse)):
        out[0] = 1
        size = 1
        factor = b
        while size < n:
            more = min(size, n - size)
            out[size : size + more] = out[:more] * U64(factor)
            factor = factor * factor % (1 << 64)
            size += more
    return up, down


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _room(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers up to n at least; a process keeps one table, the longest it needed."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        _POWERS[:] = [powers(max(n + n // 8, 1 << 16))]
    return _POWERS[0]


class Hashes:
    """Hashes of any substring of a sequence of 64-bit units."""

    def __init__(self, units: np.ndarray):
        up, self._down = _room(len(units) + 1)
        self.prefix = np.zeros(len(units) + 1, U64)
        np.cumsum(units * up[: len(units)], out=self.prefix[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of units [first, last), the same wherever the substring stands."""
        return mix((self.prefix[last] - self.prefix[first]) * self._down[first])

    def grams(self, q: int) -> np.ndarray:
        """Hashes of all q units in a row."""
        n = len(self.prefix) - 1 - q + 1
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.prefix[q:] - self.prefix[:n]) * self._down[:n])


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Words ``[^\\x20\\x09-\\x0D]+`` of rows that lie one after the other.

    Returns (first byte, end byte, row) of each, in order; positions are
    relative to ``starts[0]``.
    """
    if len(starts) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    low = int(starts[0])
    inside = ~_SPACE[data[low : int(ends[-1])]]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    if len(inside) and inside[-1]:
        edges = np.concatenate([edges, [len(inside)]])
    # Begins and ends of words take turns.
    begins, stops = edges[::2], edges[1::2]
    cuts = np.unique(np.concatenate([starts - low, ends - low]))
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    # A cut between two rows ends a word and starts the next one.
    cuts = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts
    if len(cuts):
        begins = np.sort(np.concatenate([begins, cuts]))
        stops = np.sort(np.concatenate([stops, cuts]))
    row = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(begins, ends - low), prepend=0))
    return begins.astype(np.int64), stops.astype(np.int64), row


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each word; ``first`` and ``last`` index into ``data``."""
    return Hashes(byte_values()[data]).of(first, last)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    pad = -len(values) % width
    block = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)])
    block = block.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_by_anchor(units: np.ndarray, seg_start: np.ndarray, seg_end: np.ndarray, q: int, window: int):
    """Windows of ``window`` units grouped by the anchor they share.

    A window's anchor is the leftmost of its q-grams with the least hash, so
    equal windows have it at the same offset. Segments are disjoint ranges of
    ``units`` in order; no window crosses one. Returns a dict of arrays, one
    element per run of consecutive windows with one anchor: ``segment``,
    ``anchor`` (its position), ``first`` and ``last`` (window starts),
    ``bucket`` (hash of the q-gram) and ``whole`` (hash of everything the run
    covers).
    """
    hashes = Hashes(units)
    grams = hashes.grams(q)
    width = window - q + 1
    n = len(units) - window + 1
    lengths = seg_end - seg_start
    keep = lengths >= window
    none = np.zeros(0, np.int64)
    if n <= 0 or not keep.any():
        return {k: none for k in ("segment", "anchor", "first", "last", "bucket", "whole")}
    bits = max(21, int(len(units)).bit_length())
    mask = U64((1 << bits) - 1)
    packed = (grams & ~mask) | np.arange(len(grams), dtype=U64)
    anchor = (sliding_min(packed, width) & mask).astype(np.int64)
    seg = np.flatnonzero(keep)
    count = lengths[seg] - window + 1
    segment = np.repeat(seg, count)
    start = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(seg_start[seg], count)
    own = anchor[start]
    change = np.flatnonzero((own[1:] != own[:-1]) | (segment[1:] != segment[:-1])) + 1
    begin = np.concatenate([[0], change])
    end = np.concatenate([change, [len(own)]]) - 1
    first, last, at = start[begin], start[end], own[begin]
    whole = mix(hashes.of(first, last + window) ^ mix(((at - first).astype(U64) << U64(32)) | (last - first).astype(U64)))
    return {
        "segment": segment[begin],
        "anchor": at,
        "first": first,
        "last": last,
        "bucket": grams[at],
        "whole": whole,
    }


def pieces(starts: np.ndarray, ends: np.ndarray, overlap: int, limit: int = SLICE):
    """Cut rows into runs of about ``limit`` units, as (row, start, end) arrays.

    A row longer than ``limit`` comes in several pieces that share ``overlap``
    units, so that each window of ``overlap`` + 1 units lies in exactly one
    piece as a window start.
    """
    step = limit - overlap
    for lo, hi in row_slices(starts, ends, limit):
        if hi - lo > 1 or ends[lo] - starts[lo] <= limit:
            yield np.arange(lo, hi), starts[lo:hi], ends[lo:hi]
            continue
        at = int(starts[lo])
        while True:
            stop = min(at + limit, int(ends[lo]))
            yield np.array([lo]), np.array([at]), np.array([stop])
            if stop == ends[lo]:
                break
            at += step


def merge_spans(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges, sorted; touching ranges join."""
    if len(first) == 0:
        return first, end
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], first[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return first[at], end[np.concatenate([at[1:] - 1, [len(end) - 1]])]
