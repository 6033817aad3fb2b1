"""Words of many texts at once, as arrays: where they are, their hashes, and anchors chosen by content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_PIECE = 1 << 18
_FIRST, _SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(base: int) -> np.ndarray:
    powers = np.full(_PIECE, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _FIRST
    values = (values ^ (values >> np.uint64(27))) * _SECOND
    return values ^ (values >> np.uint64(31))


def text_chunks(column: pa.Array, size: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of stretches of a string column of about ``size`` bytes; no nulls."""
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    content = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, content[offsets[row]:offsets[to]], offsets[row:to + 1] - offsets[row]
        row = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and their total): words end where a text ends."""
    inside = ((data - np.uint8(9)) > 4) & (data != 32)
    edges = offsets[offsets < len(data)]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(data):
        after[-1] = False
    inner = edges[edges > 0]
    after[inner - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from differences of running polynomial sums."""
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + _PIECE, side="right"))
        if j <= i:
            hashes[i] = xxhash.xxh64_intdigest(data[base:ends[i]].tobytes())
            i += 1
            continue
        part = data[base:ends[j - 1]].astype(np.uint64)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * _UP[:len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        hashes[i:j] = (sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64)
        i = j
    return mixed(hashes)


def anchors(
    hashes: np.ndarray, firsts: np.ndarray, window: int, shingle: int, stretch: int = 1 << 20
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash) of runs of windows with the same anchor.

    ``firsts`` has the first word of each text, and the total. A window's anchor
    is its ``shingle``-word sequence of smallest hash, the leftmost of several,
    so equal windows have equal anchors. Every window within a text is in one
    run. Windows are numbered by their first word.
    """
    out = []
    lasts = np.repeat(firsts[1:], np.diff(firsts))
    span = window - shingle + 1
    for at in range(0, len(hashes), stretch):
        words = hashes[at:at + stretch + window - 1]
        n = len(words) - shingle + 1
        if n < span:
            continue
        values = words[:n].copy()
        for step in range(1, shingle):
            values = values * np.uint64(_BASE) + words[step:step + n]
        values = mixed(values)
        least, where, width = values, np.arange(n, dtype=np.int32), 1
        while width < span:
            shift = min(width, span - width)
            right = least[shift:] < least[:-shift]
            least = np.where(right, least[shift:], least[:-shift])
            where = np.where(right, where[shift:], where[:-shift])
            width += shift
        first = np.arange(at, at + len(where))
        own = np.flatnonzero(first + window <= lasts[at:at + len(where)])
        if not len(own):
            continue
        chosen = where[own]
        starts = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (own[1:] != own[:-1] + 1))))
        out.append((first[own[starts]], np.diff(np.append(starts, len(own))), values[chosen[starts]]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(parts) for parts in zip(*out))
