"""Hashes of byte windows, and content-chosen segments of windows, over slices of documents.

Every window of ``length`` bytes is given to the place in it where the hash of ``anchor``
bytes is least (leftmost among equals). That place depends on the window's bytes alone, so
equal windows, wherever they are, have equal anchors. Neighbouring windows mostly share their
anchor; a run of them is a segment, and a segment's hash stands
for all bytes that its windows cover.
"""

from __future__ import annotations

import numpy as np

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
_TABLE = (np.arange(1, 257, dtype=np.uint64) * _ODD[0]) ^ (np.arange(1, 257, dtype=np.uint64) * _ODD[1] >> np.uint64(23))
_PLACE = np.uint64(0xFFFFFFFF)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes in order."""
    out = right * _ODD[1]
    out ^= out >> np.uint64(29)
    out += left * _ODD[0]
    out *= _ODD[2]
    out ^= out >> np.uint64(32)
    return out


def hashes(data: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length, the hash of that many bytes at every place where they fit."""
    power = {1: _TABLE[data]}
    size = 1
    while 2 * size <= max(lengths):
        half = power[size]
        power[2 * size] = mixed(half[:-size], half[size:]) if len(half) > size else half[:0]
        size *= 2
    made = []
    for length in lengths:
        total, at = None, 0
        for bit in (b for b in sorted(power, reverse=True) if b & length):
            part = power[bit][at:]
            total = part if total is None else mixed(total[: len(part)], part)
            at += bit
        made.append(total[: max(0, len(data) - length + 1)])
    return made


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` values the place of the least, leftmost among equals."""
    packed = (values & ~_PLACE) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        packed = np.minimum(packed[:-size], packed[size:])
        size *= 2
    if size < width:
        packed = np.minimum(packed[: len(packed) - (width - size)], packed[width - size :])
    return (packed & _PLACE).astype(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """(row, first window, number of windows, bytes before the anchor, anchor hash, segment hash) of a slice's segments."""
    empty = np.zeros(0, np.int64)
    nothing = empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    if len(data) < length:
        return nothing
    at_anchor, whole = hashes(data, (anchor, length))
    place = least_places(at_anchor, length - anchor + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    fits = np.arange(len(place)) + length <= offsets[row + 1]
    starts = np.flatnonzero(fits)
    if not len(starts):
        return nothing
    new = np.r_[True, (place[starts[1:]] != place[starts[:-1]]) | (np.diff(starts) != 1) | (np.diff(row[starts]) != 0)]
    first = starts[new]
    count = np.diff(np.r_[np.flatnonzero(new), len(starts)])
    last = first + count - 1
    ahead = place[first] - first
    shape = ahead.astype(np.uint64) * _ODD[1] + count.astype(np.uint64)
    unit = mixed(mixed(whole[first], whole[last]), shape)
    return row[first], first - offsets[row[first]], count, ahead, at_anchor[place[first]], unit
