"""Word hashes of whole Arrow string columns with numpy, for Python tasks.

Texts are never turned into Python strings. Work goes over pieces of a batch and
segments of a text, so memory follows the piece, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Lower-cased digits, letters and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Everything but ASCII white space.
SOLID = np.ones(256, dtype=bool)
SOLID[9:14] = SOLID[32] = False

_SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(
    0, 1 << 64, 256, dtype=np.uint64)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(column: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows with about ``size`` bytes, one row at least; with the first row's place."""
    n = len(column)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(
        zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < n:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield at, column.slice(at, stop - at)
        at = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, each ended by a line break, and where rows begin; null is empty."""
    column = pc.binary_join_element_wise(
        pc.fill_null(column, "").cast(pa.large_string()),
        pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64,
                           count=len(column) + 1 + column.offset)[column.offset:]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[bounds[0]:bounds[-1]]
    return data, bounds - bounds[0]


def word_hashes(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words, their first bytes and ends, and each row's first word."""
    hashes, starts, stops = [], [], []
    at, n = 0, len(data)
    power = inverse = np.empty(0, dtype=np.uint64)
    while at < n:
        stop = min(n, at + _SEGMENT)
        solid = is_word[_LOWER[data[at:stop]]]
        if stop < n:
            # Segments end behind a byte that is no word; a longer word makes a longer segment.
            gaps = np.flatnonzero(~solid)
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:
                while stop < n and is_word[_LOWER[data[stop]]]:
                    stop += 1
        low = _LOWER[data[at:stop]]
        solid = is_word[low]
        if len(power) < len(low) + 1:
            power = np.full(len(low) + 1, _BASE, dtype=np.uint64)
            inverse = np.full(len(low) + 1, _INVERSE, dtype=np.uint64)
            power[0] = inverse[0] = 1
            np.multiply.accumulate(power, out=power)
            np.multiply.accumulate(inverse, out=inverse)
        edge = np.diff(np.concatenate(([False], solid, [False])).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[low] * power[:len(low)], out=sums[1:])
        hashes.append(mix((sums[last] - sums[first]) * inverse[first]))
        starts.append(first + at)
        stops.append(last + at)
        at = stop
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    starts = join(starts, np.int64)
    return (join(hashes, np.uint64), starts, join(stops, np.int64),
            np.searchsorted(starts, bounds))


def beginnings(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the first ``size`` lower-cased bytes behind each start."""
    out = np.full(len(starts), size, dtype=np.uint64)
    for i in range(size):
        out = out * np.uint64(_BASE) + _BYTE[_LOWER[data[starts + i]]]
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of k words; a row of fewer, but not none, has one run."""
    step = np.uint64(0xD6E8FEB86659FD93)
    counts = np.diff(first)
    rows = np.repeat(np.arange(len(counts)), np.maximum(counts - k + 1, 0))
    n = len(hashes)
    if n >= k:
        runs = hashes[:n - k + 1].copy()
        for j in range(1, k):
            runs = mix(runs * step + hashes[j:n - k + 1 + j])
        place = np.arange(len(rows)) - np.repeat(
            np.cumsum(np.maximum(counts - k + 1, 0)) - np.maximum(counts - k + 1, 0),
            np.maximum(counts - k + 1, 0)) + first[:-1][rows]
        runs = runs[place]
    else:
        runs = np.empty(0, dtype=np.uint64)
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            run = hashes[first[short]]
            for j in range(1, m):
                run = mix(run * step + hashes[first[short] + j])
            rows, runs = np.concatenate((rows, short)), np.concatenate((runs, run))
    return rows, runs
