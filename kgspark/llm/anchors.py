"""Anchors: places of a text that every repeated window has in common.

A text is an array of unit hashes (bytes or words). Of every window of ``window``
units, the run of ``gram`` units with the least hash is its anchor (the first, if
several are least). The choice depends on the window alone, so two equal windows
have their anchor at the same place, and all windows of an anchor are adjacent:
they make its context. Texts are cut into overlapping pieces, so that memory does
not grow with a text; a context that is cut there only becomes two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PLACE_BITS = 21
PIECE = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, factor: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` units."""
    n = len(units) - gram + 1
    if gram <= 8:
        out = np.zeros(n, np.uint64)
        for i in range(gram):
            out = out * np.uint64(_FACTOR) + units[i:n + i]
        return mix(out)
    # Sums of units times falling powers; a difference of sums, raised, is a run's hash.
    size = 1 << max(12, int(len(units)).bit_length())
    if size not in _tables:
        _tables[size] = _powers(size, pow(_FACTOR, -1, 1 << 64)), _powers(size, _FACTOR)
    down, up = _tables[size]
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * down[:len(units)], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * up[:n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by minima from block borders."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors(units: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, place, first, last) arrays: anchors with their first and last window's start."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    for start in range(0, len(units) - window + 1, PIECE):
        part = units[start:start + PIECE + window - 1]
        keys = gram_hashes(part, gram)
        ranked = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
        place = (_least(ranked, window - gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        at = place[first]
        yield mix(keys[at] + np.uint64(1)).view(np.int64), at + start, first + start, last + start
