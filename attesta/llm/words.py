"""Words of whole texts as 64-bit hashes, computed on the bytes of an Arrow column with numpy.

A word is a maximal run of bytes other than space and the controls 9 to 13; A-Z count as
a-z. Equal words have equal hashes; two different words share one with probability
2^-64, so hashes stand for words everywhere below. Null counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        steps = np.full(max(n, BLOCK + 1), base, dtype=np.uint64)
        steps[0] = 1
        known = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def _hash_block(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and last two bytes of the words of a block; ``breaks`` are starts of texts."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = (data != 32) & ((data < 9) | (data > 13))
    first = np.zeros(n + 1, dtype=bool)
    first[breaks] = True
    first[n] = True
    left_out = np.empty(n, dtype=bool)
    left_out[0] = True
    left_out[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (first[:n] | left_out))
    right_out = np.empty(n, dtype=bool)
    right_out[-1] = True
    right_out[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (first[1:] | right_out))
    low = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=sums[1:])
    value = (sums[ends + 1] - sums[starts]) * _power("down", _BASE_INVERSE, n)[starts]
    length = ends - starts + 1
    last = low[ends].astype(np.int64)
    before = np.where(length > 1, low[np.maximum(ends - 1, 0)], 0).astype(np.int64)
    return mix(value + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts, before * 256 + last


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows (one more than rows)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), at


def _long_text(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of one text that is larger than a block, block by block, cut at white space."""
    parts, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + BLOCK)
        while end < n:
            piece = data[at:end]
            gaps = np.flatnonzero((piece == 32) | ((piece >= 9) & (piece <= 13)))
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(n, end + BLOCK)
        parts.append(_hash_block(data[at:end], np.zeros(1, np.int64))[::2])
        at = end
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def word_runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word hashes, word offsets of the rows, last two bytes of each word) for runs of rows.

    A run holds at most BLOCK bytes, or one longer text, so memory does not grow with a batch.
    """
    data, at = buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        stop = int(np.searchsorted(at, at[row] + BLOCK, side="right")) - 1
        if stop <= row:
            hashes, tails = _long_text(data[at[row] : at[row + 1]])
            yield row, hashes, np.array([0, len(hashes)]), tails
            row += 1
            continue
        stop = min(stop, rows)
        base = int(at[row])
        bounds = at[row : stop + 1] - base
        full = np.flatnonzero(np.diff(bounds) > 0)
        hashes, starts, tails = _hash_block(data[base : at[stop]], bounds[full])
        yield row, hashes, np.searchsorted(starts, bounds), tails
        row = stop


def _combined(hashes: np.ndarray, width: int) -> np.ndarray:
    n = len(hashes) - width + 1
    total = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(width):
        total = (total + hashes[i : i + len(total)]) * np.uint64(_BASE)
    return mix(total)


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words in order; with fewer words the whole sequence as one."""
    if len(hashes) == 0:
        return np.empty(0, np.uint64)
    return _combined(hashes, min(width, len(hashes)))


def long_column(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))
