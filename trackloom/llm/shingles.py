"""Word and shingle hashes of whole Arrow text batches, in numpy.

Words are the byte runs ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered. Texts
are worked through in stretches of bounded size, cut at white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STRETCH = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below a power of two that holds n."""
    size = max(STRETCH * 2, 1 << n.bit_length())
    if size not in _tables:
        _tables.clear()
        base = int(_BASE)
        _tables[size] = (_powers(base, size), _powers(pow(base, -1, 1 << 64), size))
    return _tables[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _hash_words(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the words of ``data``; no word spans a place of ``starts_at``."""
    low = _LOWER[data]
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    forced = starts_at[starts_at < len(data)]
    first[forced] = solid[forced]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    begin = np.flatnonzero(first)
    end = np.flatnonzero(last)
    power, inverse = _power_tables(len(data))
    total = np.cumsum((low.astype(np.uint64) + _U(1)) * power[: len(data)], dtype=np.uint64)
    before = np.where(begin > 0, total[begin - 1], _U(0))
    return mix((total[end] - before) * inverse[begin]), begin


def _cut(data: np.ndarray, at: int) -> int:
    """A place not before ``at`` where no word is cut."""
    while at < len(data):
        gaps = np.flatnonzero(_SPACE[data[at : at + STRETCH]])
        if len(gaps):
            return at + int(gaps[0])
        at += STRETCH
    return len(data)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8), offsets


def word_hashes(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, word offsets of the rows) for stretches of whole rows."""
    data, offsets = text_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + STRETCH, side="right")) - 1
        stop = min(n, max(row + 1, stop))
        lo, hi = int(offsets[row]), int(offsets[stop])
        if hi - lo <= 2 * STRETCH:
            words, begin = _hash_words(data[lo:hi], offsets[row:stop] - lo)
            places = np.searchsorted(begin, offsets[row : stop + 1] - lo)
        else:  # one long row
            parts, at = [], lo
            while at < hi:
                to = lo + _cut(data[lo:hi], at - lo + STRETCH)
                parts.append(_hash_words(data[at:to], np.zeros(1, np.int64))[0])
                at = to
            words = np.concatenate(parts)
            places = np.array([0, len(words)])
        yield row, words, places
        row = stop


def shingle_hashes(words: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each row; a row with fewer words gives its whole sequence."""
    counts = np.diff(places)
    if len(words) == 0:
        return words, places
    run = words.copy()
    for k in range(1, size):
        nxt = np.zeros_like(words)
        nxt[:-k or None] = words[k:] if k < len(words) else 0
        run = mix(run * _BASE + nxt)
    inside = np.ones(len(words), dtype=bool)
    row_of = np.repeat(np.arange(len(counts)), counts)
    inside &= np.arange(len(words)) + size <= places[1:][row_of]
    short = np.flatnonzero((counts > 0) & (counts < size))
    for r in short:
        value = np.array([counts[r]], dtype=np.uint64)
        for at in range(places[r], places[r + 1]):
            value = mix(value * _BASE + words[at : at + 1])
        run[places[r]] = value[0]
        inside[places[r]] = True
    kept = np.concatenate([[0], np.cumsum(inside)])
    return run[inside], kept[places]
