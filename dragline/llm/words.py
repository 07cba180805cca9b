"""Hashes of all words of a batch of texts at once.

A word's hash is a polynomial over random byte values modulo 2^64, taken from running sums and then mixed, so a batch
costs a few array operations a byte, with no string and no dictionary for any word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20  # bytes hashed at once; only a longer word makes a longer piece
_rng = np.random.default_rng(7)
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything ASCII that is no letter or digit parts words, too.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWERED = _VALUES.copy()
_LOWERED[65:91] = _VALUES[97:123]


def mixed(z: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit numbers over all bits."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2^64, by doubling."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


_tables: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    if len(_tables.get(base, ())) < n:
        _tables[base] = _powers(base, max(n, _BLOCK))
    return _tables[base]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, end to end, and where each text begins (one entry more than texts)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = column.cast(pa.large_binary())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    body = large.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray):
    """(begin, bytes, text borders inside) of stretches of about a block that cut no word, however long a text is."""
    low = 0
    while low < len(data):
        size, high = _BLOCK, 0
        while not high:
            end = low + size
            if end >= len(data):
                high = len(data)
            elif len(found := np.flatnonzero(parts[data[end - min(size, 4096) : end]])):
                high = end - min(size, 4096) + int(found[-1]) + 1
            elif (border := int(offsets[np.searchsorted(offsets, end, side="right") - 1])) > low:
                high = border
            size *= 2
        yield low, data[low:high], offsets[np.searchsorted(offsets, low, side="right") : np.searchsorted(offsets, high)] - low
        low = high


def spans(data: np.ndarray, borders: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a piece begin and end; texts meet at ``borders`` without a separator."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~parts[data]
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    torn = borders[inside[borders] & inside[borders + 1]]
    begins[torn] = True
    ends[torn] = True
    return np.flatnonzero(begins), np.flatnonzero(ends)


def running(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hashes`` takes the hash of any span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_LOWERED[data] * _table(_BASE, len(data))[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((sums[last] - sums[first]) * _table(_INVERSE, len(sums))[first])


def word_hashes(column: pa.Array, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (uint64) of the words of a binary column without nulls, A-Z lowered, and where each text's words begin.

    ``parts``: for each byte value, whether it parts words.  The second array has one entry more than the column.
    """
    data, offsets = column_bytes(column)
    hashes, begins = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, piece, borders in pieces(data, offsets, parts):
        first, last = spans(piece, borders, parts)
        hashes.append(span_hashes(running(piece), first, last))
        begins.append(first + low)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets)
