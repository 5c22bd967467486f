"""Words of many texts at once, as 64-bit hashes in numpy arrays.

The texts of a batch lie one after another in Arrow's buffer, so words are found and
hashed by array operations over the bytes, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

WHITE = (0x20, *range(0x09, 0x0E))
_FACTOR = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD1342543DE82EF95)
#: Bytes that are summed at a time: what a long text needs besides does not grow with it.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64 over all others; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_case() -> np.ndarray:
    """Byte -> byte, A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_FACTOR, -1, 1 << 64)
    ones = np.ones(size, np.uint64)
    up, down = ones * np.uint64(_FACTOR), ones * np.uint64(inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, (size - 1).bit_length()))


@dataclass
class Words:
    """Words of ``n`` texts: hashes, and where each text's words begin (n + 1 bounds)."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray  # of each word, in the bytes
    stops: np.ndarray

    def texts(self) -> np.ndarray:
        """For each word the text that has it."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def find_words(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, letters: np.ndarray | None = None
) -> Words:
    """``data``: bytes; ``offsets``: where each text begins, and the end; ``inside``:
    for each byte whether it belongs to a word; ``letters``: what each byte counts as, by
    default with A-Z in lower case.  Words never cross texts."""
    letters = lower_case() if letters is None else letters
    within = np.zeros(len(data) + 1, bool)
    within[:-1] = inside[data]
    before = np.concatenate([[False], within[:-1]])
    before[offsets] = False
    starts = np.flatnonzero(within & ~before)
    last = np.concatenate([within[1:], [False]])
    cut = offsets[1:][offsets[1:] > 0] - 1
    last[cut] = False
    stops = np.flatnonzero(within & ~last) + 1
    hashes = _span_hashes(data, letters, starts, stops)
    return Words(mix(hashes), np.searchsorted(starts, offsets), starts, stops)


def _span_hashes(data, letters, starts, stops) -> np.ndarray:
    """Polynomial hashes of ordered spans, by running sums over a piece of bytes at a time."""
    up, down = _powers(PIECE)
    rise, fall = pow(_FACTOR, PIECE, 1 << 64), pow(_FACTOR, -PIECE, 1 << 64)
    found = np.zeros(len(starts), np.uint64)
    total, scale, back = np.uint64(0), 1, 1
    for begin in range(0, len(data), PIECE):
        part = letters[data[begin : begin + PIECE]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        sums = total + sums * np.uint64(scale)
        # A span that ends with a piece ends in it; one that begins after it, in the next.
        own = slice(*np.searchsorted(starts, [begin, begin + len(part)]))
        found[own] -= sums[starts[own] - begin]
        ended = slice(*np.searchsorted(stops, [begin + 1, begin + len(part) + 1]))
        found[ended] += sums[stops[ended] - begin]
        total, scale = sums[-1], scale * rise % (1 << 64)
    for begin in range(0, len(data), PIECE):
        own = slice(*np.searchsorted(starts, [begin, begin + PIECE]))
        found[own] *= down[starts[own] - begin] * np.uint64(back)
        back = back * fall % (1 << 64)
    return found


def word_bytes(outside: bytes) -> np.ndarray:
    """For each byte whether it belongs to a word, given those that do not."""
    inside = np.ones(256, bool)
    inside[list(outside)] = False
    return inside


def text_chunks(
    column: pa.Array, limit: int = 1 << 20
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about ``limit`` bytes together.

    A null text is an empty one; a longer text is a run of its own.
    """
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        own = offsets[first : last + 1]
        yield first, last, data[own[0] : own[-1]], own - own[0]
        first = last


def _factors(width: int) -> np.ndarray:
    return _STEP * (np.arange(width, dtype=np.uint64) * np.uint64(2) + np.uint64(3))


def runs(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every run of ``width`` words within a text."""
    factors, h, texts = _factors(width), words.hashes, words.texts()
    size = max(0, len(h) - width + 1)
    total = np.full(size, width, np.uint64)
    for k in range(width):
        total += mix(h[k : k + size] * factors[k] + np.uint64(k))
    first = np.flatnonzero(texts[:size] == texts[width - 1 :])
    return mix(total[first]), first


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``width`` words, and of all words of a shorter text."""
    counts, texts = np.diff(words.bounds), words.texts()
    hashes, first = runs(words, width)
    found, owners = [hashes], [texts[first]]
    for size in range(1, width):
        if (counts == size).any():
            hashes, first = runs(words, size)
            whole = counts[texts[first]] == size
            found.append(hashes[whole])
            owners.append(texts[first][whole])
    return np.concatenate(found), np.concatenate(owners)


def distinct_sets(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each owner, sorted by owner and hash."""
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[fresh], owners[fresh]
