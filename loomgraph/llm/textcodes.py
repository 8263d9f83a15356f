"""Vectorised hashing of the words of many texts, for use inside tasks.

Texts come as one Arrow array; words are hashed from prefix sums over its
byte buffer, so no word ever becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once (a longer text is hashed alone).
SLICE_BYTES = 2_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the published splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POWERS.get("up", ())):
        for name, base in (("up", ODD), ("down", INVERSE)):
            _POWERS[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))
    return _POWERS["up"], _POWERS["down"]


def texts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    array = (array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array).fill_null("").cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `limit` bytes together, or one text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Words:
    """The words of some texts: start, end (bytes from the first text's start), text (index) and code (64-bit hash)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool):
        raw = data[at[0] : at[-1]]
        self.raw, self.bounds, n = raw, at - at[0], len(raw)
        blank = _BLANK[raw]
        cut = np.zeros(n + 1, bool)
        cut[self.bounds] = True
        solid = ~blank
        first = solid.copy()
        first[1:] &= blank[:-1] | cut[1:n]
        last = solid.copy()
        last[:-1] &= blank[1:] | cut[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(self.bounds, self.start, "right") - 1
        up, down = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[_LOWER[raw] if lower else raw] * up[:n], out=sums[1:])
        self.code = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def per_text(self) -> np.ndarray:
        """Number of words of each text."""
        return np.bincount(self.text, minlength=len(self.bounds) - 1)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of `size` words within a text, and their texts; a text of fewer words, but some, is one window."""
    code, text = words.code, words.text
    n = max(0, len(code) - size + 1)
    whole = text[:n] == text[size - 1 :][:n] if n else np.zeros(0, bool)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += code[j : j + n] * up_power(j)
    counts = words.per_text()
    short = np.flatnonzero((counts > 0) & (counts < size))
    first = np.cumsum(counts) - counts
    powers = np.array([up_power(j) for j in range(size)], np.uint64)
    extra = np.array([(code[first[t] : first[t] + counts[t]] * powers[: counts[t]]).sum(dtype=np.uint64) for t in short], np.uint64)
    codes = np.concatenate([mix(out[whole]), mix(extra ^ np.uint64(0x5EED))]) if len(short) else mix(out[whole])
    of = np.concatenate([text[:n][whole], short]) if len(short) else text[:n][whole]
    return codes, of


def up_power(j: int) -> np.uint64:
    return np.uint64(pow(int(ODD), j + 1, 1 << 64))
