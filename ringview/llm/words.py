"""64-bit hashes of the words of many texts at once, straight from Arrow's bytes.

A word is a run of bytes other than space and ``\\t`` to ``\\r``; A-Z count as a-z. Its hash is a polynomial in its
bytes modulo ``2**64``, taken as a difference of two prefix sums, then mixed; no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at once; a longer word is hashed in one go.
SEGMENT = 1 << 17


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = np.arange(256)
_IS_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_VALUE = mixed(np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint64) + np.uint64(_BASE))


class _Powers:
    """Powers of the base and of its inverse, as many as the longest segment needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64)), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64)))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _segments(space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``SEGMENT`` bytes that end after white space, or at the end."""
    at, n = 0, len(space)
    while at < n:
        end = min(at + SEGMENT, n)
        if end < n:
            back = space[at:end][::-1].argmax()
            if space[end - 1 - back]:
                end -= int(back)
            else:
                ahead = space[end:].argmax()
                end = end + int(ahead) + 1 if space[end + ahead] else n
        yield at, end
        at = end


def of_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and before which word each text begins; ``offsets`` has one entry more than texts."""
    space = _IS_SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in _segments(space):
        gap = np.empty(b - a + 2, bool)
        gap[0] = gap[-1] = True
        gap[1:-1] = space[a:b]
        cut = begins[a : b + 1]
        first = np.flatnonzero(~gap[1:-1] & (gap[:-2] | cut[:-1]))
        last = np.flatnonzero(~gap[1:-1] & (gap[2:] | cut[1:])) + 1
        up, down = _POWERS.upto(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_VALUE[data[a:b]] * down[:-1], out=sums[1:])
        hashes.append((sums[last] - sums[first]) * up[first] + (last - first).astype(np.uint64))
        places.append(first + a)
    place = np.concatenate(places)
    return mixed(np.concatenate(hashes)), np.searchsorted(place, offsets)


def of_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same for a string column; null has no words."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return of_bytes(data, offsets - offsets[0])


def of_text(text: str | None) -> np.ndarray:
    """The hashes of one text's words."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return of_bytes(data, np.array([0, len(data)]))[0]
