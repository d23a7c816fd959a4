"""Elias-Fano coded monotone sequences over arrays that may be memory-mapped; all queries are vectorised."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_ONE, _64 = np.uint64(1), np.uint64(64)
_EACH, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: The position of the bit of each rank in each byte.
_IN_BYTE = np.array([([k for k in range(8) if byte >> k & 1] + [0] * 8)[:8] for byte in range(256)], np.int64).ravel()


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The position of the bit with this rank among the ones of each 64-bit word."""
    sums = np.bitwise_count(words.view(np.uint8)).view(np.uint64) * _EACH  # each byte: the ones up to its end
    place = np.bitwise_count((((rank.astype(np.uint64) * _EACH) | _TOPS) - sums) & _TOPS).astype(np.uint64) << np.uint64(3)
    before = ((sums << np.uint64(8)) >> place) & np.uint64(255)
    byte = (words >> place) & np.uint64(255)
    return place.astype(np.int64) + _IN_BYTE[((byte << np.uint64(3)) + rank.astype(np.uint64) - before).astype(np.int64)]


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    """Write values of ``width`` bits at these bit positions."""
    word, shift = (at // 64).astype(np.int64), (at % 64).astype(np.uint64)
    np.bitwise_or.at(out, word, values << shift)
    over = (shift + np.uint64(width)) > _64
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (_64 - shift[over]))


class EliasFano:
    """``n`` values in non-decreasing order: ``low`` holds their low bits, ``high`` the gaps of the rest in unary."""

    PARTS = ("head", "low", "high", "ones", "zeros")

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.bits = int(head[0]), int(head[1])
        self.low, self.high, self.ones, self.zeros = low, high, ones, zeros
        self.head = head

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            _put(low, np.arange(n, dtype=np.uint64) * np.uint64(bits), values & np.uint64((1 << bits) - 1), bits)
        upper = (values >> np.uint64(bits)).astype(np.int64)
        size = (int(upper[-1]) if n else 0) + n + 1
        high = np.zeros(size // 64 + 1, np.uint64)
        at = upper + np.arange(n)
        np.bitwise_or.at(high, at // 64, _ONE << (at % 64).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype(np.int64)
        return cls(np.array([n, bits], np.int64), low, high, ones, np.arange(len(high)) * 64 - ones[:-1])

    def save(self, put: Callable[[str, np.ndarray], None], name: str) -> None:
        for part in self.PARTS:
            put(f"{name}.{part}", getattr(self, part))

    @classmethod
    def load(cls, get: Callable[[str], np.ndarray], name: str) -> EliasFano:
        return cls(*(get(f"{name}.{part}") for part in cls.PARTS))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64)
        at *= np.uint64(self.bits)
        word = (at >> np.uint64(6)).view(np.int64)
        at &= np.uint64(63)
        value = self.low.take(word)
        value >>= at
        word += 1
        over = self.low.take(word)
        over <<= np.uint64(63) - at
        over <<= _ONE  # in two steps, as a shift by 64 is undefined
        value |= over
        value &= np.uint64((1 << self.bits) - 1)
        return value

    def _one(self, rank: np.ndarray) -> np.ndarray:
        """The position of the one with this rank."""
        word = np.searchsorted(self.ones, rank, "right") - 1
        return word * 64 + _select_in_word(self.high[word], rank - self.ones[word])

    def _zero(self, rank: np.ndarray) -> np.ndarray:
        """The position of the zero with this rank; it less the rank is how many values have an upper part of at most the rank."""
        word = np.searchsorted(self.zeros, rank, "right") - 1
        return word * 64 + _select_in_word(~self.high[word], rank - self.zeros[word])

    def _after(self, at: np.ndarray, rank: np.ndarray, zero: bool) -> np.ndarray:
        """The position of the one or zero that has this rank and is the next behind a position: mostly in the same word, else selected."""
        word = self.high.take(at >> 6)
        rest = (~word if zero else word) >> (at & 63).astype(np.uint64) >> _ONE
        out = at + np.bitwise_count(rest ^ (rest - _ONE))
        far = np.flatnonzero(rest == 0)
        out[far] = (self._zero if zero else self._one)(rank[far])
        return out

    def _value(self, at: np.ndarray, i: np.ndarray) -> np.ndarray:
        return ((at - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at these indexes."""
        return self._value(self._one(i), i)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at these indexes and at the next ones; the last value has itself as the next one."""
        at, after = self._one(i), np.minimum(i + 1, self.n - 1)
        return self._value(at, i), self._value(np.where(after > i, self._after(at, after, False), at), after)

    def find(self, targets: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """The index of each target within its range of indexes, by successor search in its bucket; -1 where absent."""
        targets = np.asarray(targets, np.uint64)
        upper = (targets >> np.uint64(self.bits)).astype(np.int64)
        most = len(self.high) * 64 - int(self.ones[-1]) - 1
        known = (upper <= most) & (upper >= 0)
        upper = np.where(known, upper, 0)
        below = np.maximum(upper - 1, 0)
        zero = self._zero(below)
        low = np.where(upper > 0, zero - below, 0)
        high = np.where(upper > 0, self._after(zero, upper, True), zero) - upper
        if first is not None:
            low, high = np.maximum(low, first), np.minimum(high, last)
        wanted = targets & np.uint64((1 << self.bits) - 1)
        known &= low < high
        at = np.where(known, low, 0)
        open_ = np.flatnonzero(known & (high - low > 1))
        own, size, asked = low[open_], (high - low)[open_], wanted[open_]
        while len(open_):  # the last value that is not larger is within `size` places from `own` on
            half = size >> 1
            size -= half
            half *= self._low(own + half) <= asked
            own += half
            more = np.flatnonzero(size > 1)
            if 2 * len(more) <= len(open_):
                at[open_] = own
                open_, own, size, asked = open_[more], own[more], size[more], asked[more]
        if self.n:
            known &= self._low(at) == wanted
        return np.where(known, at, -1)
