"""Elias-Fano sequences and the n-gram trie made of them, in numpy."""

from __future__ import annotations

import struct

import numpy as np

_ONE = np.uint64(1)
_HEAD = struct.Struct("<QQ")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: The place of the k-th one in a byte, at 8 * byte + k.
_ONE_IN_BYTE = np.argsort(1 - _BITS.astype(np.int8), axis=1, kind="stable").astype(np.int64).ravel()


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits of each value one after the other, in 64-bit words with one to spare."""
    parts = []
    step = 1 << 16  # a multiple of eight values ends on a whole byte
    for at in range(0, len(values), step):
        raw = np.ascontiguousarray(values[at : at + step]).view(np.uint8).reshape(-1, 8)
        parts.append(np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits], bitorder="little"))
    data = np.concatenate(parts) if parts and bits else np.zeros(0, np.uint8)
    return np.concatenate([data, np.zeros(-len(data) % 8 + 8, np.uint8)]).view(np.uint64)


class Sequence:
    """A non-decreasing sequence of unsigned 64-bit values below ``universe``.

    The lower bits of the values are packed; the upper parts are unary, a one per value and a zero per
    step. Elements are found by select on the ones, a successor by select on the zeros and a binary
    search among the few values with the same upper part. All queries take arrays.
    """

    def __init__(self, size: int, bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.size, self.bits, self.low, self.high = size, bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.arange(len(high) + 1) * 64 - self.ones

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> Sequence:
        values = np.asarray(values, np.uint64)
        size = len(values)
        bits = max(0, (universe // max(size, 1)).bit_length() - 1)
        upper = (values >> np.uint64(bits)).astype(np.int64)
        length = size + (max(universe - 1, 0) >> bits) + 1
        marks = np.zeros(length + -length % 64, np.uint8)
        marks[upper + np.arange(size)] = 1
        return cls(size, bits, _pack(values, bits), np.packbits(marks, bitorder="little").view(np.uint64))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.size, self.bits) + _HEAD.pack(len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_buffer(cls, data, at: int) -> tuple[Sequence, int]:
        """A sequence that reads its words from ``data`` (a memory map), and where it ends."""
        size, bits = _HEAD.unpack_from(data, at)
        low, high = _HEAD.unpack_from(data, at + 16)
        words = np.frombuffer(data, np.uint64, low + high, at + 32)
        return cls(size, bits, words[:low], words[low:]), at + 32 + 8 * (low + high)

    def _lower(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        found = self.low[word] >> shift
        # Shifted twice, as a shift by 64 is undefined.
        found |= (self.low[word + 1] << (np.uint64(63) - shift)) << _ONE
        return found & np.uint64((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Position of the k-th zero or one."""
        if len(k) > 4 * len(self.high):  # so many are asked that unpacking all is less work
            places = np.unpackbits(self.high.view(np.uint8), bitorder="little") == (0 if zeros else 1)
            return np.flatnonzero(places)[k]
        before = self.zeros if zeros else self.ones
        word = np.searchsorted(before, k, side="right") - 1
        rest = k - before[word]
        bits = ~self.high[word] if zeros else self.high[word]
        place = word * 64
        for half in (32, 16, 8):
            lower = bits & np.uint64((1 << half) - 1)
            count = np.bitwise_count(lower)
            up = rest >= count
            rest = rest - np.where(up, count, 0)
            place = place + np.where(up, half, 0)
            bits = np.where(up, bits >> np.uint64(half), lower)
        return place + _ONE_IN_BYTE[(bits.astype(np.int64) << 3) + rest]

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, np.int64)
        upper = (self._select(i, zeros=False) - i).astype(np.uint64)
        return (upper << np.uint64(self.bits)) | self._lower(i)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value the index of the first element not below it, and whether they are equal.

        The values must be below the universe.
        """
        values = np.asarray(values, np.uint64)
        step = (values >> np.uint64(self.bits)).astype(np.int64)
        end = self._select(step, zeros=True) - step
        begin = np.zeros(len(values), np.int64)
        later = step > 0
        begin[later] = self._select(step[later] - 1, zeros=True) - (step[later] - 1)
        target = values & np.uint64((1 << self.bits) - 1)
        last = end.copy()
        open_ = np.flatnonzero(begin < last)
        while len(open_):
            middle = (begin[open_] + last[open_]) >> 1
            below = self._lower(middle) < target[open_]
            begin[open_] = np.where(below, middle + 1, begin[open_])
            last[open_] = np.where(below, last[open_], middle)
            open_ = open_[begin[open_] < last[open_]]
        equal = np.zeros(len(values), bool)
        inside = np.flatnonzero(begin < end)
        equal[inside] = self._lower(begin[inside]) == target[inside]
        return begin, equal


class Trie:
    """Contexts and, below each, the words seen after it, one level or more, with quantised probabilities.

    ``contexts`` are unsigned 64-bit numbers. A level holds the children of the level above: those of its
    i-th node stand from pointer i to pointer i + 1; ``pointers`` never decrease. A child is a number
    below 2^bits; the i-th node's are raised by i * 2^bits, so the whole level increases and is one
    sequence, in which a child is sought by its successor relative to its context. ``codes`` holds a byte
    per node of the last level, an index into ``codebook``.
    """

    def __init__(self, contexts, levels, codes, codebook) -> None:
        self.contexts, self.levels, self.codes, self.codebook = contexts, levels, codes, codebook

    @classmethod
    def of(cls, contexts: np.ndarray, *levels: np.ndarray) -> Trie:
        """contexts: ascending; then of each level the parents and children, ascending by both and
        different; last the values of the last level's nodes, positive."""
        *levels, shares = levels
        codes, codebook = quantised(shares)
        above, made = len(contexts), []
        for parents, children in zip(levels[::2], levels[1::2]):
            bits = max(1, int(children.max(initial=0)).bit_length())
            keys = (parents.astype(np.uint64) << np.uint64(bits)) | children.astype(np.uint64)
            pointers = np.searchsorted(parents, np.arange(above + 1))
            made.append(
                (bits, Sequence.of(pointers, len(parents) + 1), Sequence.of(keys, max(above, 1) << bits))
            )
            above = len(parents)
        return cls(Sequence.of(contexts, 1 << 64), made, codes, codebook)

    def to_bytes(self) -> bytes:
        levels = [
            _HEAD.pack(bits, 0) + pointers.to_bytes() + children.to_bytes() for bits, pointers, children in self.levels
        ]
        book = self.codebook.astype("<f4").tobytes()
        sizes = _HEAD.pack(len(self.codes), len(self.codebook))
        return b"".join(
            [_HEAD.pack(len(levels), 0), self.contexts.to_bytes(), *levels, sizes, book, self.codes.tobytes()]
        )

    @classmethod
    def from_buffer(cls, data) -> Trie:
        (depth, _), levels = _HEAD.unpack_from(data, 0), []
        contexts, at = Sequence.from_buffer(data, _HEAD.size)
        for _ in range(depth):
            bits, _ = _HEAD.unpack_from(data, at)
            pointers, at = Sequence.from_buffer(data, at + _HEAD.size)
            children, at = Sequence.from_buffer(data, at)
            levels.append((bits, pointers, children))
        codes, book = _HEAD.unpack_from(data, at)
        codebook = np.frombuffer(data, "<f4", book, at + 16)
        return cls(contexts, levels, np.frombuffer(data, np.uint8, codes, at + 16 + 4 * book), codebook)

    def find(self, contexts: np.ndarray, *below: np.ndarray) -> np.ndarray:
        """Codes of the last level's nodes, 0 where one is absent.

        ``below`` has two arrays a level: how many children each node asked for above has, and these.
        """
        if not self.contexts.size:
            return np.zeros(len(below[-1]), np.uint8)
        rank, known = self.contexts.successor(contexts)
        for (bits, pointers, children), counts, asked in zip(self.levels, below[::2], below[1::2]):
            if not children.size:
                return np.zeros(len(below[-1]), np.uint8)
            begin = pointers.get(np.where(known, rank, 0)).astype(np.int64)
            end = pointers.get(np.where(known, rank + 1, 0)).astype(np.int64)
            asked = asked.astype(np.uint64)
            ask = np.flatnonzero(np.repeat(known, counts) & (asked >> np.uint64(bits) == 0))
            base = np.repeat(rank, counts)[ask].astype(np.uint64) << np.uint64(bits)
            at, equal = children.successor(base | asked[ask])
            equal &= (at >= np.repeat(begin, counts)[ask]) & (at < np.repeat(end, counts)[ask])
            known, rank = np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
            known[ask[equal]], rank[ask[equal]] = True, at[equal]
        found = np.zeros(len(rank), np.uint8)
        found[known] = self.codes[rank[known]]
        return found


def quantised(shares: np.ndarray, levels: int = 255) -> tuple[np.ndarray, np.ndarray]:
    """A byte per value and the codebook; code 0 is kept for what is absent.

    Up to ``levels`` different values are exact; more go into bins of equal width on the logarithm,
    so that no value is off by more than a bin, and a bin's value is its members' geometric mean.
    """
    different, inverse, counts = np.unique(
        shares.astype(np.float32), return_inverse=True, return_counts=True
    )
    logs = np.log10(np.maximum(different, np.float32(1e-38)).astype(np.float64))
    if len(different) <= levels:
        bins = np.arange(len(different))
    else:
        width = (logs[-1] - logs[0]) / levels
        _, bins = np.unique(((logs - logs[0]) / width).astype(np.int64).clip(0, levels - 1), return_inverse=True)
    sums = np.bincount(bins, weights=logs * counts, minlength=1)
    members = np.maximum(np.bincount(bins, weights=counts, minlength=1), 1)
    codebook = np.concatenate([[0.0], 10 ** (sums / members)])
    return (bins[inverse] + 1).astype(np.uint8), codebook.astype(np.float32)
