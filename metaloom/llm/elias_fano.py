"""Elias-Fano sequences: monotone integers in about 2 + log2(universe / n) bits each, opened in place from a buffer."""

from __future__ import annotations

import numpy as np

U = np.uint64


class EliasFano:
    """``n`` rising integers: low bits packed, high parts in unary. ``find`` gives the place of a value, or -1."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.concatenate([[0], np.cumsum(64 - ones)])

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 1, dtype=np.uint64)
        v = values.astype(np.uint64)
        if n and bits:
            part = v & U((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * U(bits)
            word, shift = (at >> U(6)).astype(np.int64), at & U(63)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero(shift + U(bits) > U(64))
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U(64) - shift[over]))
        place = (v >> U(bits)).astype(np.int64) + np.arange(n)
        size = ((universe >> bits) + n) // 64 + 2
        unary = np.zeros(size * 64, dtype=np.uint8)
        unary[place] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little").view("<u8"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], dtype="<u8")
        return head.tobytes() + self.low.astype("<u8").tobytes() + self.high.astype("<u8").tobytes()

    @classmethod
    def open(cls, buffer, at: int = 0) -> tuple[EliasFano, int]:
        """From a buffer or a memory map, without a copy; also the place after it."""
        n, bits, a, b = np.frombuffer(buffer, dtype="<u8", count=4, offset=at).tolist()
        low = np.frombuffer(buffer, dtype="<u8", count=a, offset=at + 32)
        high = np.frombuffer(buffer, dtype="<u8", count=b, offset=at + 32 + 8 * a)
        return cls(n, bits, low, high), at + 32 + 8 * (a + b)

    def _select(self, rank: np.ndarray, directory: np.ndarray, flip: bool) -> np.ndarray:
        """The place of the ``rank``-th one (or zero), from 0."""
        word = np.searchsorted(directory, rank, side="right") - 1
        bits = self.high[word]
        bits = ~bits if flip else bits
        left, place = rank - directory[word], np.zeros(len(rank), dtype=np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            inside = np.bitwise_count(bits & U((1 << step) - 1)).astype(np.int64)
            go = left >= inside
            left = np.where(go, left - inside, left)
            place += np.where(go, step, 0)
            bits = np.where(go, bits >> U(step), bits)
        return word * 64 + place

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * U(self.low_bits)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        v = self.low[word] >> shift
        over = shift + U(self.low_bits) > U(64)
        v = v | np.where(over, self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return v & U((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, dtype=np.int64)
        return ((self._select(i, self.ones, False) - i).astype(np.uint64) << U(self.low_bits)) | self._low(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Successor search: the high part names a short run by its unary code; the low parts in it are compared."""
        v = values.astype(np.uint64)
        top, low = (v >> U(self.low_bits)).astype(np.int64), v & U((1 << self.low_bits) - 1)
        out = np.full(len(v), -1, dtype=np.int64)
        if not self.n:
            return out
        begin, end = np.zeros(len(v), dtype=np.int64), np.zeros(len(v), dtype=np.int64)
        inside = v <= self.get(np.array([self.n - 1]))[0]
        some = inside & (top > 0)
        begin[some] = self._select(top[some] - 1, self.zeros, True) + 1 - top[some]
        end[inside] = self._select(top[inside], self.zeros, True) - top[inside]
        live = np.flatnonzero(begin < end)
        lo, hi = begin[live], end[live]
        while len(live):
            mid = (lo + hi) // 2
            got, want = self._low(mid), low[live]
            hit = got == want
            out[live[hit]] = mid[hit]
            lo, hi = np.where(got < want, mid + 1, lo), np.where(got > want, mid, hi)
            go = ~hit & (lo < hi)
            live, lo, hi = live[go], lo[go], hi[go]
        return out
