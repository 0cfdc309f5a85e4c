"""Vectorised word scanning: the words ``[^\\x20\\x09-\\x0D]+`` of many texts at once.

Texts are laid end to end as UTF-8 bytes, a line feed after each, so that no word spans two texts. Equal words of a run
are found by dictionary encoding, which compares bytes: inside a run a word is a number, and equal numbers are equal
words. Where words of different runs meet, a word is known by 128 bits of BLAKE2b of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SEP = np.zeros(256, dtype=bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def numbered(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings among ``data[offsets[i]:offsets[i + 1]]``, and of each the number of its string. Strings are compared byte by byte."""
    raw = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = raw.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Words:
    """Words of a run of texts: ``number`` in order, as places in ``names``; text i has words ``first[i]:first[i+1]`` and bytes ``at[i]:at[i+1]-1`` of ``buf``."""

    buf: np.ndarray
    at: np.ndarray
    names: pa.Array
    number: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def digests(self) -> np.ndarray:
        """128 bits of each distinct word, as two columns."""
        return np.frombuffer(b"".join([blake2b(x, digest_size=16).digest() for x in self.names.to_numpy(zero_copy_only=False)]), dtype="<u8").reshape(-1, 2)


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def scan(texts: list[str | None], lower: bool) -> Words:
    raw = [utf8(t) for t in texts]
    at = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=at[1:])
    buf = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    if lower:
        buf = LOWER[buf]
    sep = SEP[buf]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if len(buf) and not sep[0]:
        edge = np.concatenate([np.zeros(1, dtype=np.int64), edge])
    starts, ends = edge[::2], edge[1::2]  # a run ends with a line feed, so every word has its end
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    names, number = numbered(buf[~sep], offsets)
    return Words(buf, at, names, number, np.searchsorted(starts, at))


def slices(texts: list[str | None], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs ``(a, b)`` of texts with about ``limit`` characters each (one text at least)."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t) + 1 if t else 1
        if n >= limit:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def text_runs(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, list[str | None]]]:
    """Runs ``(a, b, texts)`` of an Arrow column with about ``limit`` bytes each (one text at least); only a run at a time is held as Python strings."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit)))
        yield a, b, texts.slice(a, b - a).to_pylist()
        a = b


def _windows(h: np.ndarray, width: int) -> list[np.ndarray]:
    """Hashes of 1, 2, ... ``width`` words from each place on."""
    out, x = [mix(h ^ U(0xD6E8FEB86659FD93))], h
    for k in range(1, width):
        x = mix(x[:-1] * U(0x9E3779B97F4A7C15) + (h[k:] ^ (h[k:] >> U(32))) * U(0xC2B2AE3D27D4EB4F))
        out.append(x)
    return out


def _spans(w: Words, width: int) -> Iterator[tuple[int, int, int]]:
    """Of each text: which window length less one its shingles have, and their places. Fewer words are one shingle; no word gives none."""
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        yield (width - 1, a, b - width + 1) if b - a >= width else (max(b - a - 1, 0), a, min(a + 1, b))


def shingles(w: Words, width: int = 2) -> list[np.ndarray]:
    """Of each text: the sorted distinct shingles of ``width`` words as 64-bit hashes."""
    runs = _windows(w.digests[:, 0][w.number], width)
    return [np.unique(runs[k][a:b]) for k, a, b in _spans(w, width)]


def marked_shingles(w: Words, width: int = 2) -> tuple[list[np.ndarray], list[bytes | None]]:
    """The same, and of each set a mark: 128 bits of BLAKE2b over 128-bit hashes of its shingles (an empty set has none)."""
    one, two = (_windows(w.digests[:, k][w.number], width) for k in (0, 1))
    sets, marks = [], []
    for k, a, b in _spans(w, width):
        items, at = np.unique(one[k][a:b], return_index=True)
        sets.append(items)
        marks.append(blake2b(items.tobytes() + two[k][a:b][at].tobytes(), digest_size=16).digest() if len(items) else None)
    return sets, marks


def exact_shingles(w: Words, width: int = 2) -> list[np.ndarray]:
    """The same sets with shingles as numbers that are equal only if their words are: valid within this run alone."""
    v = len(w.names) + 1
    runs, x = [w.number], w.number
    for k in range(1, width):
        x = np.unique(x, return_inverse=True)[1].astype(np.int64) if k > 1 else x
        x = x[:-1] * v + w.number[k:]
        runs.append(x)
    # Shorter texts than a shingle get numbers apart from all others.
    return [np.unique(runs[k][a:b] if k == width - 1 else -1 - (runs[k][a:b] * width + k)) for k, a, b in _spans(w, width)]
