"""Byte-level BPE over pre-tokens: vocabularies, cached pair merging, encoding of many texts at once.

A run of texts is cut into pre-tokens (:mod:`pretok`); equal pre-tokens of the run are found by dictionary encoding,
which compares bytes; each distinct one is looked up in a bounded memo by its bytes and merged on a miss; the ids are then
gathered by NumPy.
"""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache

import numpy as np

from metaloom.llm import pretok
from metaloom.llm.words import numbered

MEMO = 200_000
NONE = np.int32(2**31 - 1)
PROBE = 0x9E3779B97F4A7C15 - (1 << 64)


@lru_cache(1)
def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary file: printable Latin-1 as is, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """``bytes_of[id]``, ``pairs[(left, right)] = (priority, merged)``, ids of single bytes and special strings."""

    def __init__(self, path: str):
        self.special: dict[str, int] = {}
        if path.endswith(".json"):
            spec = json.loads(open(path, encoding="utf-8").read())
            chars = _byte_chars()
            ids = {bytes(chars[c] for c in k): v for k, v in spec["model"]["vocab"].items() if all(c in chars for c in k)}
            merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
            code = lambda s: bytes(chars[c] for c in s)
            parts = [(code(a), code(b)) for a, b in merges]
            self.pairs = {(ids[a], ids[b]): (i, ids[a + b]) for i, (a, b) in enumerate(parts)}
            self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        else:
            with open(path, "rb") as f:
                ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            # A rank file lists no pairs: two neighbours merge if the file holds what they make together, lowest rank first.
            self.pairs = {}
            for whole, rank in ids.items():
                for k in range(1, len(whole)):
                    if (a := ids.get(whole[:k])) is not None and (b := ids.get(whole[k:])) is not None:
                        self.pairs[a, b] = (rank, rank)
        self.ids = ids
        self.bytes_of = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for k, v in ids.items():
            self.bytes_of[v] = k
        for k, v in self.special.items():
            self.bytes_of[v] = k.encode()
        self.single = [ids.get(bytes([i]), -1) for i in range(256)]
        self._pair_table()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest priority, leftmost first, merges until none is left."""
        ids = [self.single[b] for b in piece]
        if len(ids) > 64:
            return self._merge_long(ids)
        pairs = self.pairs
        while len(ids) > 1:
            best, at, made = 1 << 60, -1, -1
            for i in range(len(ids) - 1):
                found = pairs.get((ids[i], ids[i + 1]))
                if found and found[0] < best:
                    best, at, made = found[0], i, found[1]
            if at < 0:
                break
            ids[at : at + 2] = [made]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for pre-tokens of any length."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (found := self.pairs.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = made, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def _pair_table(self) -> None:
        """``pairs`` as an open-addressing table of arrays, for many look-ups at once."""
        size = 1 << max(10, (2 * len(self.pairs)).bit_length())
        self.mask, self.keys = size - 1, np.full(size, -1, dtype=np.int64)
        self.found = np.full((size, 2), NONE, dtype=np.int32)
        for (a, b), v in self.pairs.items():
            k = a << 32 | b
            i = (k * PROBE >> 40) & self.mask
            while self.keys[i] >= 0:
                i = (i + 1) & self.mask
            self.keys[i], self.found[i] = k, v

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair the slot of the table that holds it, or -1."""
        key = left.astype(np.int64) << 32 | right
        slot = ((key * PROBE) >> 40) & self.mask
        at = self.keys[slot]
        out = np.where(at == key, slot, -1)
        open_ = np.flatnonzero((at != key) & (at >= 0) & (left >= 0) & (right >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            at = self.keys[slot[open_]]
            hit = at == key[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (at >= 0)]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian 32-bit numbers; those of similar length merge in lock step, one pair of each in a round."""
        out: list = [None] * len(pieces)
        lens = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        for low, high in ((0, 8), (8, 16), (16, 32), (32, 64)):
            mine = np.flatnonzero((lens > low) & (lens <= high))
            for part in (mine[i : i + 65536] for i in range(0, len(mine), 65536)):
                for k, ids in zip(part.tolist(), self._lock_step([pieces[i] for i in part.tolist()], high), strict=True):
                    out[k] = ids
        for k in np.flatnonzero((lens > 64) | (lens == 0)).tolist():
            out[k] = np.array(self.merge(pieces[k]), dtype="<u4").tobytes()
        return out

    def _lock_step(self, pieces: list[bytes], width: int) -> list[bytes]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        left = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ids = np.array(self.single, dtype=np.int32)[raw]
        ids[np.arange(width) >= left[:, None]] = -1
        slots = self.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width - 1)
        cost = np.where(slots >= 0, self.found[slots, 0], NONE)
        done_ids, done_left = np.full((len(pieces), width), -1, dtype=np.int32), left.copy()
        live = np.arange(len(pieces))
        places = np.arange(width)
        while True:
            best = cost.argmin(axis=1)
            rows = np.arange(len(live))
            open_ = cost[rows, best] < NONE
            if not open_.all():
                done_ids[live[~open_]], done_left[live[~open_]] = ids[~open_], left[~open_]
                live, ids, cost, left, best = live[open_], ids[open_], cost[open_], left[open_], best[open_]
                rows = np.arange(len(live))
            if not len(live):
                break
            at = self.look_up(ids[rows, best], ids[rows, best + 1])
            made = self.found[at, 1]
            shift = np.minimum(places + (places > best[:, None]), width - 1)
            ids = np.take_along_axis(ids, shift, axis=1)
            ids[:, -1] = -1
            ids[rows, best] = made
            left = left - 1
            cost = np.take_along_axis(cost, np.minimum(shift[:, :-1], width - 2), axis=1)
            cost[:, -1] = NONE
            for place in (best - 1, best):
                ok = (place >= 0) & (place < width - 1)
                r, c = rows[ok], place[ok]
                at = self.look_up(ids[r, c], ids[r, c + 1])
                cost[r, c] = np.where(at >= 0, self.found[at, 0], NONE)
        flat = done_ids[places < done_left[:, None]].astype("<u4").tobytes()
        ends = (4 * np.cumsum(done_left)).tolist()
        return [flat[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def whole_tokens(self) -> dict[bytes, int]:
        """Strings (as bytes) that encode alone as one token: proved by cutting and merging each vocabulary string."""
        texts = {}
        for b in self.ids:
            try:
                texts[b.decode("utf-8")] = b
            except UnicodeDecodeError:
                continue
        names = list(texts)
        _, _, first = pretok.boundaries(names)
        alone = [x == self.ids[texts[t]].to_bytes(4, "little") for t, x in zip(names, self.merge_many(list(texts.values())), strict=True)]
        return {texts[t]: self.ids[texts[t]] for i, (t, n) in enumerate(zip(names, np.diff(first).tolist(), strict=True)) if n == 1 and alone[i]}


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memo:
    """A bounded map from pre-token to a value: two generations, the elder dropped when the younger is full. ``make`` gives values for many keys; ``fixed`` ones stay."""

    def __init__(self, make, fixed: dict | None = None, limit: int = MEMO):
        self.make, self.fixed, self.limit = make, fixed or {}, limit
        self.young: dict = {}
        self.old: dict = {}

    def many(self, keys: list) -> list:
        fixed, young, old = self.fixed, self.young, self.old
        out, missing = [None] * len(keys), []
        for i, k in enumerate(keys):
            v = fixed.get(k)
            if v is None:
                v = young.get(k)
                if v is None:
                    v = old.get(k)
                    if v is None:
                        missing.append(i)
                        continue
                    young[k] = v
            out[i] = v
        for i, v in zip(missing, self.make([keys[i] for i in missing]), strict=True):
            out[i] = young[keys[i]] = v
        if len(young) >= self.limit // 2:
            self.old, self.young = young, {}
        return out


def distinct(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct pre-tokens of the texts as bytes, for each pre-token in order the number of its string, and each text's first."""
    joined, starts, first = pretok.boundaries(texts)
    if not len(starts):
        return [], np.zeros(0, dtype=np.int64), first
    raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    at = starts if len(raw) == len(joined) else np.flatnonzero((raw & 0xC0) != 0x80)[starts]
    names, number = numbered(raw, np.append(at, len(raw)))
    return names.to_numpy(zero_copy_only=False).tolist(), number, first


def split_special(texts: list[str | None], special: dict[str, int]) -> tuple[list[str], list[int], list[int]]:
    """Texts cut at special strings: the parts, for each part the text it is of, and the id that follows it (or -1)."""
    if not special or not any(t and s in t for t in texts for s in special):
        return [t or "" for t in texts], list(range(len(texts))), [-1] * len(texts)
    parts, owner, then = [], [], []
    names = sorted(special, key=len, reverse=True)
    for i, t in enumerate(texts):
        t, at = t or "", 0
        while True:
            hits = [(p, s) for s in names if (p := t.find(s, at)) >= 0]
            if not hits:
                break
            p, s = min(hits, key=lambda x: (x[0], -len(x[1])))
            parts.append(t[at:p])
            owner.append(i)
            then.append(special[s])
            at = p + len(s)
        parts.append(t[at:])
        owner.append(i)
        then.append(-1)
    return parts, owner, then


def gather(rows: list[bytes], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ``rows[number[k]]`` one after another, and where each row begins (and the end)."""
    lens = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) // 4
    flat = np.frombuffer(b"".join(rows), dtype="<u4")
    begin = np.cumsum(lens) - lens
    own = lens[number]
    at = np.zeros(len(number) + 1, dtype=np.int64)
    np.cumsum(own, out=at[1:])
    return flat[np.repeat(begin[number] - at[:-1], own) + np.arange(at[-1])], at


def encode(texts: list[str | None], memo: Memo, special: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another and where each text's begin (and the end). ``memo`` gives the ids of pre-tokens as bytes."""
    parts, owner, then = split_special(texts, special)
    names, number, first = distinct(parts)
    ids, at = gather(memo.many(names), number)
    bounds = at[first]
    if len(parts) == len(texts):
        return ids, bounds
    out, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for k, (i, t) in enumerate(zip(owner, then, strict=True)):
        out.append(ids[bounds[k] : bounds[k + 1]])
        if t >= 0:
            out.append(np.array([t], dtype="<u4"))
        sizes[i] += bounds[k + 1] - bounds[k] + (t >= 0)
    return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])
