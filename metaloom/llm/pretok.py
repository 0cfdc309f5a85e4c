"""Pre-tokenisation of the byte-level BPE pattern by class arrays and a scan of transition functions.

The pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` is a finite automaton once
each code point carries one class and looks at the next (white space: is more to come?) or the next two (apostrophes:
is it a contraction?). A class is a function from state to state. Functions compose associatively, so all places are
solved at once: compose inside equal blocks in lock step, then across blocks, then apply. Texts are joined; the
first code point of a text uses a function that ignores the state before it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import tiktoken

# Classes: letter, number, other, contraction of two, of three, space that joins, last white space, white space in a run.
L, N, P, A2, A3, SJ, WL, WR = range(8)
# States: fresh, pending space, letters, numbers, other, white space, one or two contraction letters to go.
FRESH, PEND, LET, NUM, OTH, WS, ONE, TWO = range(8)


def _step(state: int, cls: int) -> tuple[int, bool]:
    """The next state, and whether a token starts here."""
    if state == TWO:
        return ONE, False
    if state == ONE:
        return FRESH, False
    if cls == SJ:
        return PEND, True
    if cls == WL:
        return FRESH, True
    if cls == WR:
        return WS, state != WS
    if cls in (A2, A3):
        return (OTH, False) if state in (OTH, PEND) else ((ONE if cls == A2 else TWO), True)
    own = (LET, NUM, OTH)[cls]
    return own, state not in (own, PEND)


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the functions that the classes generate: composition table, value at FRESH..., the generators (8 plain, 8 at a text's start), and the table of token starts."""
    plain = [tuple(_step(s, c)[0] for s in range(8)) for c in range(8)]
    reset = [(f[FRESH],) * 8 for f in plain]
    found: dict[tuple, int] = {}
    todo = [*plain, *reset]
    while todo:
        f = todo.pop()
        if f not in found:
            found[f] = len(found)
            todo += [tuple(g[x] for x in f) for g in plain + reset]
    names = sorted(found, key=found.get)
    table = np.array([[found[tuple(g[x] for x in f)] for g in names] for f in names], dtype=np.uint8 if len(names) < 256 else np.uint16)
    value = np.array(names, dtype=np.uint8)
    gens = np.array([found[f] for f in (*plain, *reset)], dtype=table.dtype)
    starts = np.array([[_step(s, c)[1] for c in range(8)] for s in range(8)])
    return table, value, gens, starts


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """Class of each code point as the libraries' own engine sees ``\\p{L}``, ``\\p{N}`` and ``\\s`` (no pattern runs over texts)."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, P, dtype=np.uint8)
    for pattern, cls in ((r"\p{L}", L), (r"\p{N}", N), (r"\s", WL)):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(probe.encode_ordinary(every)).decode().encode("utf-32-le"), dtype="<u4")] = cls
    return out


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined, the places where tokens start in it, and for each text the number of its first token (and the end)."""
    joined = "".join(texts)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    n = len(joined)
    if not n:
        return joined, np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    cls = code_point_classes()[code]
    space = cls == WL
    heads = at[:-1][np.diff(at) > 0]
    last = np.zeros(n, dtype=bool)  # the last code point of a text
    last[heads[1:] - 1] = True
    last[-1] = True
    more = np.empty(n, dtype=bool)  # white space, or the end, comes next
    more[:-1] = space[1:]
    more[-1] = True
    more |= last
    cls[space & more] = WR
    cls[space & ~more & (code == 0x20)] = SJ
    quote = np.flatnonzero((code == 0x27) & ~last)
    if len(quote):
        one = code[quote + 1]
        two = code[np.minimum(quote + 2, n - 1)]
        two[last[quote + 1]] = 0
        cls[quote[np.isin(one, [ord(c) for c in "stmd"])]] = A2
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        cls[quote[np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])]] = A3
    table, value, gens, start_of = _monoid()
    f = gens[cls]
    f[heads] = gens[cls[heads] + 8]
    state = np.empty(n, dtype=np.uint8)  # before each code point
    width = 256 if n > 4096 else 16
    rows = -(-n // width)
    grid = np.full(rows * width, f[0], dtype=f.dtype)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)  # a step of all blocks is one row
    for j in range(1, width):
        grid[j] = table[grid[j - 1], grid[j]]
    before = np.empty(rows, dtype=np.uint8)  # state before each block
    now, ends = FRESH, grid[-1].tolist()
    images = value.tolist()
    for r in range(rows):
        before[r] = now
        now = images[ends[r]][now]
    inside = np.empty((width, rows), dtype=np.uint8)
    inside[0] = before
    inside[1:] = value[grid[:-1], before]
    state[:] = np.ascontiguousarray(inside.T).reshape(-1)[:n]
    starts = start_of[state, cls]
    starts[heads] = True
    starts = np.flatnonzero(starts)
    return joined, starts, np.searchsorted(starts, at)
