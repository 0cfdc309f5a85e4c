"""Plain versions of what the operators promise, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


WIDTH = 2


def shingle_set(text: str | None) -> set:
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + WIDTH]) for i in range(len(w) - WIDTH + 1)} if len(w) >= WIDTH else {tuple(w)} if w else set()


def near(docs: list[tuple]) -> dict:
    """doc_id -> (size, component) of rows (id, text), ids distinct and not null."""
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def exact(docs: list[tuple]) -> dict:
    """text -> (keep id, size)."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i if i is not None else 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


def quality(t: str | None) -> tuple:
    t = t or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def lines(docs: list[tuple], min_docs: int, first: bool = False) -> list[tuple]:
    """(lines, dropped, sha) of each row in order."""
    key = lambda x: lower(x.strip(" \t\n\v\f\r"))
    where, head = defaultdict(set), {}
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0))
    for k in order:
        i, t = docs[k]
        for n, line in enumerate((t or "").split("\n")):
            where[key(line)].add(i)
            head.setdefault(key(line), (i, n))
    out = []
    for i, t in docs:
        all_ = (t or "").split("\n")
        gone = [len(key(x)) >= 1 and len(where[key(x)]) >= min_docs and not (first and head[key(x)] == (i, n)) for n, x in enumerate(all_)]
        out.append((len(all_), sum(gone), hashlib.sha256("\n".join(x for x, g in zip(all_, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def held_out(i) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def lm(docs: list[tuple], d: float) -> list[tuple]:
    """(tokens, known, N, base, score) of each row in order."""
    tokens = [[*WORD.findall(lower(t or "")), None] for _, t in docs]
    c, pairs = Counter(), Counter()
    for (i, _), ts in zip(docs, tokens, strict=True):
        if not held_out(i):
            c.update(ts)
            pairs.update(zip(["<s>", *ts], ts))
    n, v = sum(c.values()), len(c)
    seen = dict(c) | {"<s>": sum(not held_out(i) for i, _ in docs)}
    after = Counter(h for h, _ in pairs)

    def p(h, t, b):
        return max(pairs[h, t] - d, 0) / seen[h] + d * after[h] / seen[h] * b if seen.get(h) else b

    out = []
    for ts in tokens:
        base = [math.log10((c[t] + 1) / (n + v + 1)) for t in ts]
        score = sum(math.log10(p(h, t, 10**b)) for h, t, b in zip(["<s>", *ts], ts, base))
        out.append((len(ts), sum(t in c for t in ts), n, sum(base), score))
    return out


def url(u: str | None) -> tuple:
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    host = re.match("[^/?#]*", rest)[0]
    return lower(host), re.match("[^?#]*", rest[len(host) :])[0]
