"""Main text of web pages by consensus of a host's pages on where the text stands.

First pass: each page is cut into elements; every container is scored by the text of its blocks (links and short loose
text count against it, elements made for articles count more), and the page votes for the generalised path of its best
container: tag names with their classes and ids from the body down, numbers of three and more digits left out. Votes are
summed by host and path, and a host's paths are ranked. Second pass: a page is read again and its text taken from the
first of its host's paths that it has text at (all containers of a path that is named by tag or class, else the best one),
or from its own best container if it has none. A page is thus not fooled by a long sidebar or notice that the other pages
of the host do not have.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are known by tag, role or
by words of class and id (``BOILERPLATE``), wherever they stand; a heading inside an article belongs to it. Character
references are decoded; white space inside a block (Unicode's, a line break too) becomes one space; blocks without text
leave no line. Unclosed elements end where the next block or their parent ends. Nothing else is dropped.

Votes are partial sums before they are shuffled, so a host of any size costs one row a path and task. Ranked paths go to
the pages as a broadcast if they are few (``few`` bytes, checked on the written table), else by a join on host and salt
with each host's row repeated for ``salts`` salts. Paths of less than one percent of a host's votes are not ranked, so a
host has a hundred at most.

A null html is an empty page with empty text; a page without url has the empty host, and such pages vote together;
repeated rows are extracted alike; other columns stay, and those named ``text`` or ``n_chars`` are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.llm.words import text_runs
from metaloom.session import cut, ship_package

# Elements by what they are for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template svg canvas iframe object embed audio video nav footer aside menu form button select textarea input dialog noembed noframes xmp title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td blockquote center html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption caption".split())
# A start of the first ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "body": {"head"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}
P_ENDERS = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
# Words of class, id or role that name what is not the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner sponsor sponsored promo promos promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail footer foot masthead topbar toolbar header "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login paywall share sharing social comment comments commentlist respond reply replies disqus discussion "
    "related recommended recommendations widget widgets pagination pager tags skip hidden copyright contentinfo complementary search searchbox form".split()
)
READERS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promos promoted related recommended recommendations widget".split())
ARTICLE = frozenset("article articlebody content entry main post story text body".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>=][^\s/>=]*)\s*(=?)\s*)?")
BARE = re.compile(r"[^\s>]*")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d{3,}")
INVISIBLE = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
LABEL_STEPS = 24


@dataclass
class Page:
    """Containers by number (the body is 0) and blocks in page order."""

    parent: list[int] = field(default_factory=lambda: [0])
    step: list[str] = field(default_factory=lambda: ["body"])
    boost: list[float] = field(default_factory=lambda: [0.8])
    repeats: list[bool] = field(default_factory=lambda: [False])  # whether all containers of its path count, or the best
    blocks: list[tuple[int, str, float]] = field(default_factory=list)  # container, text, worth


def _words(name: str) -> list[str]:
    return [w.lower() for w in WORD.findall(name)]


@lru_cache(maxsize=1 << 14)
def _named(value: str, words: frozenset[str]) -> bool:
    """Whether a name in ``value`` begins or ends with one of the words and doesn't say that something has or lacks it."""
    for name in value.split():
        parts = _words(name)
        if parts and not {"has", "with", "no", "without", "is", "not"} & set(parts[:-1]) and (parts[0] in words or parts[-1] in words):
            return True
    return False


def _attributes(text: str, at: int, missing: dict[str, int]) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on, and where the tag ends."""
    out: dict[str, str] = {}
    n = len(text)
    while at < n:
        m = ATTRIBUTE.match(text, at)
        at = m.end()
        if at >= n or not m[1]:
            if at < n and text[at] != ">":  # a stray sign
                at += 1
                continue
            return out, at + 1
        value = ""
        if m[2]:
            quote = text[at : at + 1]
            end = -1
            if quote in ('"', "'") and at < missing.get(quote, n):
                end = text.find(quote, at + 1)
                if end < 0:
                    missing[quote] = at  # from here on there is none: not looked for again
            if end >= 0:
                value, at = text[at + 1 : end], end + 1
            else:
                bare = BARE.match(text, at)
                value, at = bare[0], bare.end()
        out.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return out, at


def _worth(tag: str, text: str, linked: int) -> float:
    n = len(text)
    if tag not in PROSE and n < 80:  # loose labels
        return -0.5 * n
    return (n - 2.0 * linked) * (0.5 if tag in ("li", "td", "th", "dt", "dd") and n < 40 else 1.0)


def read(source: str | None) -> Page:
    """Containers and blocks of a page, without what is not article."""
    page = Page()
    text = source or ""
    # Open elements: tag, container, dropped (0 no, 1 by its name, 2 for good), whether only headings count, whether in an article.
    stack: list[tuple[str, int, int, bool, bool]] = [("body", 0, 0, False, False)]
    places: dict[str, list[int]] = {}
    pieces: list[str] = []
    linked = 0
    link = False
    missing: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if pieces:
            joined = " ".join("".join(pieces).split())
            pieces.clear()
            tag, box, dropped, headings, _ = stack[-1]
            if joined and not dropped and (not headings or tag in HEADINGS):
                page.blocks.append((box, joined, _worth(tag, joined, min(linked, len(joined)))))
        linked = 0

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            tag = stack[-1][0]
            if tag in BLOCKS:
                flush()
            places[tag].pop()
            stack.pop()

    def last(tag: str) -> int:
        at = places.get(tag)
        return at[-1] if at else 0

    def say(raw: str) -> None:
        nonlocal linked
        if stack[-1][0] == "head" and raw.strip():
            close_to(len(stack) - 1)
        if not stack[-1][2]:
            plain = html.unescape(raw) if "&" in raw else raw
            pieces.append(plain)
            if link:
                linked += len(plain)

    at, n = 0, len(text)
    while at < n:
        lt = text.find("<", at)
        if lt < 0 or lt == n - 1:
            say(text[at:])
            break
        if lt > at:
            say(text[at:lt])
        sign = text[lt + 1]
        if sign == "/" or sign in "!?":
            if text.startswith("<!--", lt):
                if text.startswith((">", "->"), lt + 4):
                    at = text.find(">", lt) + 1
                    continue
                end = text.find("-->", lt + 4)
                other = text.find("--!>", lt + 4, end if end >= 0 else n)
                end = other + 4 if other >= 0 else end + 3 if end >= 0 else n
                at = end
                continue
            m = NAME.match(text, lt + 2) if sign == "/" else None
            end = text.find(">", lt)
            at = end + 1 if end >= 0 else n
            if not m:
                if sign == "/" and lt + 2 >= n:
                    say(text[lt:])
                continue
            tag = m[0].lower()
            if tag == "a":
                link = False
            elif tag == "br":
                say(" ")
            elif tag not in ("body", "html"):
                depth = last(tag)
                if depth:
                    close_to(depth)
                elif tag == "p":
                    flush()
            continue
        m = NAME.match(text, lt + 1)
        if not m:
            say("<")
            at = lt + 1
            continue
        tag = m[0].lower()
        at = m.end()
        if at < n and text[at] == ">":
            attributes, at = {}, at + 1
        else:
            attributes, at = _attributes(text, at, missing)
        if tag in ("html", "body"):
            close_to(last("head") or len(stack))
            continue
        if last("head") == len(stack) - 1 > 0 and tag not in ("meta", "link", "base", *DROPPED):
            close_to(len(stack) - 1)
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                flush()
            continue
        if tag == "a":
            link = "href" in attributes
            continue
        _, box, dropped, headings, inside = stack[-1]
        names = " ".join(filter(None, (attributes.get("class"), attributes.get("id"), attributes.get("role")))) if attributes else ""
        if tag in RAW:
            end = re.compile(rf"(?i)</{re.escape(tag)}(?=[\s/>])").search(text, at)
            if not end:
                break
            at = text.find(">", end.end())
            at = at + 1 if at >= 0 else n
            continue
        own = 0
        if tag in DROPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true" or ("style" in attributes and INVISIBLE.search(attributes["style"])):
            own = 2
        elif names:
            if _named(names, READERS):
                own = 2
            elif tag not in ("article", "main") and _named(names, BOILERPLATE):
                own = 1
            elif tag in ("article", "main") and _named(names, ADVERTS):
                own = 2
        if tag == "header":
            own, headings = (own, True) if inside else (2, headings)
        if tag not in BLOCKS and not own:
            continue  # inline: its text is its parent's
        if tag in BLOCKS:
            if tag in P_ENDERS and last("p") > max(last("td"), last("th"), last("table"), last("caption"), last("button"), last("object")):
                close_to(last("p"))
            if tag in ENDS:
                limit = max((last(x) for x in SCOPES.get(tag, ("table",))), default=0)
                depth = min((d for d in map(last, ENDS[tag]) if d > limit), default=0)
                if depth:
                    close_to(depth)
            flush()
            _, box, dropped, headings_now, inside = stack[-1]
            headings = headings or headings_now
        if tag in ("article", "main"):
            dropped = 2 if dropped == 2 else 0  # a box that only has such a name isn't one if it holds the article
            inside = True
        dropped = max(dropped, own)
        if tag in CONTAINERS and not dropped:
            page.parent.append(box)
            kind = sorted({DIGITS.sub("", c) for c in attributes.get("class", "").split()} - {""}) if attributes else []
            label = DIGITS.sub("", attributes.get("id", ""))
            page.step.append(tag + "".join(f".{c}" for c in kind) + (f"#{label}" if label else ""))
            special = tag in ("article", "main") or attributes.get("role") in ("article", "main") or "articleBody" in attributes.get("itemprop", "")
            page.boost.append((2.0 if tag != "main" else 1.5) if special else 1.5 if names and _named(names, ARTICLE) else 1.0)
            page.repeats.append(special or bool(kind))
            box = len(page.parent) - 1
        stack.append((tag, box, dropped, headings, inside))
        places.setdefault(tag, []).append(len(stack) - 1)
    while len(stack) > 1:
        close_to(len(stack) - 1)
    flush()
    return page


def gains(page: Page) -> tuple[list[float], list[float]]:
    """Of each container the worth of its blocks: all in it, and those that are in no smaller container."""
    direct = [0.0] * len(page.parent)
    for box, _, worth in page.blocks:
        direct[box] += worth
    whole = direct.copy()
    for i in range(len(whole) - 1, 0, -1):
        whole[page.parent[i]] += whole[i]
    return whole, direct


def best(page: Page) -> int | None:
    """The container with the best score; the innermost of equals. None on a page without text."""
    if not page.blocks:
        return None
    whole, direct = gains(page)
    at = max(range(len(whole)), key=lambda i: (whole[i] * page.boost[i], i))
    if page.boost[at] <= 1:
        # A frame round one large container and some small ones is not the article.
        kids: dict[int, int] = {}
        for i in range(1, len(whole)):
            p = page.parent[i]
            if p not in kids or whole[i] > whole[kids[p]]:
                kids[p] = i
        while page.boost[at] <= 1 and direct[at] <= 0 and at in kids and whole[kids[at]] >= 0.7 * whole[at] > 0:
            at = kids[at]
    return at


def keys(page: Page) -> list[bytes]:
    """Of each container the digest of its generalised path."""
    out = [blake2b(page.step[0].encode("utf-8", "surrogatepass"), digest_size=12).digest()]
    for p, step in zip(page.parent[1:], page.step[1:], strict=True):
        out.append(blake2b(out[p] + step.encode("utf-8", "surrogatepass"), digest_size=12).digest())
    return out


def label(page: Page, at: int) -> str:
    """A path to read: its last steps."""
    steps = []
    while at and len(steps) < LABEL_STEPS:
        steps.append(page.step[at])
        at = page.parent[at]
    return "/".join(["..." if at else "body", *reversed(steps)])


def vote(source: str | None) -> tuple[bytes, str] | None:
    page = read(source)
    at = best(page)
    return None if at is None else (keys(page)[at], label(page, at))


def extract(source: str | None, ranked: list[bytes] | None) -> str:
    """The text at the first of the ranked paths where the page has any, else in its own best container."""
    page = read(source)
    own = best(page)
    if own is None:
        return ""
    chosen: set[int] = {own}
    if ranked:
        has = {box for box, _, _ in page.blocks}
        for i in range(len(page.parent) - 1, 0, -1):
            if i in has:
                has.add(page.parent[i])
        by_key: dict[bytes, list[int]] = {}
        for i, k in enumerate(keys(page)):
            if i in has:
                by_key.setdefault(k, []).append(i)
        for k in ranked:
            if k in by_key:
                found = by_key[k]
                whole, _ = gains(page)
                chosen = set(found) if page.repeats[found[0]] else {max(found, key=whole.__getitem__)}
                break
    within = [False] * len(page.parent)
    for i in range(len(within)):
        within[i] = i in chosen or (i > 0 and within[page.parent[i]])
    return "\n".join(text for box, text, _ in page.blocks if within[box])


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, key, path, votes``: how many of a host's pages have their best container at a generalised path."""
    ship_package(pages.sparkSession)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_runs(batch.column(1)):
                cast = [vote(t) for t in texts]
                names = [pa.array([c and c[0] for c in cast], type=pa.binary()), pa.array([c and c[1] for c in cast], type=pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *names], names=["host", "key", "path"])

    cast = pages.select(host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html")).mapInArrow(votes, "host string, key binary, path string")
    return cast.filter("key is not null").groupBy("host", "key").agg(F.min("path").alias("path"), F.count("*").alias("votes"))


def ranked_paths(votes: DataFrame) -> DataFrame:
    """``host, paths``: keys in order of votes, without those below one percent of the host's."""
    total = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    kept = votes.join(total, "host").filter("100 * votes >= total")
    order = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("rank"), "path", "key")))  # a hundred at most
    return kept.groupBy("host").agg(F.transform(order, lambda x: x["key"]).alias("paths"))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", few: int = 8 << 20, salts: int = 32) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points)."""
    ship_package(pages.sparkSession)
    ranked = cut(ranked_paths(cut(host_paths(pages, url_col, html_col))))
    size = ranked.agg(F.sum(F.octet_length("host") + 20 * F.size("paths") + 40)).first()[0] or 0
    tag = "_"
    while any(c.lower().startswith(tag) for c in pages.columns):
        tag += "_"
    at, salt, paths = f"{tag}host", f"{tag}salt", f"{tag}paths"
    named = pages.withColumn(at, host(F.col(f"`{url_col}`")))
    own = ranked.select(F.col("host").alias(at), F.col("paths").alias(paths))
    if size <= few:
        met = named.join(F.broadcast(own), at, "left")
    else:
        salted = named.withColumn(salt, F.pmod(F.xxhash64(f"`{html_col}`", f"`{url_col}`"), F.lit(salts)))
        met = salted.join(own.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>"))), [at, salt], "left").drop(salt)

    @F.pandas_udf("string")
    def text_of(sources: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([extract(s, list(p) if p is not None else None) for s, p in zip(sources, found, strict=True)], dtype=object)

    keep = [f"`{c}`" for c in pages.columns if c.lower() not in ("text", "n_chars")]
    out = met.select(*keep, text_of(F.col(f"`{html_col}`").cast("string"), F.col(paths)).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
