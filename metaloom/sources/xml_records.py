"""Records cut out of XML texts that come in pieces, whatever comments, CDATA, quotes or prefixes they hold.

A piece ends right after a ``>``, so no delimiter is ever split, but it may end inside a comment, a CDATA section, a
processing instruction, a document type or a quoted attribute. Where a piece is entered is not known to the task that
has it; it finds out for each of the few states what state the piece ends in and where the last record opened. These
transitions are functions that compose, so one pass over them, a row a piece, tells every piece its state; then pieces
are cut independently, and what is left of records that span pieces is put together by the place where they began.

Elements of the records' kind are not nested in each other: a start inside an open record means that the open one was
never closed. Records that are not closed, are not UTF-8 or do not parse stay as text in the quarantine; they do not cost
the records after them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.session import cut, ship_package

TEXT, COMMENT, CDATA, INSTRUCTION, DOCTYPE = range(5)
#: Inside a quoted value of a tag: of any other tag, a record's start or its end; by quote.
QUOTED = {(kind, quote): 5 + 2 * k + q for k, kind in enumerate(("other", "start", "end")) for q, quote in enumerate((b'"', b"'"))}
STATES = 5 + len(QUOTED)
_BACK = {v: k for k, v in QUOTED.items()}
CLOSES = {COMMENT: re.compile(rb"-->"), CDATA: re.compile(rb"\]\]>"), INSTRUCTION: re.compile(rb"\?>"), DOCTYPE: re.compile(rb"\]\s*>")}
REST = re.compile(rb"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:(>)|([\"'])|\Z)")


@lru_cache
def _token(tag: str) -> re.Pattern[bytes]:
    name = re.escape(tag.encode())
    return re.compile(rb"<(?:(!--)|(!\[CDATA\[)|(\?)|(![^\[>]*+(?:(\[)|>))|(/?)((?:[^\s<>/:\"']+:)?+" + name + rb"(?=[\s/>]))?)")


def _after_tag(data: bytes, at: int, kind: str, events: list) -> tuple[int, int]:
    """From inside a tag: where it ends, and the state there."""
    m = REST.match(data, at)
    if m[2]:
        return len(data), QUOTED[kind, m[2]]
    if m[1] and (kind == "end" or kind == "start" and data[m.end() - 2 : m.end() - 1] == b"/"):
        events.append(("E", m.end()))
    return m.end(), TEXT


def lex(data: bytes, state: int, tag: str, seen: dict[int, tuple[int, int]] | None = None) -> tuple[int, list[tuple[str, int]]]:
    """The state at the piece's end, and places where records start (``S``, before the tag) or end (``E``, behind it).

    ``seen`` (place of a token: number of events before it, and a shared list) is filled by a run from TEXT, so that runs
    from other states stop where they meet it.
    """
    events: list[tuple[str, int]] = []
    at = 0
    if state in CLOSES:
        m = CLOSES[state].search(data)
        if not m:
            return state, events
        at = m.end()
    elif state in _BACK:
        kind, quote = _BACK[state]
        end = data.find(quote, 0)
        if end < 0:
            return state, events
        at, state = _after_tag(data, end + 1, kind, events)
        if state != TEXT:
            return state, events
    token = _token(tag)
    while m := token.search(data, at):
        if seen is not None:
            if m.start() in seen:
                return -1 - m.start(), events
            seen[m.start()] = (len(events), 0)
        at = m.end()
        for group, inside in ((1, COMMENT), (2, CDATA), (3, INSTRUCTION), (5, DOCTYPE)):
            if m[group]:
                end = CLOSES[inside].search(data, at)
                if not end:
                    return inside, events
                at = end.end()
                break
        else:
            if m[4]:
                continue
            kind = "other" if m[7] is None else "end" if m[6] else "start"
            if kind == "start":
                events.append(("S", m.start()))
            at, state = _after_tag(data, at, kind, events)
            if state != TEXT:
                return state, events
    return TEXT, events


def transitions(data: bytes, tag: str) -> list[tuple[int, int]]:
    """Of each state of entry: the state at the end, and the place of the record that is open then (-1: none is, -2: whichever was before)."""
    seen: dict[int, tuple[int, int]] = {}
    main, whole = lex(data, TEXT, tag, seen)
    out = []
    for state in range(STATES):
        end, events = (main, whole) if state == TEXT else lex(data, state, tag, dict.fromkeys(seen, (0, 0)))
        if end < 0:  # from this place on it is as in the run from TEXT
            events = events + whole[seen[-1 - end][0] :]
            end = main
        last = events[-1] if events else None
        out.append((end, -2 if last is None else last[1] if last[0] == "S" else -1))
    return out


def fragments(data: bytes, state: int, inside: bool, tag: str) -> list[tuple[int, bytes, bool, bool]]:
    """What the piece holds of records: start (-1: before this piece), bytes, whether it ends here, whether another start broke it off."""
    _, events = lex(data, state, tag)
    out = []
    begun = -1 if inside else None
    for kind, at in events:
        if begun is not None:
            out.append((begun, data[max(begun, 0) : at], kind == "E", kind == "S"))
        begun = at if kind == "S" else None
    if begun is not None:
        out.append((begun, data[max(begun, 0) :], False, False))
    return out


def cut_records(pieces: DataFrame, tag: str, largest: int = 64 << 20) -> DataFrame:
    """``archive, member, record, error`` of ``pieces`` (archive, member, piece, xml as bytes): records in UTF-8 with no error, and what is none.

    Texts of more than ``largest`` bytes without an end are not put together: each of their parts stays in the quarantine.
    """
    ship_package(pieces.sparkSession)
    pieces = pieces.select("archive", "member", "piece", "xml").filter("xml is not null")

    @F.pandas_udf("array<struct<state: int, open: long>>")
    def steps(texts: pd.Series) -> pd.Series:
        return texts.map(lambda b: [{"state": s, "open": o} for s, o in transitions(bytes(b), tag)])

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, first, at = None, TEXT, -1, -1
        for b in batches:
            rows = []
            for archive, member, piece, table in zip(b["archive"], b["member"], b["piece"], b["steps"], strict=True):
                if (archive, member) != now:
                    now, state, first, at = (archive, member), TEXT, -1, -1
                rows.append((archive, member, piece, state, first, at))
                step = table[state]
                state = int(step["state"])
                if step["open"] == -1:
                    first, at = -1, -1
                elif step["open"] >= 0:
                    first, at = piece, int(step["open"])
            yield pd.DataFrame(rows, columns=["archive", "member", "piece", "state", "first", "at"])

    known = pieces.select("archive", "member", "piece", steps("xml").alias("steps"))
    entered = cut(known.repartition("archive", "member").sortWithinPartitions("archive", "member", "piece").mapInPandas(states, "archive string, member string, piece int, state int, first int, at long"))

    @F.pandas_udf("array<struct<begun: long, part: binary, closed: boolean, broken: boolean>>")
    def cuts(texts: pd.Series, state: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("begun", "part", "closed", "broken"), f, strict=True)) for f in fragments(bytes(t), int(s), x >= 0, tag)] for t, s, x in zip(texts, state, first, strict=True)])

    parts = pieces.join(entered, ["archive", "member", "piece"]).select("archive", "member", "piece", "first", "at", F.explode(cuts("xml", "state", "first")).alias("f"))
    parts = parts.select("archive", "member", "piece", F.when(F.col("f.begun") < 0, F.col("first")).otherwise(F.col("piece")).alias("first"), F.when(F.col("f.begun") < 0, F.col("at")).otherwise(F.col("f.begun")).alias("at"), "f.part", "f.closed", "f.broken")
    parts = cut(parts)
    inside = (F.col("first") == F.col("piece")) & (F.col("closed") | F.col("broken"))
    whole = parts.filter(inside).select("archive", "member", F.col("part").alias("bytes"), "closed")
    key = ["archive", "member", "first", "at"]
    spanning = parts.filter(~inside)
    sizes = spanning.groupBy(*key).agg(F.sum(F.octet_length("part")).alias("size"))
    small = spanning.join(sizes.filter(F.col("size") <= largest), key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("piece", "part"))).alias("parts"), F.max("closed").alias("closed"))
    joined = small.select("archive", "member", F.aggregate(F.transform("parts", lambda p: p["part"]), F.lit(b""), lambda a, b: F.concat(a, b)).alias("bytes"), "closed")
    large = spanning.join(sizes.filter(F.col("size") > largest), key).select("archive", "member", F.col("part").alias("bytes"), F.lit(False).alias("closed"))
    text = F.col("bytes").cast("string")
    error = F.when(~F.is_valid_utf8(text), "not UTF-8").when(~F.col("closed"), "not closed")
    return whole.unionByName(joined).unionByName(large).select("archive", "member", F.make_valid_utf8(text).alias("record"), error.alias("error"))
