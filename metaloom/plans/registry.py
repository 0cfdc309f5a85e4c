"""How a query is registered: a function of (session, folder), and SQL over the frames it names."""

from __future__ import annotations

from collections.abc import Callable

from metaloom.plans.frames import with_frames

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_frames(sql)
        return fn

    return add
