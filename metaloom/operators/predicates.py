"""Filters as columns: lists, ranges, dates, substrings, and the account of why a record was left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions import scalars


def in_lists(c: Column, include: list | None = None, exclude: list | None = None) -> Column:
    """Included (an empty list includes all) and not excluded; null is in neither list."""
    ok = F.coalesce(c.isin(include), F.lit(False)) if include else F.lit(True)
    return ok & ~F.coalesce(c.isin(exclude), F.lit(False)) if exclude else ok


def by_platform(c: Column, platforms: list[str]) -> Column:
    return in_lists(c, [p.upper() for p in platforms])


def by_strategy(c: Column, wanted: list[str]) -> Column:
    """The list is normalised like the data; a blank strategy fails."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(c.isin(*[F.element_at(scalars._map(scalars.schemas.STRATEGY_SPELLINGS), F.lit(w.strip().lower())) if w.strip().lower() in scalars.schemas.STRATEGY_SPELLINGS else F.lit(w) for w in wanted]), F.lit(False))


def by_study_type(c: Column, wanted: list[str]) -> Column:
    return c.isNull() | (c == "") | c.isin(wanted) if wanted else F.lit(True)


def date_between(d: Column, low: str | None, high: str | None) -> Column:
    """Inclusive at both ends; without a date a record fails as soon as a bound is set."""
    if not low and not high:
        return F.lit(True)
    ok = d.isNotNull()
    ok = ok & (d >= F.lit(low).cast("date")) if low else ok
    return ok & (d <= F.lit(high).cast("date")) if high else ok


def first_date(attributes: Column) -> Column:
    """The first attribute among the date tags that parses, in two formats."""
    tags = ("submission_date", "ena-first-public", "ena-last-update")
    dated = F.filter(F.transform(F.filter(attributes, lambda a: F.lower(a["tag"]).isin(*tags)), lambda a: scalars.parse_time(a["value"], ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ssXXX"))), lambda t: t.isNotNull())
    return F.to_date(F.try_element_at(dated, F.lit(1)))


def counts_between(c: Column, low: int = 0, high: int = 0) -> Column:
    """A bound of 0 is unset; a record without the number passes."""
    ok = F.lit(True)
    ok = ok & (c >= low) if low else ok
    ok = ok & (c <= high) if high else ok
    return c.isNull() | ok


def all_of(*preds: Column) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def contains(c: Column, term: str) -> Column:
    """Substring in any case; ``%`` and ``_`` in the term stay wildcards."""
    return c.ilike(f"%{term}%")


def account(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``outcome, records``: records by the first check that fails, or ``matched``."""
    why = F.coalesce(*(F.when(~ok, F.lit(name)) for name, ok in checks.items()), F.lit("matched"))
    return df.groupBy(why.alias("outcome")).agg(F.count("*").alias("records"))


def field_equals(df: DataFrame, field: str, value: str, aliases: dict[str, str] | None = None) -> Column:
    name = (aliases or {}).get(field, field)
    if name not in df.columns:
        raise ValueError(f"unknown field {field}")
    return F.lower(F.col(name)) == value.lower()


def wildcard(c: Column, pattern: str) -> Column:
    """``*`` any characters, ``?`` one; over the whole value, in any case."""
    escaped = "".join(".*" if x == "*" else "." if x == "?" else "\\" + x if not x.isalnum() else x for x in pattern.lower())
    return F.lower(c).rlike(f"^{escaped}$")


def in_range(c: Column, low, high) -> Column:
    return c.between(low, high)


def must(*preds: Column) -> Column:
    return all_of(*preds)


def should(*preds: Column) -> Column:
    return reduce(lambda a, b: a | b, preds, F.lit(False))


def must_not(pred: Column) -> Column:
    return ~F.coalesce(pred, F.lit(False))


def json_equals(json: Column, field: str, value: str) -> Column:
    """A field of a JSON text has this value."""
    return F.get_json_object(json, f"$.{field}") == value


def of_record(record_type: str, accession: str, type_col: str = "record_type", key: str = "record_accession") -> Column:
    """Rows that belong to one record: its identifiers, its links."""
    return (F.col(type_col) == record_type) & (F.col(key) == accession)
