"""Accession lists, archive listings and batch scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def accession_list(lines: DataFrame, c: str = "value") -> DataFrame:
    """``accession`` of each line that is neither blank nor a comment."""
    return lines.select(F.trim(c).alias("accession")).filter("accession <> '' and not startswith(accession, '#')")


def read_accessions(spark: SparkSession, path: str) -> DataFrame:
    return accession_list(spark.read.text(path))


def size_bytes(text: Column) -> Column:
    """``12M`` and the like to bytes."""
    n = F.regexp_extract(text, r"^([0-9.]+)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(text, r"([KMGT])B?$", 1))
    return (n * F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).when(unit == "T", 1 << 40).otherwise(1)).cast("long")


def listing(html: DataFrame, c: str = "html") -> DataFrame:
    """``name, date, kind, size`` of the archives that a listing names; the date is in the name, ``Full`` marks a monthly one."""
    row = r'href="([^"/]*_(?:Full_)?\d{8}[^"/]*\.tar\.gz)"[^\n]*?([0-9.]+[KMGT]?)\s*$'
    found = html.select(F.explode(F.split(c, "\n")).alias("line")).filter(F.col("line").rlike(r"\.tar\.gz"))
    name, size = F.regexp_extract("line", row, 1), F.regexp_extract("line", row, 2)
    out = found.select(name.alias("name"), size_bytes(size).alias("size")).filter("name <> ''")
    return out.select("name", F.to_date(F.regexp_extract("name", r"_(\d{8})", 1), "yyyyMMdd").alias("date"), F.when(F.col("name").contains("Full"), "monthly").otherwise("daily").alias("kind"), "size")


def newest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("date"), "name")


def anchors(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, href`` of every link in a page."""
    return pages.select(key, F.explode(F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]*)"'), 1)).alias("href"))
