"""Numbering, cuts, pages, merges, upserts and set operations. Every limit has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.session import cut


def dense_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """1..n in order, without a window over one partition: sorted ranges are counted, and a row's number is its range's offset plus its place."""
    part = F.spark_partition_id()
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", part))
    counts = ranged.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_place", rank).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_offset") + F.col("_place")).cast("long")).drop("_part", "_place", "_offset")


def top_percent(df: DataFrame, score: str, key: str, percent: float) -> DataFrame:
    """The best ``floor(n * p / 100)`` rows, one at least; all from 100 on."""
    if percent >= 100:
        return df
    n = df.agg(F.count("*").alias("_n"))
    ranked = dense_ids(df.withColumn("_neg", -F.col(score)), ["_neg", key], "_rank")
    return ranked.crossJoin(F.broadcast(n)).filter(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * percent / 100))).drop("_neg", "_rank", "_n")


def latest(df: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """The last version of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(seq.desc()))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """``existing`` with ``batch`` written over it: per key the row of the highest ``seq``; batch rows win ties."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return latest(both, keys, F.struct(F.col("_new"), F.col(seq))).drop("_new")


def append_links(existing: DataFrame, batch: DataFrame) -> DataFrame:
    return existing.unionByName(batch).dropDuplicates()


def update_journal(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``inserted, updated`` keys of a batch."""
    b, e = batch.select(*keys).distinct(), existing.select(*keys).distinct()
    new = b.join(e, keys, "left_anti").agg(F.count("*").alias("inserted"))
    return new.crossJoin(b.join(e, keys, "left_semi").agg(F.count("*").alias("updated")))


def first_children(df: DataFrame, parent: str, child: str, n: int = 100) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(parent).orderBy(child))).filter(F.col("_rank") <= n).drop("_rank")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, key: str, last: str, limit: int) -> DataFrame:
    """The next page by key: no rows are skipped over, so deep pages cost as little as the first."""
    return df.filter(F.col(key) > last).orderBy(key).limit(limit)


def budget_merge(sources: list[DataFrame], score: str, key: str, limit: int) -> DataFrame:
    """Hits of the sources in turn, each by score, ``limit`` in all. Each source is cut first, so at most that many rows of each are ranked together."""
    out = None
    for i, df in enumerate(sources):
        part = df.orderBy(F.desc(score), key).limit(limit).withColumn("source_rank", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.orderBy("source_rank", F.desc(score), key).limit(limit)


def union_corpus(parts: list[DataFrame], limit_per_type: int | None = None) -> DataFrame:
    out = None
    for p in parts:
        p = p.orderBy("accession").limit(limit_per_type) if limit_per_type else p
        out = p if out is None else out.unionByName(p)
    return out


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return existing.unionByName(new.dropDuplicates(keys).join(existing, keys, "left_anti"))


def not_yet(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(done, keys, "left_anti")


def pick_snapshot(files: DataFrame, today: Column) -> DataFrame:
    """One file: newest first, the first that is this month's monthly or a daily younger than 7 days; else the newest monthly; else the newest daily."""
    month = F.date_trunc("month", F.col("date")) == F.date_trunc("month", today)
    good = (F.col("kind") == "monthly") & month | (F.col("kind") == "daily") & (F.datediff(today, F.col("date")) < 7)
    rank = F.when(good, 0).when(F.col("kind") == "monthly", 1).otherwise(2)
    return files.withColumn("_rank", rank).orderBy("_rank", F.desc("date"), "name").limit(1).drop("_rank")
