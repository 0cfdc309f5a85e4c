"""Counts, top values, facets, pool figures and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUPABLE = ("organism", "library_strategy", "platform", "study_type", "library_source", "library_layout", "type", "lang", "source")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


def statistics_table(tables: dict[str, DataFrame], now: Column | None = None) -> DataFrame:
    return row_counts(tables).withColumn("last_updated", F.current_timestamp() if now is None else now)


def top_values(df: DataFrame, field: str, n: int = 10, keep_blank: bool = False) -> DataFrame:
    """``value, count`` of the ``n`` most frequent; null never counts, blank only with ``keep_blank``; ties by value."""
    if field not in GROUPABLE:
        raise ValueError(f"field {field} can't be grouped by")
    rows = df.filter(F.col(field).isNotNull())
    rows = rows if keep_blank else rows.filter(F.col(field) != "")
    return rows.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(n)


def facets(hits: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """``field, value, count`` over all hits, each field cut to its size."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in sizes)))
    counts = hits.select(pairs.alias("p")).select("p.*").filter("value is not null and value <> ''").groupBy("field", "value").agg(F.count("*").alias("count"))
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)), F.col("field"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("count"), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")


def pool_sizes(pools: DataFrame) -> DataFrame:
    """``pools, average_size, largest_size``; zeros if there is none."""
    sizes = pools.groupBy("parent_sample").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("pools"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("average_size"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_size"))


def pool_proportions(pools: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Pools whose positive proportions do not sum to 1 within the tolerance are not valid; pools without any are."""
    total = pools.groupBy("parent_sample").agg(F.sum(F.when(F.col("proportion") > 0, F.col("proportion"))).alias("total"))
    return total.select("parent_sample", F.round("total", 6).alias("total"), (F.col("total").isNull() | (F.abs(F.round(F.col("total") - 1, 9)) <= tolerance)).alias("valid"))


def overview(studies: DataFrame, experiments: DataFrame, samples: DataFrame, runs: DataFrame, submissions: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: five counts, three distinct counts, bases, latest date."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return (
        studies.agg(F.count("*").alias("studies"), distinct("organism").alias("organisms"))
        .crossJoin(experiments.agg(F.count("*").alias("experiments"), distinct("platform").alias("platforms"), distinct("library_strategy").alias("strategies")))
        .crossJoin(one(samples, "samples"))
        .crossJoin(runs.agg(F.count("*").alias("runs"), F.sum("total_bases").alias("bases"), F.max("published").alias("last_update")))
        .crossJoin(one(submissions, "submissions"))
    )


def runs_with_statistics(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("runs"), F.count_if(F.col("total_spots") > 0).alias("with_spots"))


def cross_references(links: DataFrame) -> DataFrame:
    """Of each record the databases it refers to, with their ids in order."""
    x = links.filter("link_type = 'xref' and db <> ''").groupBy("record_type", "record_accession", "db").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return x.groupBy("record_type", "record_accession").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("db", "ids")))).alias("refs"))


def match_rate(matched: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """``matched, processed, percent``; 0 % of nothing."""
    return matched.agg(F.countDistinct(key).alias("matched")).crossJoin(processed.agg(F.countDistinct(key).alias("processed"))).withColumn("percent", F.coalesce(F.try_divide(F.col("matched") * 100.0, F.col("processed")), F.lit(0.0)))


def counts_with_zeros(df: DataFrame, field: str, values: list[str]) -> DataFrame:
    spark = df.sparkSession
    known = spark.createDataFrame([(v,) for v in values], f"{field} string")
    return known.join(df.groupBy(field).agg(F.count("*").alias("count")), field, "left").na.fill(0, ["count"])


def reconcile(index: DataFrame, source: DataFrame) -> DataFrame:
    """Both ``type, documents``: the counts side by side and their difference."""
    a, b = index.select("type", F.col("documents").alias("indexed")), source.select("type", F.col("documents").alias("stored"))
    return a.join(b, "type", "full").na.fill(0, ["indexed", "stored"]).withColumn("difference", F.col("indexed") - F.col("stored"))


def study_children(experiments: DataFrame) -> DataFrame:
    """``study_accession, platforms, strategies``: the platforms joined in order, the strategies counted."""
    return experiments.groupBy("study_accession").agg(F.array_join(F.array_sort(F.collect_set("platform")), ",").alias("platforms"), F.countDistinct("library_strategy").alias("strategies"))


def top_groups(df: DataFrame, by: list[str], n: int, name: str = "count") -> DataFrame:
    """The ``n`` largest groups, ties by their values."""
    return df.groupBy(*by).agg(F.count("*").alias(name)).orderBy(F.desc(name), *by).limit(n)
