"""Daily states of counts and exact distinct counts that merge: a snapshot over any days is made of states, not of rows.

Values get dense numbers from a dictionary that only grows; a day's distinct values of a field are then bitmaps of 32,768
numbers each, and distinct values over several days are the union of bitmaps. Facets are a day's counts by value, and
merge by addition. A day is a partition of its own: when its rows change, it alone is read and written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.operators.ranking import dense_ids
from metaloom.session import cut


def _pairs(rows: DataFrame, day: str, fields: list[str]) -> DataFrame:
    """``day, field, value, n``: a day's counts by value; null values do not count."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    return rows.select(F.col(day).alias("day"), each.alias("p")).select("day", "p.*").filter("value is not null").groupBy("day", "field", "value").agg(F.count("*").alias("n"))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_days(rows: DataFrame, day: str, fields: list[str], folder: str) -> None:
    """Writes the states of the days that ``rows`` has, all rows of such a day being there; days that it does not have stay as they are. ``day`` may as well hold weeks or months: a file a day and table is written."""
    spark = rows.sparkSession
    pairs = cut(_pairs(rows, day, fields))
    path = f"{folder}/dictionary"
    seen = pairs.select("field", "value").distinct()
    if _there(spark, path):
        known = spark.read.parquet(path)
        start = known.agg(F.max("id")).first()[0] or 0
        seen = seen.join(known, ["field", "value"], "left_anti")
    else:
        start = 0
    new = dense_ids(seen, ["field", "value"], "id").withColumn("id", F.col("id") + F.lit(start))
    new.select("field", "value", "id").write.mode("append").parquet(path)
    put = lambda df, name: df.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{folder}/{name}")
    put(rows.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n")), "totals")
    put(pairs, "facets")
    coded = pairs.join(spark.read.parquet(path), ["field", "value"])
    bits = coded.groupBy("day", "field", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap"))
    put(bits, "distinct")


def _state(spark: SparkSession, folder: str, name: str, period: Column | None, days: Column | None) -> DataFrame:
    state = spark.read.parquet(f"{folder}/{name}")
    state = state if days is None else state.filter(days)
    return state.withColumn("period", F.lit("all") if period is None else period)


def merged_distinct(spark: SparkSession, folder: str, period: Column | None = None, days: Column | None = None) -> DataFrame:
    """``period, field, distinct_values``: exact distinct counts over the days of each period (``period``: a column of ``day``, one for all by default) that ``days`` lets in."""
    bits = _state(spark, folder, "distinct", period, days).groupBy("period", "field", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return bits.groupBy("period", "field").agg(F.sum(F.bitmap_count("bitmap")).alias("distinct_values"))


def merged_totals(spark: SparkSession, folder: str, period: Column | None = None, days: Column | None = None) -> DataFrame:
    return _state(spark, folder, "totals", period, days).groupBy("period").agg(F.sum("n").alias("rows"))


def merged_facets(spark: SparkSession, folder: str, period: Column | None = None, days: Column | None = None) -> DataFrame:
    """``period, field, value, count`` over the days of each period."""
    return _state(spark, folder, "facets", period, days).groupBy("period", "field", "value").agg(F.sum("n").alias("count"))
