"""Incremental work: files once, changed rows, upserts by batch, manifests, retention.

A file source with a checkpoint processes each file once and goes on where it stopped; ``foreachBatch`` writes are
keyed, so a batch that is delivered again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metaloom.functions.scalars import rate
from metaloom.operators.ranking import latest
from metaloom.sources.xml import READ_SCHEMAS


def new_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return files.join(manifest.select("source_hash"), "source_hash", "left_anti")


def with_source_hash(files: DataFrame, name: str = "file") -> DataFrame:
    return files.withColumn("source_hash", F.sha2(name, 256))


def start_or_resume(manifest: DataFrame, source: str, force: bool = False) -> str:
    """``resume``, ``done`` or ``start`` for one source, by its state in the manifest."""
    row = manifest.filter(F.col("source_hash") == F.sha2(F.lit(source), 256)).select("state").take(1)
    if force or not row or row[0][0] == "failed":
        return "start"
    return "done" if row[0][0] == "completed" else "resume"


def next_action(state: Column) -> Column:
    """The same for a whole table of sources: what a state in the manifest asks for."""
    return F.when(state == "completed", "done").when(state.isNull() | (state == "failed"), "start").otherwise("resume")


def xml_stream(spark: SparkSession, folder: str, tag: str) -> DataFrame:
    return spark.readStream.format("xml").option("rowTag", tag).option("ignoreCorruptFiles", "true").schema(READ_SCHEMAS[tag]).load(folder)


def upsert_stream(stream: DataFrame, target: str, keys: list[str], seq: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Rows of a stream written over the Parquet table at ``target``.

    Each batch is one partition ``batch=number`` with its last row of each key: what is written grows with the batch, not
    with the table, and a batch that is delivered again overwrites its own partition. Readers take the newest row of a
    key; :func:`compact` writes the table anew when too many batches have gathered.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, keys, F.col(seq)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def latest_version(spark: SparkSession, target: str, keys: list[str], seq: str) -> DataFrame:
    """The table as it is now: per key the row of the last batch that has it."""
    return latest(spark.read.parquet(target), keys, F.struct(F.col("batch"), F.col(seq))).drop("batch")


def compact(spark: SparkSession, target: str, into: str, keys: list[str], seq: str) -> None:
    """The table as it is now as a table of one batch at ``into``, under the number of its last batch; the stream goes on there with the same checkpoint."""
    rows = spark.read.parquet(target)
    last = rows.agg(F.max("batch")).first()[0]
    latest(rows, keys, F.struct(F.col("batch"), F.col(seq))).drop("batch").write.mode("overwrite").parquet(f"{into}/batch={last}")


def periodic(stream: DataFrame, sync: Callable[[DataFrame, int], None], seconds: int, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(sync).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def file_log(rows: DataFrame, file: str, batch: str) -> DataFrame:
    """Records and a checksum of each file; the checksum does not depend on the rows' order."""
    others = [c for c in rows.columns if c not in (file, batch)]
    return rows.groupBy(batch, file).agg(F.count("*").alias("records"), F.bit_xor(F.xxhash64(*others)).alias("checksum"))


def changes(current: DataFrame, previous: DataFrame, key: str, hash_col: str = "hash") -> DataFrame:
    """``key, change``: new, changed or deleted against the last hashes."""
    a, b = current.select(key, F.col(hash_col).alias("now")), previous.select(key, F.col(hash_col).alias("was"))
    kind = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("was"), "changed")
    return a.join(b, key, "full").select(key, kind.alias("change")).filter("change is not null")


def recent(df: DataFrame, now: Column, c: str = "updated_at") -> DataFrame:
    """Rows of the last hour; all rows if there is no such column."""
    return df.filter(F.col(c) > now - F.expr("INTERVAL 1 HOUR")) if c in df.columns else df


def ingest_statistics(manifest: DataFrame) -> DataFrame:
    """One row: files, records, bytes, rates, percent done, seconds to go."""
    s = manifest.agg(F.count("*").alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), F.sum("total_bytes").alias("total_bytes"), F.sum("seconds").alias("seconds"))
    speed = rate(F.col("bytes"), F.col("seconds"))
    left = (F.col("total_bytes") - F.col("bytes")).cast("double")
    return s.select("files", "records", "bytes", F.round(rate(F.col("records"), F.col("seconds")), 4).alias("records_s"), F.round(speed, 4).alias("bytes_s"), F.round(rate(F.col("bytes") * 100, F.col("total_bytes")), 4).alias("percent"), F.round(F.coalesce(F.try_divide(left, speed), F.lit(0.0)), 4).alias("eta_s"))


def retained(progress: DataFrame, children: list[DataFrame], cutoff: Column, key: str = "progress_id") -> list[DataFrame]:
    """The frames without finished progress older than the cutoff."""
    gone = progress.filter((F.col("state").isin("completed", "failed")) & (F.col("updated_at") < cutoff)).select(key)
    return [df.join(gone, key, "left_anti") for df in (progress, *children)]
