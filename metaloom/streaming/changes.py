"""What a stream of versions changes: a log of new, changed and deleted rows, from state kept for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from metaloom.session import ship_package

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def change_of(hash_now: Column, gone: Column, was: Column, was_there: Column) -> Column:
    """``new``, ``changed``, ``deleted`` or null, from a version and the one before it."""
    there = F.coalesce(was_there, F.lit(False))
    return F.when(gone, F.when(there, "deleted")).when(~there, "new").when(~hash_now.eqNullSafe(was), "changed")


def change_log(versions: DataFrame) -> DataFrame:
    """``key, seq, change`` of a table of versions (key, seq, hash, gone)."""
    before = Window.partitionBy("key").orderBy("seq")
    kind = change_of(F.col("hash"), F.col("gone"), F.lag("hash").over(before), F.lag(~F.col("gone")).over(before))
    return versions.select("key", "seq", kind.alias("change")).filter("change is not null")


class _Versions(StatefulProcessor):
    """State of a key: its last sequence number and hash, and whether it is there."""

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, hash string, there boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.last.get()
        seq, value, there = known if known else (None, None, False)
        # Of a key's versions in one batch, three columns are held; the source's trigger bounds a batch.
        batch = pd.concat([r[[c for c in ("seq", "hash", "gone", "at") if c in r]] for r in rows]).sort_values("seq", kind="stable")
        out, newest = [], None
        for row in batch.itertuples(index=False):
            if seq is not None and row.seq <= seq:
                continue  # delivered before
            now = None if pd.isna(row.hash) else row.hash
            change = ("deleted" if there else None) if row.gone else "new" if not there else "changed" if now != value else None
            if change:
                out.append((key[0], row.seq, change))
            seq, value, there = int(row.seq), now, not row.gone
            newest = getattr(row, "at", None)
        if newest is not None and self.keep_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(pd.Timestamp(newest).timestamp() * 1000) + self.keep_ms)
        if seq is not None:
            self.last.update((seq, value, there))
        yield pd.DataFrame(out, columns=["key", "seq", "change"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, _, there = self.last.get()
        self.last.clear()
        yield pd.DataFrame([(key[0], seq, "expired")] if there else [], columns=["key", "seq", "change"])

    def close(self) -> None:
        pass


def changed_rows(stream: DataFrame, keep_seconds: int | None = None) -> DataFrame:
    """``key, seq, change`` of a stream of versions (key, seq, hash, gone), the same as :func:`change_log` however the versions are dealt into batches.

    A key's versions have rising ``seq``; one that is not above the last is passed over, so a batch that is delivered
    again changes nothing. A version with ``gone`` deletes its key; one after that makes it new. With ``keep_seconds``
    the stream has a column ``at`` with a watermark, and a key without a version for so long gives ``expired`` and is
    forgotten.
    """
    spark = stream.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = stream.schema["key"].dataType.simpleString()
    processor = _Versions(None if keep_seconds is None else 1000 * keep_seconds)
    return stream.groupBy("key").transformWithStateInPandas(processor, f"key {kind}, seq long, change string", "append", "None" if keep_seconds is None else "EventTime")


def write_changes(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """The log as a Parquet table, a partition a batch: one that is delivered again overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_changes(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")
