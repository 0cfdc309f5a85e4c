"""Sharding by longest-processing-time scheduling.

Rows of equal text form a group and stay together. Groups sorted by size go, largest first, to the least-loaded shard,
which a heap gives. So that the schedule has a bounded number of entries whatever the input's size, groups smaller
than ``1 / items`` of all bytes are first put into ``items`` buckets by a hash of their text; a larger group stands
alone, and there are fewer than ``items`` of those. The schedule thus has fewer than ``2 * items`` entries at any
size; it is made on the driver from these sums and goes back as a broadcast table of that many rows. With fewer groups
than buckets nearly every group is scheduled alone.

Slots number a shard's rows without gaps: rows are dealt into cells by a hash of a mark that each row gets when it is first
written, cells are counted, and a row's slot is its cell's offset plus its rank in the cell, so that no task sorts a whole
shard, however often a row repeats.

A null text has the size of an empty one and is in its group. A group larger than a fair share makes its shard larger:
it is never split. The law is ``bytes``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.session import cut

ITEMS = 16_384
CELL_ROWS = 1000


def schedule(sizes: list[tuple[int, object]], shards: int) -> list[tuple[object, int]]:
    """Longest first to the least loaded; ties by name and by shard number."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for size, name in sorted(sizes, key=lambda x: (-x[0], str(x[1]))):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out.append((name, shard))
    return out


def shard_rows(df: DataFrame, shards: int = 40, extra: int = 16, id_col: str = "doc_id", text_col: str = "text", items: int = ITEMS) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of each row."""
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = cut(
        df.select(
            F.col(f"`{id_col}`").alias("id"),
            (F.octet_length(text) + extra).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("crc"),
            F.unhex(F.sha2(text, 256)).alias("key"),
            F.monotonically_increasing_id().alias("mark"),
        ).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(items)).cast("int"))
    )
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = rows.groupBy("key", "bucket").agg(F.sum("size").alias("size"))
    alone = F.col("size") * items > total
    entries = groups.groupBy(F.when(alone, F.col("key")).alias("key"), F.when(~alone, F.col("bucket")).alias("bucket")).agg(F.sum("size").alias("size")).collect()
    plan = schedule([(r["size"], r["bucket"] if r["key"] is None else bytes(r["key"])) for r in entries], shards)
    of_bucket = spark.createDataFrame([x for x in plan if isinstance(x[0], int)], "bucket int, bucket_shard int")
    of_key = spark.createDataFrame([x for x in plan if not isinstance(x[0], int)], "key binary, key_shard int")
    placed = rows.join(F.broadcast(of_key), "key", "left").join(F.broadcast(of_bucket), "bucket", "left").withColumn("shard", F.coalesce("key_shard", "bucket_shard"))
    cells = max(1, -(-count // (shards * CELL_ROWS)))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("mark"), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "cell").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("mark"))
    return (
        placed.withColumn("rank", rank)
        .join(offsets, ["shard", "cell"])
        .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
