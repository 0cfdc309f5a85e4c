"""Exact dedup by content sort.

Rows are range-partitioned by their normalised text and sorted inside each partition, so that equal texts stand next
to each other; neighbours are compared in full. The sampled splitters hold a prefix of the text, its SHA-256, and the
row's rank in its group (length, id): bounded in size, and a group of any size is dealt over several partitions.
Within a partition a run of equal texts is settled at once; the first and the last run may go on in the next
partition, and those (two a partition) are settled by one small aggregate that is broadcast: it has two rows a
partition at most.

The keyed rows are written first, so that sampling splitters reads short keys and does not normalise and hash all texts
a second time.

Of equal texts the row with the most code points in the original text stays, then the smallest id; an id that is null
comes last; of rows equal in both one stays. Null text counts as empty. Only the id and the text are read; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloom.session import cut, discard, ship_package

WHITE = " \t\n\x0b\x0c\r"
PREFIX = 24


def without_white(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition to rows of (id, keep_id, keep_chars, run_size, digest, head, open, part)."""
    part = TaskContext.get().partitionId()
    names = ["id", "keep_id", "keep_chars", "run_size", "digest", "head", "open", "part"]
    waiting: list[pa.Array] = []  # ids of the run that has not ended
    keep = chars = digest = text = None
    first = True

    def close(last: bool) -> pa.RecordBatch:
        nonlocal first
        ids = pa.concat_arrays(waiting)
        n = len(ids)
        waiting.clear()
        head = np.zeros(n, dtype=bool)
        head[0] = True
        same = lambda v, kind: pa.array(np.full(n, v), type=kind)
        row = [ids, pa.array([keep] * n, type=ids.type), same(chars, pa.int64()), same(n, pa.int64()), pa.array([digest] * n, type=pa.binary()), pa.array(head), same(first or last, pa.bool_()), same(part, pa.int32())]
        first = False
        return pa.RecordBatch.from_arrays(row, names=names)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        norm = batch.column("norm")
        starts = np.ones(n, dtype=bool)
        starts[0] = text is None or norm[0].as_py() != text
        if n > 1:
            starts[1:] = ~pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        text = norm[n - 1].as_py()
        at = np.flatnonzero(starts).tolist()
        ids = batch.column("id")
        if not at or at[0] > 0:
            waiting.append(ids.slice(0, at[0] if at else n))
        if not at:  # the whole batch goes on with the run of the one before
            continue
        for i, j in zip(at, [*at[1:], n], strict=True):
            if waiting:
                held.append(close(False))
            waiting.append(ids.slice(i, j - i))
            keep, chars, digest = ids[i].as_py(), batch.column("chars")[i].as_py(), batch.column("digest")[i].as_py()
        if len(held) > 2000:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held.clear()
    if waiting:
        held.append(close(True))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run of equal texts, whether the run may go on in another partition, and this partition."""
    part = TaskContext.get().partitionId()
    normalised = lambda x: (x or "").encode("utf-8", "surrogatepass").translate(None, WHITE.encode())
    before, waiting, first = None, None, True

    def marked(rows: pa.RecordBatch, open_: bool) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(n, open_), pa.bool_()), pa.array(np.full(n, part), pa.int32())], names=[*rows.schema.names, "open", "part"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        digest, text = batch.column("digest"), batch.column("text").cast(pa.large_string())
        same = np.zeros(n, dtype=bool)
        same[0] = before is not None and before[0] == digest[0].as_py() and normalised(before[1]) == normalised(text[0].as_py())
        if n > 1:
            same[1:] = pc.equal(digest.slice(1), digest.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(same[1:]) + 1:
                same[i] = normalised(text[i].as_py()) == normalised(text[i - 1].as_py())
        before = digest[n - 1].as_py(), text[n - 1].as_py()
        at = np.flatnonzero(~same)
        if len(at):
            if waiting is not None:
                yield marked(waiting, first)
                first = False
            if len(at) > 1:
                yield marked(batch.take(pa.array(at[:1])), first)
                first = False
                yield marked(batch.take(pa.array(at[1:-1])), False)
            waiting = batch.take(pa.array(at[-1:]))
    if waiting is not None:
        yield marked(waiting, True)


def _order() -> list[Column]:
    return [F.col("prefix"), F.col("digest"), F.col("chars").desc(), F.col("id").asc_nulls_last()]


def _keys(df: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    norm = without_white(F.col(f"`{text_col}`"))
    chars = F.length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).cast("long")
    return {"id": F.col(f"`{id_col}`"), "norm": norm, "chars": chars, "digest": F.unhex(F.sha2(norm, 256)), "prefix": F.substring(norm, 1, PREFIX)}


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    ship_package(df.sparkSession)
    rows = cut(df.select(*(c.alias(n) for n, c in _keys(df, id_col, text_col).items())))
    kind = rows.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("id", kind), T.StructField("keep_id", kind), T.StructField("keep_chars", T.LongType()), T.StructField("run_size", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("head", T.BooleanType()), T.StructField("open", T.BooleanType()), T.StructField("part", T.IntegerType())]
    )
    runs = cut(rows.repartitionByRange(*_order()).sortWithinPartitions(*_order()).select("id", "norm", "chars", "digest").mapInArrow(_runs, schema))
    discard(rows)
    best = F.struct((-F.col("keep_chars")).alias("a"), F.col("keep_id").isNull().alias("b"), F.col("keep_id").alias("c"), F.col("part").alias("d"))
    across = runs.filter("open and head").groupBy(F.col("digest").alias("open_digest")).agg(F.sum("run_size").alias("all_size"), F.min(best).alias("best"))
    joined = runs.join(F.broadcast(across), (F.col("digest") == F.col("open_digest")) & F.col("open"), "left")
    mine = F.col("best").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(mine, F.col("keep_id")).otherwise(F.col("best.c")).alias("keep_id"),
        F.when(mine, F.col("run_size")).otherwise(F.col("all_size")).alias("group_size"),
        (F.col("head") & (mine | (F.col("best.d") == F.col("part")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with their own columns: exactly one row a group, whatever repeats. The rows themselves go through the sort."""
    ship_package(df.sparkSession)
    keys = _keys(df, id_col, text_col)
    del keys["norm"]  # made anew from the text for the neighbours that need it
    others = [c for c in df.columns if c not in (text_col, id_col)]
    held = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("boolean")
    rows = cut(df.select(F.col(f"`{text_col}`").alias("text"), held.alias("row"), *(c.alias(n) for n, c in keys.items())))
    carried = rows.select("id", "text", "row", "digest").schema
    schema = T.StructType([*carried.fields, T.StructField("open", T.BooleanType()), T.StructField("part", T.IntegerType())])
    heads = cut(rows.repartitionByRange(*_order()).sortWithinPartitions(*_order()).select("id", "text", "row", "digest").mapInArrow(_heads, schema))
    discard(rows)
    across = heads.filter("open").groupBy(F.col("digest").alias("open_digest")).agg(F.min("part").alias("first_part"))
    joined = heads.join(F.broadcast(across), (F.col("digest") == F.col("open_digest")) & F.col("open"), "left")
    own = {text_col: F.col("text"), id_col: F.col("id")}
    return joined.filter("first_part is null or first_part = part").select(*((own[c] if c in own else F.col(f"row.`{c}`")).alias(c) for c in df.columns))
