"""Ranks and running sums inside groups of any size, without a window that holds a group in one task.

Rows are range-partitioned by group and order, so a large group is dealt over several partitions. Each partition counts
and sums on its own and the result is written; the last group of a partition may go on in the next one, and what it had
so far is carried there. What is carried has one row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloom.session import cut, ship_package


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it (nulls are equal to each other)."""
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    differs = pc.fill_null(pc.not_equal(here, before), False)
    return pc.or_(differs, pc.xor(pc.is_null(here), pc.is_null(before))).to_numpy(zero_copy_only=False)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """``df`` with ``rank`` (1, 2, ... inside ``keys``, in ``order``) and each of ``sums`` as ``<name>_sum``, its own row included.

    Nulls of keys and order come first and are equal to each other; rows that are equal in all of them come in any order.
    The sums are of long columns without nulls. An empty frame gives an empty one.
    """
    ship_package(df.sparkSession)
    keys, order, sums = list(keys), list(order), list(sums)
    totals = [f"{c}_sum" for c in sums]
    added = [rank, *totals, "_at", "_part", "_first"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, group, first = TaskContext.get().partitionId(), 0, None, True
        held = np.zeros(1 + len(sums), dtype=np.int64)  # what the group has so far
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            for k in keys:
                new[1:] |= _changes(b.column(k))
            head = tuple(b.column(k)[0].as_py() for k in keys)
            new[0] = at > 0 and head != group
            values = np.stack([np.ones(n, dtype=np.int64), *(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in sums)])
            total = np.cumsum(values, axis=1)
            starts = np.flatnonzero(new)
            which = np.cumsum(new)  # 0: the group of the batch before goes on
            base = np.concatenate([-held[:, None], (total - values)[:, starts]], axis=1)
            total -= base[:, which]
            opening = (which == 0) & first
            first = first and not len(starts)
            held, group = total[:, -1].copy(), tuple(b.column(k)[n - 1].as_py() for k in keys)
            more = [*(pa.array(t) for t in total), pa.array(np.arange(at, at + n)), pa.array(np.full(n, part, dtype=np.int32)), pa.array(opening)]
            at += n
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *added])

    kinds = [T.StructField(c, T.LongType()) for c in (rank, *totals, "_at")]
    schema = T.StructType([*df.schema.fields, *kinds, T.StructField("_part", T.IntegerType()), T.StructField("_first", T.BooleanType())])
    ranged = cut(df.repartitionByRange(*(keys + order or [F.lit(0)])).sortWithinPartitions(*(keys + order)).mapInArrow(scan, schema))
    # One row a partition.
    ends = ranged.groupBy("_part").agg(F.min_by(F.struct(*keys, F.lit(0)), "_at").alias("head"), F.max_by(F.struct(*keys, F.lit(0)), "_at").alias("tail"), *(F.max_by(c, "_at").alias(c) for c in (rank, *totals))).orderBy("_part").collect()
    carried, before, so_far = [], None, [0] * (1 + len(sums))
    for row in ends:
        into = so_far if before is not None and row["head"] == before else [0] * len(so_far)
        carried.append((row["_part"], *into))
        own = [row[c] for c in (rank, *totals)]
        so_far = [x + y for x, y in zip(own, into, strict=True)] if row["head"] == row["tail"] else own
        before = row["tail"]
    carry = df.sparkSession.createDataFrame(carried, "_part int, " + ", ".join(f"_carry_{c} long" for c in (rank, *totals)))
    out = ranged.join(F.broadcast(carry), "_part")
    return out.select(*df.columns, *(F.when(F.col("_first"), F.col(c) + F.col(f"_carry_{c}")).otherwise(F.col(c)).alias(c) for c in (rank, *totals)))
