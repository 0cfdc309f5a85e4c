"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class j holds documents of more than ``capacity / (j + 1)`` and at most
``capacity / j`` tokens, and a bin of class j takes j of them, which always fit, whatever they are. What is at most
``capacity / classes`` long fills bins of the last class in order. A document longer than a sequence gives whole
sequences, and only its remainder goes on. So no document that fits a sequence is cut on the way.

A class's full bin has room left: ``rooms``, a list of bounded length, keeps those bins open for a while. A document that
fits one nearly exactly goes there instead of its class, and the remainders of long documents, which are cut anyway, fill
rooms in up to ``CUTS`` further cuts. Bins beyond the bound are given out, the fullest first, and padded.

Each Spark task fills its own bins from its own partition, and numbers them by partition and order: no shuffle, no
shared state, and a task that runs again gives the same rows as long as its partition is read alike. At a task's end
the open bins are put together, whole documents first; then the emptiest are cut up to fill the others, and the last is
cut into sequences of power-of-two length, which need no padding. Only there, in a bounded number of bins a task, is a
document cut that would fit whole.

A null text is empty; every document has its closing id, so at least one piece. A null id stays null. Repeated rows
are packed as often as they occur.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloom.llm import bpe_codec
from metaloom.session import ship_package

FIELDS = (("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"))
SEQUENCES_A_TASK = 1 << 36


CUTS = 3


class Bins:
    """The open bins of one task. Pieces are (document, start, ids, document's tokens); ``out`` takes (piece, sequence, offset)."""

    def __init__(self, capacity: int, classes: int, first: int, out: Callable, waiting: int = 1024):
        self.capacity, self.classes, self.next, self.out, self.waiting = capacity, classes, first, out, waiting
        self.least = max(1, capacity // 64)  # so little room is not worth a piece
        self.open: dict[int, list] = {}
        self.rooms: list[tuple[int, int, list]] = []  # room, order, pieces; by room
        self.order = 0

    def emit(self, pieces: list) -> None:
        at = 0
        for p in pieces:
            self.out(p, self.next, at)
            at += len(p[2])
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.capacity:
            self.emit([(doc, at, ids[at : at + self.capacity], total)])
            at += self.capacity
        if at < total:
            piece = (doc, at, ids[at:], total)
            self.put(self.fill(piece) if at else piece)

    def fill(self, piece: tuple) -> tuple | None:
        """Cuts a long document's remainder into the largest rooms; what is left."""
        for _ in range(CUTS):
            if piece is None or not self.rooms or self.rooms[-1][0] >= len(piece[2]):
                break
            room, _, pieces = self.rooms.pop()
            doc, start, ids, total = piece
            self.emit([*pieces, (doc, start, ids[:room], total)])
            piece = (doc, start + room, ids[room:], total) if len(ids) > room else None
        return piece

    def put(self, piece: tuple | None) -> None:
        """A piece of at most a sequence: to a room that it fits nearly exactly (a remainder: to the least that holds it), else to its class."""
        if piece is None:
            return
        n = len(piece[2])
        k = bisect.bisect_left(self.rooms, (n,))
        if k < len(self.rooms) and (piece[1] or self.rooms[k][0] - n <= self.least):
            room, _, pieces = self.rooms.pop(k)
            self.shut([*pieces, piece], room - n)
            return
        j = min(self.capacity // n, self.classes)
        held = self.open.setdefault(j, [])
        if j == self.classes and sum(len(p[2]) for p in held) + n > self.capacity:
            self.shut(self.open.pop(j))
            held = self.open.setdefault(j, [])
        held.append(piece)
        if j < self.classes and len(held) == j:
            self.shut(self.open.pop(j))

    def shut(self, pieces: list, room: int | None = None) -> None:
        room = self.capacity - sum(len(p[2]) for p in pieces) if room is None else room
        if room <= self.least:
            self.emit(pieces)
            return
        self.order += 1
        bisect.insort(self.rooms, (room, self.order, pieces))
        if len(self.rooms) > self.waiting:
            self.emit(self.rooms.pop(0)[2])

    def close(self) -> None:
        bins = [[room, pieces] for room, _, pieces in self.rooms]
        for p in sorted((p for j in sorted(self.open) for p in self.open[j]), key=lambda p: -len(p[2])):
            n = len(p[2])
            fits = min((b for b in bins if b[0] >= n), key=lambda b: b[0], default=None)
            if fits is None:
                bins.append([self.capacity - n, [p]])
            else:
                fits[0] -= n
                fits[1].append(p)
        self.open, self.rooms = {}, []
        bins.sort(key=lambda b: b[0])
        # The emptiest bin is cut up to fill the fullest, until one is left.
        while len(bins) > 1:
            room, pieces = bins[0]
            while room and len(bins) > 1:
                last = bins[-1]
                doc, start, ids, total = last[1].pop()
                take = min(room, len(ids))
                pieces.append((doc, start, ids[:take], total))
                if take < len(ids):
                    last[1].append((doc, start + take, ids[take:], total))
                room, last[0] = room - take, last[0] + take
                if not last[1]:
                    bins.pop()
            if room:
                break
            self.emit(bins.pop(0)[1])
        rest = [p for b in bins for p in b[1]]
        left = sum(len(p[2]) for p in rest)
        rest.reverse()
        while left:
            room = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= room
            own = []
            while room:
                doc, start, ids, total = rest.pop()
                if len(ids) > room:
                    rest.append((doc, start + room, ids[room:], total))
                    ids = ids[:room]
                own.append((doc, start, ids, total))
                room -= len(ids)
            self.emit(own)


def pack(df: DataFrame, path: str, capacity: int = 1024, classes: int = 32, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: the id column, FIELDS, and with ``with_ids`` the piece's ids as ``array<int>``. ``capacity`` is a power of two."""
    if capacity < 1 or capacity & (capacity - 1) or not 0 < classes <= capacity:
        raise ValueError("capacity must be a power of two, classes at most capacity")
    ship_package(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField(id_col, docs.schema["doc"].dataType), *(T.StructField(n, T.LongType()) for n, _ in FIELDS)] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out(piece: tuple, sequence: int, offset: int) -> None:
            doc, start, ids, total = piece
            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, *([ids.astype(np.int32)] if with_ids else ())))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], type=kind), *(pa.array(c, type=pa.int64()) for c in columns[1:7]), *(pa.array(c, type=pa.list_(pa.int32())) for c in columns[7:])], names=[id_col, *(n for n, _ in FIELDS), *["ids"] * with_ids])

        kind = pa.int64()
        bins = Bins(capacity, classes, TaskContext.get().partitionId() * SEQUENCES_A_TASK, out)
        for batch in batches:
            kind = batch.schema.field("doc").type
            docs = batch.column("doc").to_pylist()
            end = np.array([end_id], dtype=np.uint32)
            for doc, ids in zip(docs, bpe_codec.encode_run(batch.column("text").to_pylist(), path, special=True), strict=True):
                bins.add(doc, np.concatenate([ids, end]))
                if len(rows) >= 50_000:
                    yield flush()
        bins.close()
        if rows:
            yield flush()

    return docs.mapInArrow(run, schema)
