"""Vector search: exact cosine distance, batch nearest neighbours in blocks, quantisation, hybrid ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.session import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either is zero; vectors of unequal length raise."""
    n = norm(a) * norm(b)
    same = F.when(F.size(a) == F.size(b), F.lit(True)).otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("boolean"))
    return F.when(same & (n > 0), 1 - dot(a, b) / n).otherwise(F.lit(1.0))


def nearest(df: DataFrame, vector: str, key: str, query: list[float], k: int, keep: Column | None = None, without: object = None) -> DataFrame:
    """The k nearest rows to one vector, ties by key."""
    rows = df if keep is None else df.filter(keep)
    rows = rows if without is None else rows.filter(F.col(key) != without)
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("distance", F.round(cosine_distance(F.col(vector), q), 6)).orderBy("distance", key).limit(k)


def similar_to(df: DataFrame, vector: str, key: str, target: object, k: int) -> DataFrame:
    """The k rows nearest to the row with this key; that row is broadcast (one row). A missing key gives no rows."""
    one = df.filter(F.col(key) == target).select(F.col(vector).alias("_q")).limit(1)
    scored = df.filter(F.col(key) != target).crossJoin(F.broadcast(one)).withColumn("distance", F.round(cosine_distance(F.col(vector), F.col("_q")), 6)).drop("_q")
    return scored.orderBy("distance", key).limit(k)


TILE = (256, 8_192)


def _tile_best(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of ``a`` the k nearest rows of ``b`` and all that tie with the last of them: row, id, distance."""
    d = np.round(1 - a @ b.T, 6) + 0.0  # no negative zero
    last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
    row, col = np.nonzero(d <= last[:, None])
    return row, ids[col], d[row, col]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.where((s := np.linalg.norm(x, axis=1, keepdims=True)) > 0, s, np.inf)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors as the rows of a matrix, in the type that they are stored in; a row that is null or of another length is an error."""
    lists = vectors.combine_chunks()
    out = lists.flatten().to_numpy(zero_copy_only=False)
    if lists.null_count or pc.count_distinct(pc.list_value_length(lists)).as_py() > 1:
        raise ValueError("vectors are null or differ in dimension")
    return out.reshape(len(lists), -1)


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a group of queries (query_id, q) and one of rows (vec_id, v), the k nearest rows to each query. Doubles are made of a tile at a time."""

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            m, n = _matrix(a["q"]), _matrix(b["v"])
            asked, ids = a["query_id"].to_numpy(), b["vec_id"].to_numpy()
            for i in range(0, len(m), TILE[0]):
                part = _unit(m[i : i + TILE[0]].astype(np.float64))
                held = None  # the best so far; a tile's are merged at once
                for j in range(0, len(n), TILE[1]):
                    new = _tile_best(part, _unit(n[j : j + TILE[1]].astype(np.float64)), ids[j : j + TILE[1]], k)
                    row, vec_id, distance = new if held is None else (np.concatenate(x) for x in zip(held, new, strict=True))
                    order = np.lexsort((vec_id, distance, row))
                    row = row[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    order = order[place < k]
                    held = row[place < k], vec_id[order], distance[order]
                found.append(pa.table({"query_id": asked[i + held[0]], "vec_id": held[1], "distance": held[2]}))
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        return pa.concat_tables([empty, *(x.cast(empty.schema) for x in found)])

    return best


def batch_nearest(queries: DataFrame, rows: DataFrame, k: int, blocks: int | None = None, slices: int | None = None, qid: str = "query_id", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, vec_id, distance, rank`` of the k nearest rows to each query.

    Rows are dealt into blocks and queries into slices (by default of about 50,000 and 20,000 vectors). Each block meets
    each slice once, tile by tile as matrix products, and sends up k candidates a query; those are ranked. No pair but
    the best k of a block leaves a task.
    """
    blocks = blocks or 1 + rows.count() // 50_000
    slices = slices or 1 + queries.count() // 20_000
    q = queries.select(F.col(qid).alias("query_id"), F.col(vector).alias("q"), F.pmod(F.xxhash64(qid), F.lit(slices)).cast("int").alias("slice"))
    q = q.select("query_id", "q", "slice", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    r = rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    r = r.select("vec_id", "v", "block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

    found = q.groupBy("slice", "block").cogroup(r.groupBy("slice", "block")).applyInArrow(_best(k), "query_id long, vec_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def coded(v: Column) -> Column:
    """``codes, lo, step`` of a vector's unit vector: a byte a dimension, the cell of width ``step`` that the value lies in."""

    def cells(lists: pa.Array) -> pa.Array:
        x = _unit(_matrix(pa.chunked_array([lists])).astype(np.float64)) if len(lists) else np.zeros((0, 1))
        lo = x.min(axis=1)
        step = (x.max(axis=1) - lo) / 256
        c = np.clip((x - lo[:, None]) / np.where(step > 0, step, 1)[:, None], 0, 255).astype(np.uint8)
        at = np.arange(len(c) + 1, dtype=np.int32) * c.shape[1]
        codes = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(c))])
        return pa.StructArray.from_arrays([codes, pa.array(lo), pa.array(step)], ["codes", "lo", "step"])

    return _batchwise(cells, "codes binary, lo double, step double")(v)


SLACK = 2e-6  # more than distances change when they are rounded to six places
CODE_TILE = (256, 2_048)
MOST_OPEN = 256  # pairs of a query and the rows of a block; a query with more (or 4 k, if that is more) meets whole vectors instead
OPEN = "query_id long, vec_id long, low double, high double"


def _maybe_best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a group of queries and one of codes: pairs that may be among the k nearest, with the bounds of their distance, or one row without ``vec_id`` for a query that has too many of them."""
    most = max(MOST_OPEN, 4 * k)
    names = [x.split()[0] for x in OPEN.split(", ")]
    empty = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True))).empty_table()

    def some(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [empty]
        if a.num_rows and b.num_rows:
            m, raw = _matrix(a["q"]), b["codes"].combine_chunks().cast(pa.binary())
            at = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1]
            codes = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].reshape(len(raw), -1)
            lo, step, ids, asked = (x.to_numpy() for x in (b["lo"], b["step"], b["vec_id"], a["query_id"]))
            some_rows = slice(None, None, -(-len(codes) // CODE_TILE[1]))

            def bounds(part: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
                # Distances to the middle of each cell; a value lies at most half a cell from it.
                d = 1 - part @ (lo[at, None] + (codes[at] + 0.5) * step[at, None]).T
                return d, np.abs(part).sum(axis=1)[:, None] * step[None, at] / 2 + SLACK

            for i in range(0, len(m), CODE_TILE[0]):
                part = _unit(m[i : i + CODE_TILE[0]].astype(np.float64))
                full = np.zeros(len(part), dtype=bool)
                # Some rows from all over the block tell first how near the k nearest are at least.
                limit = np.partition(np.pad(np.add(*bounds(part, some_rows)), ((0, 0), (0, k)), constant_values=np.inf), k - 1, axis=1)[:, k - 1]
                row, col, low, high = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0)
                for j in range(0, len(codes), CODE_TILE[1]):
                    d, off = bounds(part, slice(j, j + CODE_TILE[1]))
                    r, c = np.nonzero((d - off <= limit[:, None]) & ~full[:, None])
                    row, col = np.concatenate([row, r]), np.concatenate([col, j + c])
                    low, high = np.concatenate([low, (d - off)[r, c]]), np.concatenate([high, (d + off)[r, c]])
                    order = np.lexsort((high, row))
                    has = np.nonzero(np.bincount(row, minlength=len(part)) >= k)[0]
                    limit[has] = np.minimum(limit[has], high[order[np.searchsorted(row[order], has) + k - 1]])
                    keep = low <= limit[row]
                    full |= np.bincount(row[keep], minlength=len(part)) > most
                    keep &= ~full[row]
                    row, col, low, high = row[keep], col[keep], low[keep], high[keep]
                found.append(pa.table({"query_id": asked[i + row], "vec_id": ids[col], "low": low, "high": high}))
                if full.any():
                    none = pa.nulls(int(full.sum()), pa.float64())
                    found.append(pa.table({"query_id": asked[i + np.nonzero(full)[0]], "vec_id": none.cast(pa.int64()), "low": none, "high": none}))
        return pa.concat_tables([empty, *(x.cast(empty.schema) for x in found)])

    return some


def _candidates(queries: DataFrame, rows: DataFrame, k: int, blocks: int | None, slices: int | None, qid: str, key: str, vector: str) -> tuple[DataFrame, DataFrame | None]:
    """:func:`coded_candidates`, queries that have too many of them apart (None: there are none)."""
    blocks = blocks or 1 + rows.count() // 200_000
    slices = slices or 1 + queries.count() // 20_000
    q = queries.filter(F.col(vector).isNotNull()).select(F.col(qid).alias("query_id"), F.col(vector).alias("q"), F.pmod(F.xxhash64(qid), F.lit(slices)).cast("int").alias("slice"))
    q = q.select("query_id", "q", "slice", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    r = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("vec_id"), coded(F.col(vector)).alias("c"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    r = r.select("vec_id", "c.*", "block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    found = cut(q.groupBy("slice", "block").cogroup(r.groupBy("slice", "block")).applyInArrow(_maybe_best(k), OPEN))
    full = found.filter("vec_id is null").select("query_id").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("high"))
    near = found.filter("vec_id is not null")
    limit = near.withColumn("rank", rank).filter(F.col("rank") == k).select("query_id", F.col("high").alias("limit"))
    pairs = near.join(limit, "query_id", "left").filter("limit is null or low <= limit").select("query_id", "vec_id")
    return (pairs, None) if full.isEmpty() else (pairs.join(full, "query_id", "left_anti"), full)


def coded_candidates(queries: DataFrame, rows: DataFrame, k: int, blocks: int | None = None, slices: int | None = None, qid: str = "query_id", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, vec_id``: pairs whose distance has to be computed, as bounds from codes of a byte a dimension leave it open whether they are among the k nearest.

    Queries that bounds leave with more than :data:`MOST_OPEN` rows of a block come once and without ``vec_id``: they have
    to meet all rows. So a group holds and sends up a bounded number of pairs, however many rows are alike.
    """
    pairs, full = _candidates(queries, rows, k, blocks, slices, qid, key, vector)
    return pairs if full is None else pairs.unionByName(full.withColumn("vec_id", F.lit(None).cast("long")))


def coded_nearest(queries: DataFrame, rows: DataFrame, k: int, blocks: int | None = None, slices: int | None = None, qid: str = "query_id", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """:func:`batch_nearest` by codes: what is copied to blocks and slices is a byte a dimension, and whole vectors are read for the candidates alone (of queries that have too many, for all rows). Exact; ids are longs and different; null vectors are left out."""
    pairs, full = _candidates(queries, rows, k, blocks, slices, qid, key, vector)

    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (_unit(_matrix(pa.chunked_array([v])).astype(np.float64)) if len(v) else np.zeros((0, 1)) for v in (a, b))
        return pa.array(np.round(1 - np.einsum("ij,ij->i", x, y), 6) + 0.0)

    met = pairs.join(rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")), "vec_id").join(queries.select(F.col(qid).alias("query_id"), F.col(vector).alias("q")), "query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    out = met.select("query_id", "vec_id", F.arrow_udf(distance, "double")("q", "v").alias("distance")).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)
    if full is None:
        return out
    some, there = queries.join(full.select(F.col("query_id").alias(qid)), qid, "left_semi"), F.col(vector).isNotNull()
    return out.unionByName(batch_nearest(some, rows.filter(there), k, qid=qid, key=key, vector=vector))


def fit_centres(rows: DataFrame, centres: int, sample: int = 20_000, vector: str = "embedding", key: str = "vec_id", seed: int = 7) -> np.ndarray:
    """Unit centres of a coarse quantiser, fitted by k-means to at most ``sample`` rows (those with the smallest hash of their key)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = rows.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(array_to_vector(normalised(F.col(vector))).alias("features"))
    model = KMeans(k=centres, seed=seed, maxIter=10).fit(some)
    return _unit(np.stack(model.clusterCenters()))


def _cells(v: Column, centres: np.ndarray, probes: int) -> Column:
    """The numbers of the ``probes`` centres nearest to a vector."""

    @F.pandas_udf("array<int>")
    def nearest_cells(s: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype=object)
        like = _unit(np.stack(s).astype(np.float64)) @ centres.T
        return pd.Series(list(np.argsort(-like, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return nearest_cells(v)


def indexed_nearest(queries: DataFrame, rows: DataFrame, k: int, centres: np.ndarray, probes: int = 8, part_rows: int = 50_000, qid: str = "query_id", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """:func:`batch_nearest`, but each query meets the rows of its ``probes`` nearest cells alone: rows are shuffled once and queries ``probes`` times, whatever their numbers.

    Every row is in the cell of its nearest centre. A cell of more than ``part_rows`` rows is dealt into parts, and its
    queries go to each of them. Rows nearest to a query may lie in other cells: recall grows with ``probes`` and is 1 when
    they are as many as the centres.
    """
    r = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("vec_id"), F.col(vector).alias("v")).withColumn("cell", _cells(F.col("v"), centres, 1)[0])
    parts = r.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))  # at most a row a centre
    r = r.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    q = queries.filter(F.col(vector).isNotNull()).select(F.col(qid).alias("query_id"), F.col(vector).alias("q")).withColumn("cell", F.explode(_cells(F.col("q"), centres, probes)))
    q = q.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pick = lambda df, *names: df.select("cell", "part", *names).groupBy("cell", "part")
    found = pick(q, "query_id", "q").cogroup(pick(r, "vec_id", "v")).applyInArrow(_best(k), "query_id long, vec_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def quantised(v: Column) -> Column:
    """0..255 between the smallest and largest value, truncated; a constant vector gives zeros."""
    lo, hi = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    return F.when(hi > lo, F.transform(v, lambda x: ((x.cast("double") - lo) / (hi - lo) * 255).cast("int"))).otherwise(F.transform(v, lambda x: F.lit(0)))


def _batchwise(run: Callable[[pa.Array], pa.Array], kind: str) -> Callable[[Column], Column]:
    """A column function over whole Arrow arrays."""

    def fn(column: Column) -> Column:
        return F.arrow_udf(run, kind)(column)

    return fn


def to_bytes(v: Column) -> Column:
    """Vectors as little-endian 32-bit floats: the lists' values are the bytes already, only the offsets are scaled."""

    def pack(lists: pa.Array) -> pa.Array:
        lists = lists.cast(pa.list_(pa.float32()))
        values, at = lists.flatten(), np.zeros(len(lists) + 1, dtype=np.int32)
        np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False) * 4, out=at[1:])
        raw = np.ascontiguousarray(values.to_numpy(zero_copy_only=False), dtype="<f4")
        out = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at), pa.py_buffer(raw)])
        return pc.if_else(lists.is_valid(), out, pa.scalar(None, pa.binary())) if lists.null_count else out

    return _batchwise(pack, "binary")(v)


def from_bytes(b: Column) -> Column:
    def unpack(raw: pa.Array) -> pa.Array:
        at = np.zeros(len(raw) + 1, dtype=np.int32)
        np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False) // 4, out=at[1:])
        values = np.frombuffer(b"".join(raw.drop_null().to_pylist()), dtype="<f4")
        out = pa.ListArray.from_arrays(pa.array(at), pa.array(values))
        return pc.if_else(raw.is_valid(), out, pa.scalar(None, pa.list_(pa.float32()))) if raw.null_count else out

    return _batchwise(unpack, "array<float>")(b)


def to_embed(texts: DataFrame, stored: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose text has no stored vector yet: new keys, or another text hash."""
    hashed = texts.withColumn("text_hash", F.xxhash64(text))
    return hashed.join(stored.select(key, "text_hash"), [key, "text_hash"], "left_anti")


def embed(df: DataFrame, key: str, text: str, fn: Callable[[pd.Series], list], longest: int | None = None) -> DataFrame:
    """``key, embedding``: a user's function over batches of whole texts, or of their first ``longest`` characters if its model needs a limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "embedding": list(fn(b[text].fillna("").str.slice(stop=longest)))})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def hashing_embedder(dim: int = 64) -> Callable[[pd.Series], list]:
    """A fixed embedder for tests: words counted in hashed places, unit length."""
    import zlib

    def fn(texts: pd.Series) -> list:
        out = []
        for t in texts:
            v = np.zeros(dim, dtype=np.float32)
            for w in t.lower().split():
                v[zlib.crc32(w.encode()) % dim] += 1
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return out

    return fn


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, key: str, weight: float = 0.7) -> DataFrame:
    """``key, score``: min-max-normalised scores, ``weight`` for the vector side; a missing side counts 0."""

    def scaled(df: DataFrame, col: str, name: str) -> DataFrame:
        ends = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
        unit = F.when(F.col("_hi") > F.col("_lo"), (F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(1.0))
        return df.crossJoin(F.broadcast(ends)).select(key, unit.alias(name))

    both = scaled(text_hits, "score", "_t").join(scaled(vector_hits, "similarity", "_v"), key, "full")
    return both.select(key, F.round(F.coalesce("_v", F.lit(0.0)) * weight + F.coalesce("_t", F.lit(0.0)) * (1 - weight), 6).alias("score"))


def reciprocal_rank(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """``key, score``: the sum of 1 / (k + rank) over ranked lists."""
    out = None
    for df in lists:
        part = df.select(key, (1.0 / (k + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.round(F.sum("part"), 6).alias("score"))


