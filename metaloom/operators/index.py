"""A stored text index: postings in blocks with bounds, changed by appended generations.

Tables in the index's folder, each by generation (0: the first write):

* ``postings``, in folders by bucket of the term: a row is a term's postings in one block of documents, as an array, with
  ``peak``, the largest saturated frequency in it. The documents that a task reads are put into blocks in order of length,
  so that peaks differ from block to block. A common term is spread over as many rows as blocks.
* ``forward``: a document's length, its block, and its words by field; ``frequencies`` and ``totals``: how many documents a generation adds to
  (or, through those it replaces, takes from) each term and field.
* ``gone``: documents that a generation replaces or deletes; what older generations say of them is dead.

``manifest`` has what the index was written with (fields, analyser, buckets, size of a block), so that readers need not be
told; ``generations`` lists what has been written to the end: a write that failed is not seen, and is overwritten by the
next. One writer at a time. :func:`compact` writes all that is alive as an index of one generation.

:func:`search` gives the exact first k. The bounds of a query's blocks come from ``peak`` alone; postings are read first
of the blocks with the highest bounds, as many as hold k documents, and then only of those whose bound reaches the k-th
score found. A block that one query needs is then scored for all that ask for its terms: pairs of a query and a document
meet no table of blocks, so they are never shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloom.operators.text import K1, B, deal, top_hits, words_of
from metaloom.session import cut, ship_package

ANALYSER = "lowercase runs of letters and digits"
TABLES = ("postings", "forward", "frequencies", "totals", "gone")
SLICES, TASK_WORDS = 16, 1 << 26  # files of a bucket and words of a task, where postings are dealt
WORDS = 1 << 20  # that are inverted at a time
FEW_GONE = 250_000  # ids of a generation that are broadcast


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _saturated(tf: Column, length: Column, mean: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * length / mean))


ENTRY = "array<struct<field: string, length: long, words: array<string>>>"


def _documents(docs: DataFrame, id_col: str, fields: dict[str, str], stop: bool) -> DataFrame:
    """``doc_id, length, fields``: a row a document that has words, with the words of each field. Nothing is shuffled."""
    # A numbered row keeps the filter below from being moved in front of the words, where texts would be cut into words again for it.
    each = docs.select(F.col(id_col).alias("doc_id"), *(words_of(F.col(name), kind, stop).alias(f"w{i}") for i, (name, kind) in enumerate(fields.items())), F.monotonically_increasing_id().alias("at"))
    entries = (F.struct(F.lit(name).alias("field"), F.size(f"w{i}").cast("long").alias("length"), F.col(f"w{i}").alias("words")) for i, name in enumerate(fields))
    found = each.select("doc_id", "at", F.filter(F.array(*entries), lambda x: x["length"] > 0).cast(ENTRY).alias("fields"))
    found = found.select("doc_id", "at", F.aggregate("fields", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"), "fields")
    return found.filter("length > 0 and at >= 0").drop("at")


def _by_field(docs: DataFrame) -> DataFrame:
    """A row a document and field, with the field's own length."""
    out = docs.select(*(c for c in docs.columns if c not in ("length", "fields")), F.explode("fields").alias("f"))
    return out.withColumn("length", F.col("f.length"))


def _inverted(rows: pa.RecordBatch, names: list[str], means: list[float]) -> pa.RecordBatch:
    """Documents with the words of their fields, as rows ``field, block, term, entries, peak, mean, n``."""
    entry = rows.column("fields").flatten()
    doc = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("fields")).to_numpy())
    field = pc.index_in(entry.field("field"), value_set=pa.array(names)).to_numpy()
    words = entry.field("words")
    coded = words.flatten().dictionary_encode()
    # A word's key is its term, in order, then its field and document.
    in_order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(in_order), dtype=np.int64)
    rank[in_order] = np.arange(len(rank))
    by = np.lexsort((doc, field))
    place = np.empty(len(by), dtype=np.int64)
    place[by] = np.arange(len(by))
    key = np.sort(rank[coded.indices.to_numpy()] * len(by) + np.repeat(place, pc.list_value_length(words).to_numpy()))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(np.append(first, len(key)))
    term, e = key[first] // len(by), by[key[first] % len(by)]
    block = rows.column("block").to_numpy()[doc[e]]
    new = np.ones(len(first), dtype=bool)
    new[1:] = (np.diff(term) != 0) | (np.diff(field[e]) != 0) | (np.diff(block) != 0)
    at = np.flatnonzero(new)
    length, mean = entry.field("length").to_numpy()[e], np.array(means)[field[e]]
    entries = pa.StructArray.from_arrays([rows.column("doc_id").take(pa.array(doc[e])), pa.array(tf), pa.array(length)], names=["doc_id", "tf", "length"])
    ends = np.append(at, len(first))
    columns = {
        "field": pa.array(names).take(pa.array(field[e][at])), "block": pa.array(block[at]), "term": coded.dictionary.take(pa.array(in_order[term[at]])), "entries": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries),
        "peak": pa.array(np.maximum.reduceat(_saturated(tf, length, mean), at)), "mean": pa.array(mean[at]), "n": pa.array(np.diff(ends)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _inverter(means: dict[str, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names, values, most = list(means), list(means.values()), WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # Some whole blocks at a time; one that lies across two batches has two rows a term.
            starts = np.flatnonzero(np.diff(batch.column("block").to_numpy(), prepend=-1))
            before = np.append(0, np.cumsum(batch.column("length").to_numpy()))[starts]
            begin = starts[np.diff(before // most, prepend=-1) != 0].tolist()
            for i, j in zip(begin, [*begin[1:], batch.num_rows], strict=True):
                yield _inverted(batch.slice(i, j - i), names, values)

    return run


def _sizes(forward: DataFrame) -> dict[str, tuple[int, int]]:
    """How many documents and words each field has."""
    found = _by_field(forward).groupBy(F.col("f.field").alias("field")).agg(F.count("*"), F.sum("length")).collect()  # a row a field
    return {name: (docs, words) for name, docs, words in found}


def _postings(forward: DataFrame, fields: dict[str, str], buckets: int, sizes: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """``bucket, slice, field, block, term, entries, peak, mean, n``: a term's postings in a block.

    Documents of a block lie together, so a block is inverted in the task that reads it, and nothing is shuffled. Only where
    documents lie in so few partitions that a task would have more than ``TASK_WORDS`` words, the postings are dealt by
    bucket and slice of blocks over as many tasks as the words ask for.
    """
    ship_package(forward.sparkSession)
    sizes = _sizes(forward) if sizes is None else sizes
    tasks = 1 + sum(words for _, words in sizes.values()) // TASK_WORDS
    slices = max(SLICES, -(-4 * tasks // buckets))  # four a task, that tasks are alike
    entry = T.StructType([T.StructField("doc_id", forward.schema["doc_id"].dataType), T.StructField("tf", T.LongType()), T.StructField("length", T.LongType())])
    kinds = {"field": T.StringType(), "block": T.LongType(), "term": T.StringType(), "entries": T.ArrayType(entry), "peak": T.DoubleType(), "mean": T.DoubleType(), "n": T.LongType()}
    rows = forward.select("doc_id", "length", "block", "fields").mapInArrow(_inverter({name: sizes[name][1] / sizes[name][0] for name in fields if name in sizes}), T.StructType([T.StructField(*x) for x in kinds.items()]))
    rows = rows.select(_bucket(F.col("term"), buckets).alias("bucket"), F.pmod("block", F.lit(slices)).alias("slice"), *kinds)
    return rows if tasks <= max(1, forward.rdd.getNumPartitions()) else rows.repartition(tasks, "bucket", "slice")


def manifest(spark: SparkSession, folder: str) -> dict:
    """What the index was written with; raises where there is none or it was written for another analyser."""
    found = spark.read.parquet(f"{folder}/manifest").first()
    if found["analyser"] != ANALYSER:
        raise ValueError(f"the index in {folder} was written with another analyser: {found['analyser']}")
    return found.asDict() | {"fields": json.loads(found["fields"])}


def _generations(spark: SparkSession, folder: str) -> list[int]:
    return [r[0] for r in spark.read.parquet(f"{folder}/generations").select("generation").collect()]  # one row a write


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}").filter(F.col("generation").isin(_generations(spark, folder)))


def _alive(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of documents that no later generation replaces or deletes."""
    last = gone.groupBy("doc_id").agg(F.max("generation").alias("since"))
    return rows.join(last, "doc_id", "left").filter("since is null or generation >= since").drop("since")


def _append(spark: SparkSession, folder: str, m: dict, generation: int, documents: DataFrame, gone: DataFrame, counts: DataFrame | None = None) -> None:
    """A generation: documents (of :func:`_documents`), and the ids of those it replaces or deletes. ``counts``: its frequencies (bucket, field, term, df) where they are known."""
    at = lambda name: f"{folder}/{name}/generation={generation}"
    put = lambda df, name, *by: df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(at(name))
    # In order of length within each task's documents, which are not moved; rows number on from a multiple of 2**33 in each.
    row = F.monotonically_increasing_id()
    put(documents.sortWithinPartitions("length", "doc_id").withColumn("row", row).withColumn("block", F.floor(F.col("row") / m["block_size"])), "forward")
    forward = spark.read.schema("doc_id " + documents.schema["doc_id"].dataType.simpleString() + f", length long, fields {ENTRY}, row long, block long").parquet(at("forward"))
    sizes = _sizes(forward)
    # Terms are in order within what was inverted at a time; to sort by bucket alone compares no rows.
    put(_postings(forward, m["fields"], m["buckets"], sizes).drop("slice").sortWithinPartitions("bucket"), "postings", "bucket")
    own = spark.read.schema("bucket int, field string, term string, n long").parquet(at("postings")).select("bucket", "field", "term", F.col("n").alias("df"))
    totals = spark.createDataFrame([(name, *size) for name, size in sizes.items()], "field string, docs long, length long")
    put(gone, "gone")
    if generation:
        # What the replaced documents had counted for goes off the counts. Words are not shuffled to find a few of them.
        ids = spark.read.schema(gone.schema).parquet(at("gone"))
        ids = F.broadcast(ids) if ids.count() <= FEW_GONE else ids
        dead = cut(_alive(_table(spark, folder, "forward").join(ids, "doc_id", "left_semi"), _table(spark, folder, "gone")).select("doc_id", "length", "fields"))
        each = _by_field(dead).select(F.col("f.field").alias("field"), F.explode(F.array_distinct("f.words")).alias("term"))
        own = own.unionByName(each.select(_bucket(F.col("term"), m["buckets"]).alias("bucket"), "field", "term", F.lit(-1).cast("long").alias("df")))
        totals = totals.unionByName(_by_field(dead).select(F.col("f.field").alias("field"), F.lit(-1).cast("long").alias("docs"), (-F.col("length")).alias("length")))
    counts = own.groupBy("bucket", "field", "term").agg(F.sum("df").alias("df")) if counts is None else counts
    put(counts.sortWithinPartitions("bucket", "term"), "frequencies", "bucket")
    put(totals.groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")), "totals")
    spark.createDataFrame([(generation,)], "generation int").write.mode("append").parquet(f"{folder}/generations")


def create(docs: DataFrame, id_col: str, fields: dict[str, str], folder: str, buckets: int = 64, block_size: int = 32, stop: bool = True) -> None:
    """Writes the first generation. ``fields``: column to analyser, ``standard`` or ``keyword``. Each row is a document; the hits of rows that share an id are summed."""
    m = {"id_col": id_col, "fields": json.dumps(fields), "stop": stop, "buckets": buckets, "block_size": block_size, "analyser": ANALYSER}
    docs.sparkSession.createDataFrame([tuple(m.values())], "id_col string, fields string, stop boolean, buckets int, block_size int, analyser string").write.parquet(f"{folder}/manifest")
    ids = docs.select(F.col(id_col).alias("doc_id"))
    _append(docs.sparkSession, folder, m | {"fields": fields}, 0, _documents(docs, id_col, fields, stop), ids.limit(0))


def upsert(docs: DataFrame, folder: str) -> None:
    """Documents that are new or take the place of those with their ids, as a generation; the old ones' postings stay and are dead."""
    spark = docs.sparkSession
    m = manifest(spark, folder)
    ids = docs.select(F.col(m["id_col"]).alias("doc_id")).distinct()
    _append(spark, folder, m, max(_generations(spark, folder)) + 1, _documents(docs, m["id_col"], m["fields"], m["stop"]), ids)


def delete(ids: DataFrame, folder: str) -> None:
    """``ids``: a column ``doc_id``; unknown ones do nothing."""
    spark = ids.sparkSession
    m = manifest(spark, folder)
    none = _table(spark, folder, "forward").select("doc_id", "length", "fields").limit(0)
    _append(spark, folder, m, max(_generations(spark, folder)) + 1, none, ids.select("doc_id").distinct())


def live_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, length, fields`` of all that is alive."""
    return _alive(_table(spark, folder, "forward"), _table(spark, folder, "gone")).select("doc_id", "length", "fields")


def compact(spark: SparkSession, folder: str, to: str) -> None:
    """What is alive, as an index of one generation in the new folder ``to``."""
    m = manifest(spark, folder)
    spark.read.parquet(f"{folder}/manifest").write.parquet(f"{to}/manifest")
    counts = _table(spark, folder, "frequencies").groupBy("bucket", "field", "term").agg(F.sum("df").alias("df")).filter("df > 0")
    _append(spark, to, m, 0, live_documents(spark, folder), _table(spark, folder, "gone").select("doc_id").limit(0), counts)


def ask(queries: DataFrame, m: dict) -> DataFrame:
    """``query_id, term`` of a table (query_id, query), analysed as the index is."""
    return queries.select("query_id", F.explode(words_of(F.col("query"), "standard", m["stop"])).alias("term")).distinct()


def _bounded(spark: SparkSession, folder: str, asked: DataFrame, m: dict, need_all: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``bounds``: query_id, generation, block, bound, n (documents it has at least); ``wanted``: the asked terms by field, numbered;
    ``known``: what each query asks for, by those numbers, with idf and mean."""
    buckets = [r[0] for r in asked.select(_bucket(F.col("term"), m["buckets"])).distinct().collect()]  # as many as buckets at most
    totals = _table(spark, folder, "totals").groupBy("field").agg(F.sum("docs").alias("docs"), (F.sum("length") / F.sum("docs")).alias("mean_now")).filter("docs > 0")
    terms = asked.select("term").distinct()
    df = _table(spark, folder, "frequencies").filter(F.col("bucket").isin(buckets)).join(terms, "term", "left_semi").groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df > 0")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = cut(df.join(F.broadcast(totals), "field").select("field", "term", "mean_now", idf.alias("idf"), _bucket(F.col("term"), m["buckets"]).alias("bucket"), F.monotonically_increasing_id().alias("number"), "df"))
    known = cut(asked.join(wanted, "term").select("query_id", "number", "term", "idf", "mean_now", "df"))
    heads = _table(spark, folder, "postings").filter(F.col("bucket").isin(buckets)).select("generation", "field", "term", "block", "peak", "mean", "n")
    # The peak was taken with the mean length of its time: a larger mean raises scores by the quotient at most.
    top = F.col("idf") * (K1 + 1) * F.col("peak") * F.greatest(F.lit(1.0), F.col("mean_now") / F.col("mean"))
    met = heads.join(wanted, ["field", "term"]).join(asked, "term")
    each, best = met.groupBy("query_id", "generation", "block"), [F.sum(top).alias("bound"), F.max("n").alias("n")]
    if not need_all:  # counting distinct terms would shuffle a row for each of them
        return cut(each.agg(*best)), wanted, known
    bounds = each.agg(*best, F.countDistinct("term").alias("terms")).join(asked.groupBy("query_id").agg(F.count("*").alias("asked")), "query_id").filter("terms = asked").drop("asked")
    return cut(bounds.drop("terms")), wanted, known


def _scores(spark: SparkSession, folder: str, blocks: DataFrame, asked: DataFrame, wanted: DataFrame, known: DataFrame, need_all: bool) -> DataFrame:
    """``query_id, doc_id, score`` of the documents in ``blocks``, of every query (generation, block) or of those named beside them (query_id too).

    Hits are dealt by document once, as numbers; they meet the queries, and are summed, where they lie then. ``blocks`` and
    :func:`_bounded`'s frames are written tables, which Spark broadcasts if they are small.
    """
    buckets, named = [r[0] for r in wanted.select("bucket").distinct().collect()], "query_id" in blocks.columns
    read = _table(spark, folder, "postings").filter(F.col("bucket").isin(buckets)).select("generation", "block", "field", "term", "entries")
    rows = read.join(blocks.select("generation", "block").distinct() if named else blocks, ["generation", "block"], "left_semi").join(wanted.select("field", "term", "number"), ["field", "term"])
    place = ("generation", "block") if named else ("generation",)
    rows = rows.select(*place, "number", F.explode("entries").alias("e")).select(*place, "number", "e.doc_id", "e.tf", "e.length")
    met = known.agg(F.sum("df")).first()[0] or 0
    hits = _alive(deal(rows, met), _table(spark, folder, "gone"))  # the join finds them dealt
    part = F.col("idf") * (K1 + 1) * _saturated(F.col("tf"), F.col("length"), F.col("mean_now"))
    pairs = hits.join(known.drop("df"), "number")
    pairs = (pairs.join(blocks, ["query_id", "generation", "block"], "left_semi") if named else pairs).groupBy("query_id", "doc_id")
    if need_all:
        scored = pairs.agg(F.sum(part).alias("score"), F.size(F.collect_set("term")).alias("terms"))
        scored = scored.join(asked.groupBy("query_id").agg(F.count("*").alias("asked")), "query_id").filter("terms = asked")
    else:
        scored = pairs.agg(F.sum(part).alias("score"))
    return scored.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _blocks(each: DataFrame) -> DataFrame:
    """The blocks that any query needs, as a written table (a row for 32 documents)."""
    return cut(each.select("generation", "block").distinct())


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int, need_all: bool = False) -> DataFrame:
    """``query_id, doc_id, score, rank``: of each query (query_id, query) the first k by BM25, exactly."""
    hits, _, _ = search_blocks(spark, folder, ask(queries, manifest(spark, folder)), k, need_all)
    return hits


def matches(spark: SparkSession, folder: str, asked: DataFrame, need_all: bool = False) -> DataFrame:
    """``query_id, doc_id, score`` of every match of analysed terms (query_id, term)."""
    asked = cut(asked.distinct())
    bounds, wanted, known = _bounded(spark, folder, asked, manifest(spark, folder), need_all)
    return _scores(spark, folder, _blocks(bounds), asked, wanted, known, need_all)


def search_blocks(spark: SparkSession, folder: str, asked: DataFrame, k: int, need_all: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for analysed terms (query_id, term); also all blocks that have a term (with bounds), and those that were read."""
    m = manifest(spark, folder)
    asked = cut(asked.distinct())
    bounds, wanted, known = _bounded(spark, folder, asked, m, need_all)
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "generation", "block")
    # A block has a document at least, so k blocks are enough; no other leaves its task.
    highest = bounds.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    ranked = highest.withColumn("held", F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = cut(ranked.filter(F.col("held") < k).select("query_id", "generation", "block"))
    found = cut(_scores(spark, folder, first, asked, wanted, known, need_all))
    floor = top_hits(found, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    # A score is rounded to six places, so a bound may lie that much below it.
    rest = bounds.join(first, ["query_id", "generation", "block"], "left_anti").join(floor, "query_id", "left").filter("floor is null or bound >= floor - 0.00001")
    rest = cut(rest.select("query_id", "generation", "block"))
    read = first.unionByName(rest)
    return top_hits(_scores(spark, folder, _blocks(read), asked, wanted, known, need_all), k), bounds, read
