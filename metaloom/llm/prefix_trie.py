"""A trie of conversation prefixes, rolled up over its parent edges by centroid decomposition.

A node is a distinct sequence of first turns; it is known by its depth and a 128-bit fingerprint, the sum of hashes of
(place, role, text) along the prefix, so that conversations of any length are read as ranges (:func:`running`) and no
task holds one. Its id is (smallest member, depth): the smallest member of a node stays the smallest as long as its own
path goes on, so each conversation names one descending run of nodes.

The rollup. A node's weight is its number of members; at most one child of a node has a weight of the same power of two. A
component (a node and all below it) of weight below 2^(k+1) is therefore split by its path of nodes of weight 2^k and
more, from the top to the centroid: what hangs off that path weighs less than 2^k, half the component's bound. Split
again and again, each component has one centroid-to-top path, and every node lies on exactly one, whatever the trie's
depth or the number of children. From the lightest components up, totals of components are summed onto the paths that
they hang off (about log2 of the number of conversations rounds, each over half as many components at most); at last
they are added along the paths, from centroid to top, as one running sum for all of them.

Rows without ``conv_id`` belong to no conversation and are left out; null role or text is empty. Turns of a conversation
come in the order of ``turn`` (null first), equal ones in that of the SHA-256 of role and text; repeated rows are turns of
their own. An empty table has no nodes, not even a root. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.llm.ranges import running
from metaloom.session import cut, discard, ship_package

LANES = [f"lane{k}" for k in range(4)]
IDS_A_PIECE = 1 << 16


def positions(turns: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1), ``key`` (SHA-256 of role and text) and ``chars`` (code points of the text): texts are hashed where they are read."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    hashed = cut(turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), key.alias("key"), F.char_length(text).cast("long").alias("chars")))
    return cut(running(hashed, ["conv_id"], ["turn", "key"], rank="pos").select("conv_id", "pos", "key", "chars"))


def with_shared_openings(turns: DataFrame, block: int = 100, widths: int = 6) -> tuple[DataFrame, DataFrame]:
    """Each conversation c rebuilt from the first h turns of the first conversation of its block of ids and what c has after its own first h; h = crc32(c) mod ``widths``.

    ``turns`` as of :func:`positions`. Returns rebuilt turns of the same kind, and ``conv_id, n_turns`` of each conversation.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(widths))
    convs = cut(turns.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumns({"h": h, "base": F.col("conv_id") - F.pmod("conv_id", F.lit(block))}))
    bases = convs.filter("conv_id = base").select("base", F.col("own").alias("base_turns"))
    taken = F.least("h", F.coalesce("base_turns", F.lit(0)))
    info = cut(convs.join(bases, "base", "left").withColumn("taken", taken).withColumn("n_turns", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    heads = turns.filter((F.col("pos") < widths) & (F.pmod("conv_id", F.lit(block)) == 0)).withColumnRenamed("conv_id", "base")
    opening = info.join(heads, "base").filter("pos <= h").select("conv_id", "pos", "key", "chars")
    rest = turns.join(info.select("conv_id", "h", "taken"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "chars")
    return opening.unionByName(rest), info.select("conv_id", "n_turns")


def _packed(*lanes: Column) -> list[Column]:
    return [F.xxhash64(*lanes), F.xxhash64(F.lit("b"), *reversed(lanes))]


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, chars, a, b`` (fingerprint) and ``pa, pb`` (the parent's), one row a turn."""
    one, two = F.xxhash64("pos", "key"), F.xxhash64(F.lit("two"), "key", "pos")
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    lanes = [low(one), F.shiftrightunsigned(one, 32), low(two), F.shiftrightunsigned(two, 32)]
    summed = running(cut(turns.select("conv_id", "pos", "chars", *(x.alias(c) for x, c in zip(lanes, LANES, strict=True)))), ["conv_id"], ["pos"], LANES)
    own = _packed(*(F.col(f"{c}_sum") for c in LANES))
    above = _packed(*(F.col(f"{c}_sum") - F.col(c) for c in LANES))
    return summed.select("conv_id", F.col("pos").alias("depth"), "chars", *(x.alias(c) for x, c in zip(own + above, ("a", "b", "pa", "pb"), strict=True)))


def ends_digests(ends: DataFrame, ids_a_piece: int = IDS_A_PIECE) -> DataFrame:
    """``depth, a, b, ends_sha256``: SHA-256 of the ids of the conversations that end at a node, ascending, joined by commas.

    Ids are ranked inside their node and joined in pieces; only a node with several pieces has them hashed one after the
    other, as a stream.
    """
    node = ["depth", "a", "b"]
    piece = F.floor((F.col("rank") - 1) / ids_a_piece).cast("long")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = cut(running(ends, node, ["conv_id"]).groupBy(*node, piece.alias("piece")).agg(ids.alias("ids")))
    several = pieces.filter("piece = 1").select(*node)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                at = (row["depth"], row["a"], row["b"])
                if at == now:
                    state.update(b",")
                else:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = at, hashlib.sha256()
                state.update(row["ids"].encode())
            yield _rows(done)
        if now:
            yield _rows([(*now, state.hexdigest())])

    ship_package(ends.sparkSession)
    long = pieces.join(several, node, "left_semi").repartition(*node).sortWithinPartitions(*node, "piece").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")
    return pieces.join(several, node, "left_anti").select(*node, F.sha2("ids", 256).alias("ends_sha256")).unionByName(long)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = [("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], type=t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, parent_convs, n_convs, n_children, chars, ends_sha256``, as a written table."""
    seq = cut(prefixes(turns))
    node = ["depth", "a", "b"]
    groups = seq.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in ("chars", "pa", "pb")))
    zero = F.lit(0).cast("long")
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = top.select(*(zero.alias(c) for c in node), "conv_id", "n_convs", zero.alias("chars"), *(F.lit(None).cast("long").alias(c) for c in ("pa", "pb")))
    # Where there is no turn above, the parent is the root.
    first = F.col("depth") == 1
    groups = groups.withColumns({c: F.when(first, zero).otherwise(F.col(c)) for c in ("pa", "pb")})
    nodes = cut(groups.unionByName(root))
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    last = seq.join(convs, "conv_id").filter("depth = n_turns").select(*node, "conv_id")
    ends = ends_digests(cut(last.unionByName(convs.filter("n_turns = 0").select(*(zero.alias(c) for c in node), "conv_id"))))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_convs"))
    met = nodes.join(kids, node, "left").join(ends, node, "left").join(parents, ["depth", "pa", "pb"], "left")
    none = hashlib.sha256(b"").hexdigest()
    out = met.select("conv_id", "depth", "parent_conv_id", "parent_convs", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "chars", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    return cut(out)


def _bound(weight: Column) -> Column:
    """k of the power 2^k that a weight reaches."""
    return (F.length(F.bin(weight)) - 1).cast("int")


def centroid_paths(nodes: DataFrame) -> DataFrame:
    """``conv_id, bound, path``: the path of a conversation's nodes of weight 2^bound to 2^(bound+1), named by the conversation of its top."""
    runs = nodes.groupBy("conv_id", "bound").agg(F.min_by(F.struct("parent_conv_id", "parent_bound"), "depth").alias("up"))
    on = F.col("up.parent_bound") == F.col("bound")
    # A path's runs form a chain: pointers are doubled until all point at its top.
    paths = cut(runs.select("conv_id", "bound", F.when(on, F.col("up.parent_conv_id")).otherwise(F.col("conv_id")).alias("path")))
    while True:
        ahead = paths.select(F.col("conv_id").alias("path"), "bound", F.col("path").alias("next"))
        moved = cut(paths.filter("path != conv_id").join(ahead, ["path", "bound"]).select("conv_id", "bound", F.col("next").alias("path"), (F.col("next") != F.col("path")).alias("moved")))
        still = bool(moved.filter("moved").take(1))
        step = cut(paths.filter("path = conv_id").unionByName(moved.drop("moved")))
        discard(paths, moved)
        paths = step
        if not still:
            return paths


def rollup(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``conv_id, depth`` and each of ``values`` summed over a node's subtree, itself included.

    ``nodes``: conv_id, depth, parent_conv_id, parent_convs, n_convs and ``values`` (longs without nulls).
    """
    weighed = nodes.withColumns({"bound": _bound(F.col("n_convs")), "parent_bound": _bound(F.col("parent_convs"))})
    paths = centroid_paths(weighed)
    sums = lambda: [F.sum(v).alias(v) for v in values]
    on_path = cut(weighed.join(paths, ["conv_id", "bound"]).select("path", "bound", "conv_id", "depth", "parent_conv_id", "parent_bound", *values))
    outer = paths.select(F.col("conv_id").alias("parent_conv_id"), F.col("bound").alias("parent_bound"), F.col("path").alias("outer_path"))
    tops = on_path.groupBy("path", "bound").agg(F.min_by(F.struct("depth", "parent_conv_id", "parent_bound"), "depth").alias("top"), *sums()).select("path", "bound", "top.*", *values)
    components = cut(tops.join(outer, ["parent_conv_id", "parent_bound"], "left"))
    inner, done = [], []  # totals by the path they hang off, and by the node
    for k in sorted(r[0] for r in components.select("bound").distinct().collect()):  # 64 at most
        here = components.filter(F.col("bound") == k)
        for part in inner:
            here = here.unionByName(part.filter(F.col("bound") == k), allowMissingColumns=True)
        # Of a component itself: one row; of what hangs off its path: sums.
        keep = [F.max(c).alias(c) for c in ("depth", "parent_conv_id", "parent_bound", "outer_path")]
        total = cut(here.groupBy("path", "bound").agg(*keep, *sums()))
        done.append(total.filter("parent_conv_id is not null").select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), *values))
        inner.append(cut(total.filter("outer_path is not null").groupBy(F.col("outer_path").alias("path"), F.col("parent_bound").alias("bound")).agg(*sums())))
    hung = None
    for part in done:
        hung = part if hung is None else hung.unionByName(part)
    own = on_path.select("path", "bound", "conv_id", "depth", (-F.col("depth")).alias("rise"), *values)
    if hung is not None:
        hung = hung.groupBy("conv_id", "depth").agg(*(F.sum(v).alias(f"{v}_hung") for v in values))
        own = own.join(hung, ["conv_id", "depth"], "left").select(*(c for c in own.columns if c not in values), *((F.col(v) + F.coalesce(f"{v}_hung", F.lit(0))).alias(v) for v in values))
    along = running(cut(own), ["path", "bound"], ["rise"], values)
    return along.select("conv_id", "depth", *(F.col(f"{v}_sum").alias(v) for v in values))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes with their figures: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns``: conv_id, pos, key, chars; ``convs``: conv_id, n_turns of every conversation, those without turns too.
    """
    leaf = (F.col("n_children") == 0).cast("long")
    nodes = trie_nodes(turns, convs).withColumns({"n_leaves": leaf, "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
    below = rollup(nodes, ["n_leaves", "saved_tokens"])
    return nodes.drop("n_leaves", "saved_tokens", "parent_convs", "chars").join(below, ["conv_id", "depth"])
