"""Near-duplicate documents by SetSketch.

Each set of shingles is sketched in registers ``K_i = clip(floor(1 - log_b(min_x h_i(x))), 0, q + 1)`` with
exponentially distributed ``h_i``: exponentially spaced truncated minima. They merge by maximum, and two sketches agree
in a register with a probability that grows with the sets' Jaccard similarity. The method:

1. Sets: documents with equal sets (128 bits of a cryptographic hash of them) form a class. Only classes go on.
2. Bands of registers: classes with an equal band fall into one bucket. Every member is paired with the bucket's head (the
   member with the most company), not with every other: pairs grow with the rows, however large a bucket.
3. Estimate: from the numbers of registers that are greater, smaller and equal, and the known set sizes, the
   likelihood of a Jaccard similarity at the threshold is compared with the largest one; pairs for which it is
   hopeless are dropped (``log_odds``), those that stay are confirmed on the full sets, made anew from the whole texts
   with shingles that are equal only if their words are.
4. Components. First each class tries the head that it meets most often; then only pairs that are not yet in one component are
   tried; last, in buckets that still hold several components, pairs across components are tried, so that a link that
   no bucket's first member shows is found too. Pairs that share a rare shingle are found by it, the
   others by their bucket, if an exact bound on what they can share allows the threshold.

A pair with similarity at the threshold is missed by all bands with a probability of about 1e-6 with the standard
parameters. Rounds 2 and 3 exist for correctness; where copies of one text fill a bucket, round 1 joins them and
nothing of the bucket is left over.

A text without words (or null) has the empty set and is linked with nothing, not even with its equals; a text with
fewer words than a shingle is one shingle. Rows that share an id count as one document: a link of one is a link of
all, so their classes are linked with each other. A row without an id is linked with nothing and has no component. Only the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.llm.components import components
from metaloom.llm.words import exact_shingles, marked_shingles, mix, scan, text_runs
from metaloom.session import cut, discard, ship_package


@dataclass(frozen=True)
class Sketch:
    """``bands`` bands of ``rows`` registers with base ``base``; ``percent``: least similarity of a link; ``log_odds``: how much less likely than the best estimate the threshold may be; ``width``: words of a shingle; ``rare``: a shingle in at most so many of the sets of the last round counts as rare there."""

    bands: int = 42
    rows: int = 6
    base: float = 1.1
    percent: int = 80
    log_odds: float = 16.0
    rare: int = 200
    width: int = 5

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    def families(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(0xC0FFEE)
        return rng.integers(0, 2**32, self.registers, dtype=np.uint32), rng.integers(0, 2**31, self.registers, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        """Registers of each set as bytes (sets x registers); an empty set has none (zeros)."""
        flip, factor = self.families()
        low = np.full((len(sets), self.registers), 2**32 - 1, dtype=np.uint32)
        for i, s in enumerate(sets):
            x = (mix(s ^ np.uint64(0xA5A5A5A5)) >> np.uint64(32)).astype(np.uint32)
            for k in range(0, len(x), 512):
                part = x[k : k + 512, None] ^ flip
                part *= factor
                np.minimum(low[i], part.min(axis=0), out=low[i])
        # The smallest of the uniform values gives the smallest exponential one, with rate 1.
        h = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
        k = np.clip(np.floor(1 - np.log(h) / math.log(self.base)), 0, 255)
        k[[len(s) == 0 for s in sets]] = 0
        return k.astype(np.uint8)

    def _p(self, x: np.ndarray) -> np.ndarray:
        """Probability that one register exceeds another's, for ``x`` the share of the joint set that only one has."""
        return -np.log1p(-np.clip(x, 0, 1) * (self.base - 1) / self.base) / math.log(self.base)

    def likelihood(self, more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Log-likelihood of similarity ``j`` if the first set holds the share ``u`` of the sum of sizes."""
        v = 1 - u
        a, b = self._p(u - v * j), self._p(v - u * j)
        tiny = 1e-9
        return more * np.log(a + tiny) + less * np.log(b + tiny) + same * np.log(np.maximum(1 - a - b, tiny))

    def hopeful(self, ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Pairs whose sizes and registers allow the threshold."""
        more, less = (ka > kb).sum(axis=1), (ka < kb).sum(axis=1)
        same = ka.shape[1] - more - less
        u = na / (na + nb)
        top = np.minimum(na, nb) / np.maximum(na, nb)
        t = self.percent / 100
        grid = np.linspace(0.0, 1.0, 41)[None, :] * top[:, None]
        best = self.likelihood(more[:, None], less[:, None], same[:, None], u[:, None], grid).max(axis=1)
        over = np.linspace(0.0, 1.0, 9)[None, :] * np.maximum(top - t, 0)[:, None] + t
        at = self.likelihood(more[:, None], less[:, None], same[:, None], u[:, None], over).max(axis=1)
        return (100 * np.minimum(na, nb) >= self.percent * np.maximum(na, nb)) & (at >= best - self.log_odds)


def _signature(sketch: Sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_runs(batch.column("text")):
                sets, marks = marked_shingles(scan(texts, lower=True), sketch.width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array([len(s) for s in sets], type=pa.int64()), pa.array(marks, type=pa.binary()), pa.array([k.tobytes() for k in sketch.of(sets)], type=pa.binary())],
                    names=["id", "n", "mark", "sketch"],
                )

    return run


def _of_class(width: int):
    """Rows of (node, mark, text) whose text has that mark, as (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("mark").to_pylist()
            for a, b, texts in text_runs(batch.column("text")):
                own = marked_shingles(scan(texts, lower=True), width)[1]
                yield batch.select(["node", "text"]).slice(a, b - a).filter(pa.array([x == y for x, y in zip(own, marks[a:b], strict=True)]))

    return run


def _exploded(width: int):
    """Rows of (node, label, n, text) as one row for each shingle, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_runs(batch.column("text")):
                sets = marked_shingles(scan(texts, lower=True), width)[0]
                owner = pa.array(np.repeat(np.arange(a, b), [len(x) for x in sets]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(owner) for c in ("node", "label", "n")), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "label", "n", "token"])

    return run


def _estimated(pairs: DataFrame, nodes: DataFrame, sketch: Sketch) -> DataFrame:
    """The pairs (a, b) that the sketches do not rule out."""

    @F.pandas_udf("boolean")
    def hopeful(ka: pd.Series, kb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(ka):
            return pd.Series([], dtype=bool)
        grid = lambda s: np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1)
        out = [sketch.hopeful(grid(ka[i : i + 2000]), grid(kb[i : i + 2000]), na[i : i + 2000].to_numpy(np.float64), nb[i : i + 2000].to_numpy(np.float64)) for i in range(0, len(ka), 2000)]
        return pd.Series(np.concatenate(out))

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(hopeful("ka", "kb", "na", "nb")).select("a", "b")


def _confirmed(sketch: Sketch):
    """Rows of (a, b, ta, tb) whose texts' full sets are similar, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = np.zeros(batch.num_rows, dtype=bool)
            ta, tb = batch.column("ta"), batch.column("tb")
            ends = np.cumsum(pc.binary_length(ta).to_numpy() + pc.binary_length(tb).to_numpy())
            at = 0
            while at < len(links):
                # Pairs of about 2 MB of text at a time.
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21))))
                both = [t for pair in zip(ta.slice(at, to - at).to_pylist(), tb.slice(at, to - at).to_pylist(), strict=True) for t in pair]
                sets = exact_shingles(scan(both, lower=True), sketch.width)
                for i in range(to - at):
                    x, y = sets[2 * i], sets[2 * i + 1]
                    # Similar sets have similar sizes; the others need not be met.
                    if 100 * min(len(x), len(y)) >= sketch.percent * max(len(x), len(y)):
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        links[at + i] = 100 * common >= sketch.percent * (len(x) + len(y) - common)
                at = to
            yield batch.select(["a", "b"]).filter(pa.array(links))

    return run


PAIRS_A_TASK = 1000


def _with_texts(pairs: DataFrame, texts: DataFrame, most: int = PAIRS_A_TASK) -> DataFrame:
    """``a, b, ta, tb``: pairs with the texts of both.

    A node may be in very many pairs (copies of one text pair with their head). Pairs of a node with more than ``most`` are
    dealt over salts while they are numbers alone, and its text is repeated once a salt, so that no task writes the texts
    of all of a node's pairs. There are at most a ``most``-th as many such nodes as ends of pairs.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.ceil(F.count("*") / most).cast("int").alias("shares"))
    hot = cut(ends.filter("shares > 1"))
    spread = texts.join(hot, "node", "left").select("node", "text", F.explode(F.sequence(F.lit(1), F.coalesce("shares", F.lit(1)))).alias("salt"))
    out = pairs
    for at, other in (("a", "b"), ("b", "a")):
        salt = F.pmod(F.xxhash64(other), F.coalesce("shares", F.lit(1))).cast("int") + 1
        out = out.join(hot.withColumnRenamed("node", at), at, "left").withColumn(f"s{at}", salt).drop("shares")
    for at in ("a", "b"):
        out = out.join(spread.select(F.col("node").alias(at), F.col("salt").alias(f"s{at}"), F.col("text").alias(f"t{at}")), [at, f"s{at}"])
    return out.select("a", "b", "ta", "tb")


def _verified(pairs: DataFrame, texts: DataFrame, sketch: Sketch) -> DataFrame:
    """The pairs whose full sets are similar. ``texts``: node and text."""
    return _with_texts(pairs, texts).mapInArrow(_confirmed(sketch), "a long, b long")


def near_duplicates(df: DataFrame, sketch: Sketch = Sketch(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """One row per row of ``df``: id, n_shingles, component_id, kept."""
    spark = df.sparkSession
    ship_package(spark)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    signed = cut(docs.mapInArrow(_signature(sketch), f"id {kind}, n long, mark binary, sketch binary"))
    usable = signed.filter("id is not null and n > 0")
    # Classes of equal sets, each a node with a number of its own (which the written table holds fast).
    classes = usable.groupBy("mark").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    with_node = cut(signed.join(classes.select("mark", "node"), "mark", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("node")).alias("node")))
    discard(signed)
    nodes = classes.select("node", "n", "sketch")
    bands = F.array(*(F.xxhash64(F.substring("sketch", 1 + i * sketch.rows, sketch.rows), F.lit(i)) for i in range(sketch.bands)))
    banded = classes.select("node", F.explode(bands).alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    inside = cut(banded.join(buckets, "key").select("key", "node", "size"))
    # A bucket's head is the member with the most company over all its buckets: of copies that were changed here and there,
    # that is the one they were made from, which is nearer to each than they are to each other.
    weights = inside.groupBy("node").agg(F.sum("size").alias("weight"))
    heads = inside.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("best")).select("key", (-F.col("best.minus")).alias("head"))
    members = cut(inside.select("key", "node").join(heads, "key"))
    discard(inside)
    stars = cut(members.filter("node != head").groupBy("head", "node").agg(F.count("*").alias("times")))
    ends = F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")
    shared = members.select("node").distinct()
    near = cut(nodes.join(shared, "node", "left_semi"))
    # Of each class that shares a bucket one text; where an id stands for several texts, the one that has the class's set.
    wanted = classes.join(shared, "node", "left_semi").select("node", "mark", "least")
    texts = docs.join(wanted, docs["id"] == wanted["least"]).select("node", "mark", "text").mapInArrow(_of_class(sketch.width), "node long, text string")
    texts = cut(texts.groupBy("node").agg(F.first("text").alias("text")))

    def tried(pairs: DataFrame) -> DataFrame:
        # Written in between, so that no task holds Python workers for both.
        hopeful = cut(_estimated(pairs, near, sketch))
        links = cut(_verified(hopeful, texts, sketch))
        discard(hopeful)
        return links

    nearest = stars.groupBy("node").agg(F.max(F.struct("times", (-F.col("head")).alias("minus"))).alias("best")).select("node", (-F.col("best.minus")).alias("head"))
    links = tried(nearest.select(*ends).distinct())
    labels = components(links)

    def labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs with the components of both ends; a node without a link is its own."""
        side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"c{x}"))
        return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})

    more = tried(labelled(stars.select(*ends).distinct(), labels).filter("ca != cb").select("a", "b"))
    links = links.union(more)
    discard(labels)
    labels = components(links)
    # Buckets that still hold several components.
    placed = cut(members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    mixed = cut(placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("key", "lo"))
    rest = placed.join(mixed, "key").join(near.select("node", "n", bands.alias("bands")), "node")
    # A shingle that no other component has can't be in an intersection across components. Of the others, those in few
    # of these sets lead straight to the pairs that share them; a pair that shares none of those is bounded by what is
    # left of the smaller set, as similarity t needs an intersection of t / (1 + t) of both sizes together.
    loose = cut(rest.select("node", "label", "n").distinct())
    tokens = loose.join(texts, "node").select("node", "label", "n", "text").mapInArrow(_exploded(sketch.width), "node long, label long, n long, token long")
    tokens = cut(tokens)
    spread = cut(tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")))
    # Similar sets share a shingle among the rarest of both (prefix filter), so only those lead to pairs.
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "token"))
    ranked = cut(tokens.join(spread, "token").withColumn("rank", rank).filter("lo != hi").select("node", "label", "token", "df", ((F.col("rank") - 1) * 100 <= F.col("n") * (100 - sketch.percent)).alias("front")))
    left_over = ranked.filter(F.col("df") > sketch.rare).groupBy("node").agg(F.count("*").alias("s"))
    discard(tokens, spread)
    few = ranked.filter((F.col("df") <= sketch.rare) & F.col("front")).select("token", "node", "label")
    rest = cut(rest.join(left_over, "node").filter(F.col("s") * 100 >= F.col("n") * sketch.percent))
    one = rest.filter("label != lo").select("key", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("s").alias("sx"), F.col("bands").alias("bx"))
    two = rest.select("key", F.col("node").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("s").alias("sy"), F.col("bands").alias("by"))
    fits = F.least("sx", "sy") * (100 + sketch.percent) >= (F.col("nx") + F.col("ny")) * sketch.percent
    # A pair that shares several buckets comes from the first of them.
    first = F.element_at("bx", F.array_position(F.zip_with("bx", "by", lambda p, q: p == q), True).cast("int")) == one["key"]
    by_bound = one.join(two, (one["key"] == two["key"]) & (F.col("lx") != F.col("ly")) & fits & first).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    other = few.select("token", F.col("node").alias("b"), F.col("label").alias("lb"))
    by_shingle = few.withColumnsRenamed({"node": "a", "label": "la"}).join(other, "token").filter("a < b and la != lb").select("a", "b")
    across = by_bound.union(by_shingle).distinct()
    last = tried(across.join(stars.select(*ends), ["a", "b"], "left_anti"))
    discard(members, stars, near, texts, labels, placed, mixed, ranked, rest, loose)
    # An id whose rows have different sets links their classes, as a star around the first of them.
    owned = with_node.filter("node is not null").select("id", "node")
    several = owned.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a != z").select("id", "a")
    again = owned.join(several, "id").filter("a != node").select("a", F.col("node").alias("b")).distinct()
    labels = components(links.union(last).union(again)).join(classes.select("node", "least"), "node")
    smallest = labels.groupBy("label").agg(F.min("least").alias("component"))
    named = labels.join(smallest, "label").select("node", "component").unionByName(classes.join(labels, "node", "left_anti").select("node", F.col("least").alias("component")))
    linked = with_node.join(named, "node", "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    return linked.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, sketch: Sketch = Sketch(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """The rows of ``df`` whose document stays, with their own columns."""
    name = "gone"
    while any(c.lower() == name for c in df.columns):
        name += "_"
    gone = near_duplicates(df, sketch, id_col, text_col).filter("not kept").select(F.col(f"`{id_col}`").alias(name)).distinct()
    return df.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")
