"""A Merkle manifest of a dataset: one tree a source, and a tree over the sources' roots.

Nodes carry the interval of leaf ranks that they cover, and a level of the tree is a table. Sixteen consecutive nodes
form the next level, so the node that covers a rank at a level lies in a bucket that the rank itself names. Ancestors are
attached from the top down by joins of neighbouring levels on that bucket, where the parent's interval contains the
child's; the children of a parent outside a node's own interval are its siblings, those before it on the left. A level has
a sixteenth of the rows of the one below, so all that is ever shuffled stays near the size of the leaf digests; texts
never leave the task that reads them.

A digest is the lowercase hex SHA-256 of the joined inputs. A leaf hashes its fields in the given order, each ``-`` if
null, else its UTF-8 byte count, ``:`` and the value. Leaves of a source ascend by id (null first), then by digest, so
repeated rows are leaves of their own. A source with one leaf has that leaf as root. Null is a source of its own, before
all others (also before the empty string); sources are ordered bytewise. An empty table gives no rows. Only the named
columns are read; others, whatever they are called, play no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.llm.ranges import running
from metaloom.session import cut

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def _key(source: Column) -> Column:
    """A tree's name: never null, in the order of the sources."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _bucket(rank: Column, level: int) -> Column:
    return F.floor(rank / F.lit(ARITY**level)).cast("long") if level else rank


@dataclass
class Tree:
    """``runs[k]``: the nodes of level k by runs, with the interval and digest of the run's parent; ``lone`` where a tree ends. ``roots``: ``tree, digest``."""

    runs: list[DataFrame]
    roots: DataFrame


def grow(leaves: DataFrame) -> Tree:
    """``leaves``: ``tree, rank`` (0, 1, ... inside a tree) and ``digest``."""
    nodes = leaves.select("tree", F.col("rank").alias("lo"), F.col("rank").alias("hi"), "digest")
    runs, roots = [], None
    while True:
        level = len(runs) + 1
        kids = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))  # sixteen at most
        run = nodes.groupBy("tree", _bucket(F.col("lo"), level).alias("bucket")).agg(kids.alias("children"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        digest = F.sha2(F.array_join(F.transform("children", lambda c: c["digest"]), ""), 256)
        run = cut(run.withColumn("lone", (F.col("bucket") == 0) & (F.size("children") == 1)).withColumn("digest", digest))
        runs.append(run)
        ends = run.filter("lone").select("tree", F.col("children")[0]["digest"].alias("digest"))
        roots = ends if roots is None else roots.unionByName(ends)
        if not run.filter("not lone").take(1):
            return Tree(runs, roots)
        nodes = run.filter("not lone").select("tree", "lo", "hi", "digest")


def _siblings(children: Column, lo: Column, hi: Column) -> Column:
    """The parent's interval less the node's own: what lies before it and what lies after it."""
    joined = lambda keep: F.array_join(F.transform(F.filter(children, keep), lambda c: c["digest"]), "")
    return F.struct(joined(lambda c: c["hi"] < lo).alias("left"), joined(lambda c: c["lo"] > hi).alias("right"))


def _attach(nodes: DataFrame, parents: DataFrame, level: int) -> DataFrame:
    """``nodes`` of a level with ``above`` (siblings at each level from here to the root) and ``top``, by containment in their parents of ``level``."""
    own, theirs = nodes.withColumn("bucket", _bucket(F.col("lo"), level)).alias("n"), parents.alias("p")
    inside = (F.col("n.lo") >= F.col("p.lo")) & (F.col("n.hi") <= F.col("p.hi"))
    met = own.join(theirs, (F.col("n.tree") == F.col("p.tree")) & (F.col("n.bucket") == F.col("p.bucket")) & inside)
    step = _siblings(F.col("p.children"), F.col("n.lo"), F.col("n.hi"))
    return met.select(*(f"n.{c}" for c in nodes.columns), F.concat(F.array(step), F.col("p.above")).alias("above"), F.col("p.top").alias("top"))


def with_paths(leaves: DataFrame, tree: Tree, ends: DataFrame) -> DataFrame:
    """``leaves`` with ``above`` and ``top``. ``ends``: of each tree ``top`` (its root) and ``above`` (what lies beyond it)."""
    parents = None
    for level in range(len(tree.runs), 0, -1):
        run = tree.runs[level - 1]
        nodes = run.filter("not lone").select("tree", "bucket", "lo", "hi", "digest", "children")
        # Where this level's node is the root of its tree, its path begins.
        alone = (F.col("bucket") == 0) & F.col("is_root")
        if level == len(tree.runs):
            met = nodes.limit(0).withColumns({"above": F.array().cast("array<struct<left:string,right:string>>"), "top": F.lit("")})
        else:
            upper = tree.runs[level].filter("lone").select("tree", F.lit(0).cast("long").alias("bucket"), F.lit(True).alias("is_root"))
            roots = nodes.join(upper, ["tree", "bucket"]).filter(alone).drop("is_root").join(ends, "tree").select(*nodes.columns, "above", "top")
            met = _attach(nodes.drop("bucket"), parents, level + 1).withColumn("bucket", _bucket(F.col("lo"), level)).select(*nodes.columns, "above", "top").unionByName(roots)
        parents = cut(met)
    below = leaves.withColumns({"lo": F.col("rank"), "hi": F.col("rank")})
    single = tree.runs[0].filter("lone").select("tree").join(ends, "tree")
    return _attach(below, parents, 1).unionByName(below.join(single, "tree").select(*below.columns, "above", "top")).drop("lo", "hi")


def fold(leaf: Column, above: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(above, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", tampered: dict[str, Column] | None = None) -> DataFrame:
    """``<id>, leaf, subroot, root, proof_sha256, folded_root, verified``, one row a row of ``docs``.

    ``tampered``: values that take the place of fields when a leaf is checked against its stored siblings.
    """
    values = [F.col(f"`{c}`") for c in fields]
    changed = [(tampered or {}).get(c, v) for c, v in zip(fields, values, strict=True)]
    # Digests are written first: sorting then samples and moves rows of fixed size, not texts.
    digests = cut(docs.select(F.col(f"`{id_col}`").alias("id"), _key(F.col(f"`{group_col}`")).alias("tree"), leaf_digest(values).alias("digest"), leaf_digest(changed).alias("given")))
    leaves = cut(running(digests, ["tree"], ["id", "digest"]).withColumn("rank", F.col("rank") - 1))
    forest = grow(leaves)
    subroots = cut(running(forest.roots.withColumn("sub", F.col("tree")).withColumn("tree", F.lit("all")), ["tree"], ["sub"]).withColumn("rank", F.col("rank") - 1))
    crown = grow(subroots)
    root = crown.roots.select(F.col("digest").alias("root"))  # one row
    none = crown.roots.select("tree", F.col("digest").alias("top"), F.array().cast("array<struct<left:string,right:string>>").alias("above"))
    ends = cut(with_paths(subroots, crown, none).select(F.col("sub").alias("tree"), F.col("digest").alias("top"), "above"))
    paths = with_paths(leaves, forest, ends).crossJoin(F.broadcast(root))
    proof = F.sha2(F.array_join(F.transform("above", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = paths.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", proof.alias("proof_sha256"), fold(F.col("given"), F.col("above")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
