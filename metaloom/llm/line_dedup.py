"""Line dedup with DataFrame functions alone.

Each text is split into lines; a line is known by 96 bits of hash of its key (stripped, A-Z lower-cased). Hashes are
range-partitioned together with the document and sorted by hash, document and position, so that a pass over each
partition sees a document's first line of a key first: those are counted, and a key's count of documents is a sum of
small partial counts, however common the key. What goes back to the documents is not text but keep bitmaps: one bit a
line, 64 lines a word, for each document that loses a line, and compressed: words behind the last lost line are left out, as
are documents that lose nothing. Rows are known by id and a hash of their
text, so repeated rows are treated alike.

``keep="none"``: a key in at least ``min_docs`` documents loses all its lines; ``keep="first"``: all but the first by
document and position. A key shorter than ``min_chars`` code points is never dropped. A null or empty text is one
empty line. A document counts once for a key however often its rows or lines repeat; rows without an id count as one
document. Columns other than id and text play no part in :func:`line_keep_bitmaps`.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.session import cut

WHITE = " \t\n\x0b\x0c\r"


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def line_keep_bitmaps(df: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, mark, words``: of each document that loses lines, bit i % 64 of word i / 64 is set if line i stays; lines behind the last word stay. ``mark`` is the hash of its text."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    text = _text(text_col)
    lines = cut(
        df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("mark"), F.posexplode(F.transform(_lines(text), line_key)).alias("pos", "key")).select(
            "id", "mark", "pos", F.when(F.length("key") >= min_chars, F.xxhash64("key")).alias("h1"), F.when(F.length("key") >= min_chars, F.hash("key")).alias("h2")
        )
    )
    dealt = lines.filter("h1 is not null").repartitionByRange("h1", "h2", "id").sortWithinPartitions("h1", "h2", "id", "pos")
    first = F.row_number().over(Window.partitionBy("h1", "h2", "id").orderBy("pos")) == 1
    common = cut(
        dealt.select("h1", "h2", "id", "pos", first.alias("first"))
        .filter("first")
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("docs"), F.min(F.struct("id", "pos")).alias("head"))
        .filter(F.col("docs") >= min_docs)
    )
    again = F.col("head").isNotNull()
    if keep == "first":
        again = again & ~(F.col("id").eqNullSafe(F.col("head.id")) & (F.col("pos") == F.col("head.pos")))
    bit = F.when(again, F.expr("shiftleft(1L, pos % 64)")).otherwise(F.lit(0).cast("long"))
    marked = lines.join(common, ["h1", "h2"], "left").select("id", "mark", F.expr("pos div 64").alias("word"), bit.alias("bit"))
    words = marked.groupBy("id", "mark", "word").agg(F.bit_or("bit").alias("bits"))
    last = F.max(F.when(F.col("bits") != 0, F.col("word"))).alias("last")
    lists = words.groupBy("id", "mark").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"), last).filter("last is not null")
    return lists.select("id", "mark", F.slice(F.transform("words", lambda x: F.bitwise_not(x["bits"])), 1, (F.col("last") + 1).cast("int")).alias("words"))


def dedup_lines(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped")) -> DataFrame:
    """``df`` with the text that remains, its lines before, and the lines dropped."""
    tag = "_"
    while any(c.startswith(tag) for c in df.columns):
        tag += "_"
    text, (kept, n_lines, n_dropped) = _text(text_col), names
    bits = bitmaps.select(F.col("id").alias(f"{tag}id"), F.col("mark").alias(f"{tag}mark"), F.col("words").alias(f"{tag}words"))
    joined = df.join(bits, F.col(f"`{id_col}`").eqNullSafe(F.col(f"{tag}id")) & (F.xxhash64(text) == F.col(f"{tag}mark")), "left")
    words = F.col(f"{tag}words")
    whole = F.lit(-1).cast("long")
    stays = F.filter(_lines(text), lambda x, i: F.coalesce(F.get(words, F.floor(i / 64).cast("int")), whole).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) != 0)
    dropped = F.aggregate(words, F.lit(0).cast("long"), lambda acc, x: acc + 64 - F.bit_count(x))
    return joined.withColumns({kept: F.when(words.isNull(), text).otherwise(F.array_join(stays, "\n")), n_lines: F.size(_lines(text)).cast("long"), n_dropped: F.coalesce(dropped, F.lit(0).cast("long"))}).drop(f"{tag}id", f"{tag}mark", f"{tag}words")
