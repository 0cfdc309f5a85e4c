"""Text search as DataFrames: analysis, postings, ranked and boolean retrieval, facets and highlights.

Postings are rows (term, doc_id, field, tf, positions); documents' lengths are a second frame. A query is a join of its
terms with the postings. :func:`search` answers from the texts themselves: words that are not asked for are dropped inside
the row that reads the text, before anything is shuffled. For repeated use :mod:`metaloom.operators.index` stores
postings in blocks by buckets of terms; :func:`stored_search` reads only the buckets of the terms that are asked for.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaloom.session import cut

# English stop words.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]

K1, B = 1.2, 0.75
FEW_TERMS, SET_BYTES = 4096, 8 << 20
MEETINGS = 1_000_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def analyse(docs: DataFrame, id_col: str, fields: dict[str, str], stop: bool = True) -> DataFrame:
    """``doc_id, field, term, position``. ``fields``: column to analyser, ``standard`` or ``keyword``. Positions count stop words too."""
    out = None
    for name, kind in fields.items():
        terms = F.array(F.lower(F.col(name))) if kind == "keyword" else tokens(F.col(name))
        part = docs.select(F.col(id_col).alias("doc_id"), F.lit(name).alias("field"), F.posexplode(terms).alias("position", "term")).filter("term is not null")
        if stop and kind != "keyword":
            part = part.filter(~F.col("term").isin(STOP_WORDS))
        out = part if out is None else out.unionByName(part)
    return out


def stem(analysed: DataFrame, stemmer: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Terms replaced by their stems; the stemmer runs once on each distinct term."""
    run = F.pandas_udf(stemmer, "string")
    vocabulary = analysed.select("term").distinct().withColumn("stem", run("term"))
    return analysed.join(vocabulary, "term").withColumn("term", F.col("stem")).drop("stem")


def postings(analysed: DataFrame) -> DataFrame:
    return analysed.groupBy("term", "doc_id", "field").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def _repeated(docs: DataFrame, id_col: str) -> DataFrame:
    """The ids (``again``) that several rows share, null too."""
    return cut(docs.groupBy(F.col(id_col).alias("again")).agg(F.count("*").alias("n")).filter("n > 1").select("again"))


def document_terms(docs: DataFrame, id_col: str, fields: dict[str, str], stop: bool = True) -> DataFrame:
    """``term, doc_id, field, tf``: :func:`postings` without positions, straight from the texts. Words are counted inside the row that reads them; only those of rows that share an id are shuffled."""
    again, parts = _repeated(docs, id_col), []
    shared = not again.isEmpty()
    own = docs.join(again, docs[id_col].eqNullSafe(again["again"]), "left_anti") if shared else docs
    for name, kind in fields.items():
        part = own.select(F.col(id_col).alias("doc_id"), F.lit(name).alias("field"), F.sort_array(words_of(F.col(name), kind, stop)).alias("w")).filter("size(w) > 0")
        starts = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
        counted = F.transform("starts", lambda at, i: F.struct(F.get("w", at).alias("term"), (F.coalesce(F.get("starts", i + 1), F.size("w")) - at).cast("long").alias("tf")))
        parts.append(part.withColumn("starts", starts).select("doc_id", "field", F.inline(counted)).select("term", "doc_id", "field", "tf"))
    if shared:
        rest = analyse(docs.join(again, docs[id_col].eqNullSafe(again["again"]), "left_semi"), id_col, fields, stop)
        parts.append(rest.groupBy("term", "doc_id", "field").agg(F.count("*").alias("tf")))
    return reduce(DataFrame.unionByName, parts)


def term_totals(docs: DataFrame, id_col: str, fields: dict[str, str], stop: bool = True) -> DataFrame:
    """``term, tokens, docs, places``: how often a term stands, in how many documents, and the sum of its positions.

    Behind a text's words its different ones are put once more, and both are counted by term where the text is read: a row
    a term and task is shuffled. Documents are told apart by id, so those of ids that several rows share are counted from
    their pairs of id and term; a null id is no document.
    """
    again = _repeated(docs, id_col).filter("again is not null")
    shared = not again.isEmpty()
    each = docs.join(again, docs[id_col] == again["again"], "left") if shared else docs.withColumn("again", F.lit(None))
    once, none, parts = F.col(id_col).isNotNull() & F.col("again").isNull(), F.array().cast("array<string>"), []
    different = F.array_distinct(F.concat(*(words_of(F.col(name), kind, stop) for name, kind in fields.items())))
    for i, (name, kind) in enumerate(fields.items()):
        words = F.coalesce(F.array(F.lower(F.col(name))) if kind == "keyword" else tokens(F.col(name)), none)
        read = each.select(words.alias("w"), (F.when(once, different).otherwise(none) if i == 0 else none).alias("more"))
        rows = read.select(F.size("w").alias("n"), F.posexplode(F.concat("w", "more")).alias("at", "term")).filter("term is not null")
        if stop and kind != "keyword":
            rows = rows.filter(~F.col("term").isin(STOP_WORDS) | (F.col("at") >= F.col("n")))
        stands = F.col("at") < F.col("n")
        parts.append(rows.select("term", stands.cast("long").alias("tokens"), (~stands).cast("long").alias("docs"), F.when(stands, F.col("at")).otherwise(0).cast("long").alias("places")))
    if shared:
        pairs = each.filter("again is not null").select("again", F.explode(different).alias("term")).distinct()
        parts.append(pairs.select("term", *(F.lit(n).cast("long").alias(c) for c, n in (("tokens", 0), ("docs", 1), ("places", 0)))))
    return reduce(DataFrame.unionByName, parts).groupBy("term").agg(*(F.sum(c).alias(c) for c in ("tokens", "docs", "places")))


def doc_stats(analysed: DataFrame) -> DataFrame:
    return analysed.groupBy("doc_id", "field").agg(F.count("*").alias("length"))


def lengths(docs: DataFrame, id_col: str, fields: dict[str, str], stop: bool = True) -> DataFrame:
    """The same as :func:`doc_stats` of the analysed documents, straight from the texts: nothing is exploded or shuffled."""
    out = None
    for name, kind in fields.items():
        terms = F.array_compact(F.array(F.col(name))) if kind == "keyword" else tokens(F.col(name))
        if stop and kind != "keyword":
            terms = F.filter(terms, lambda x: ~x.isin(STOP_WORDS))
        part = docs.select(F.col(id_col).alias("doc_id"), F.lit(name).alias("field"), F.size(terms).cast("long").alias("length")).filter("length > 0")
        out = part if out is None else out.unionByName(part)
    return out


def words_of(text: Column, kind: str, stop: bool = True) -> Column:
    """The analysed words of a field as an array, without nulls; empty for a null text."""
    if kind == "keyword":
        return F.array_compact(F.array(F.lower(text)))
    words = F.coalesce(tokens(text), F.array().cast("array<string>"))
    return F.filter(words, lambda x: ~x.isin(STOP_WORDS)) if stop else words


def _totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("field").agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))


def deal(hits: DataFrame, met: int) -> DataFrame:
    """Hits dealt by document over so many tasks that each has about ``MEETINGS`` of the ``met`` meetings of hits and queries."""
    tasks = 1 + met // MEETINGS
    few = tasks <= int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hits.repartition("doc_id") if few else hits.repartition(tasks, "doc_id")


def _scored(queries: DataFrame, hits: DataFrame, totals: DataFrame, need_all: bool) -> DataFrame:
    """``hits``: term, doc_id, field, tf, length of the asked terms.

    They are dealt by document once, and meet the terms' weights and the queries where they lie then; both are written
    first, so that Spark broadcasts them if they are small. Pairs of a query and a document are never shuffled. What meets
    is counted from both before, and documents are dealt over so many tasks that each has about ``MEETINGS`` of it.
    """
    q = cut(queries.select("query_id", "term").filter("term is not null").distinct())
    df = hits.groupBy("term", "field").agg(F.count("*").alias("df"))  # a posting is a document
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = cut(df.join(F.broadcast(totals), "field").select("term", "field", "mean", "df", idf.alias("idf")))
    met = weights.join(q, "term").agg(F.sum("df")).first()[0] or 0
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    out = deal(hits, met).join(weights.drop("df"), ["term", "field"]).select("term", "doc_id", part.alias("part")).join(q, "term")
    out = out.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"), F.size(F.collect_set("term")).alias("terms"))
    if need_all:
        out = out.join(q.groupBy("query_id").agg(F.count("*").alias("asked")), "query_id").filter("terms = asked").drop("asked")
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def bm25(queries: DataFrame, post: DataFrame, stats: DataFrame, need_all: bool = False) -> DataFrame:
    """``query_id, doc_id, score`` of every match. ``queries``: query_id, term. Scores are summed over terms and fields."""
    hits = post.join(queries.select("term").distinct(), "term", "left_semi").select("term", "doc_id", "field", "tf")
    return _scored(queries, hits.join(stats, ["doc_id", "field"]), _totals(stats), need_all)


def scanned(docs: DataFrame, id_col: str, fields: dict[str, str], terms: list[str] | None = None) -> DataFrame:
    """``doc_id, field, length, words`` of each text, read once; of ``words`` only the given terms stay, in their order. Nothing is shuffled."""
    parts = []
    for name, kind in fields.items():
        part = docs.select(F.col(id_col).alias("doc_id"), F.lit(name).alias("field"), words_of(F.col(name), kind).alias("words")).withColumn("length", F.size("words").cast("long"))
        kept = F.col("words") if terms is None else F.filter("words", lambda x: x.isin(terms)) if terms else F.array().cast("array<string>")
        parts.append(part.select("doc_id", "field", "length", kept.alias("words")))
    return reduce(DataFrame.unionByName, parts)


def _looked_up(docs: DataFrame, id_col: str, fields: dict[str, str], terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``term, doc_id, field, tf, length`` of the given terms, and ``doc_id, field, length`` of all texts.

    Up to ``FEW_TERMS`` terms are part of the plan: texts are read and cut into words once, all other words go before rows
    are made of them, and what is left is written. More terms are broadcast as long as their strings stay below
    ``SET_BYTES``, and words are dropped where they are made. Beyond that most words are asked for: they are counted
    within their texts before they meet the terms.
    """
    asked = terms.select("term").filter("term is not null").distinct()
    some = [r[0] for r in asked.limit(FEW_TERMS + 1).collect()]
    if len(some) <= FEW_TERMS:
        scan = cut(scanned(docs, id_col, fields, some))
        stats, hits = scan.select("doc_id", "field", "length").filter("length > 0"), scan.filter("size(words) > 0").select("doc_id", "field", "length", F.explode("words").alias("term"))
    else:
        asked = cut(asked)
        stats, hits = lengths(docs, id_col, fields), scanned(docs, id_col, fields).select("doc_id", "field", "length", F.explode("words").alias("term"))
        if asked.agg(F.sum(F.octet_length("term") + 16)).first()[0] <= SET_BYTES:
            hits = hits.join(F.broadcast(asked), "term", "left_semi")
        else:
            counted = hits.groupBy("doc_id", "field", "length", "term").agg(F.count("*").alias("tf"))
            return cut(counted.join(asked, "term", "left_semi")), stats
        hits = cut(hits)
    return hits.groupBy("term", "doc_id", "field", "length").agg(F.count("*").alias("tf")), stats


def matching(docs: DataFrame, id_col: str, fields: dict[str, str], terms: DataFrame) -> DataFrame:
    """``term, doc_id, field, tf, length`` of the given terms alone: other words are dropped where the text is read."""
    return _looked_up(docs, id_col, fields, terms)[0]


def search(docs: DataFrame, id_col: str, fields: dict[str, str], queries: DataFrame, need_all: bool = False) -> DataFrame:
    """:func:`bm25` straight from the texts: nothing but the asked terms' postings is shuffled."""
    hits, stats = _looked_up(docs, id_col, fields, queries)
    return _scored(queries, hits, _totals(stats), need_all)


def store_index(docs: DataFrame, id_col: str, fields: dict[str, str], folder: str, buckets: int = 64) -> None:
    """Writes an index (:mod:`metaloom.operators.index`) of one generation in a new folder."""
    from metaloom.operators import index

    index.create(docs, id_col, fields, folder, buckets)


def stored_search(spark: SparkSession, folder: str, words: dict[int, list[str]], buckets: int | None = None, need_all: bool = False) -> DataFrame:
    """:func:`bm25` over a stored index, every match, for queries given as lists of words, which are analysed. The number of buckets is read from the index; another one is an error."""
    from metaloom.operators import index

    written = index.manifest(spark, folder)
    if buckets is not None and buckets != written["buckets"]:
        raise ValueError(f"the index in {folder} has {written['buckets']} buckets, not {buckets}")
    queries = spark.createDataFrame([(i, " ".join(ws)) for i, ws in words.items()], "query_id long, query string")
    return index.matches(spark, folder, index.ask(queries, written), need_all)


def top_hits(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def phrase(post: DataFrame, terms: list[str]) -> DataFrame:
    """Documents and fields where the terms stand next to each other in order; the rarest part is not looked up first: each step narrows by a semi-join."""
    out = post.filter(F.col("term") == terms[0]).select("doc_id", "field", F.explode("positions").alias("at"))
    for i, t in enumerate(terms[1:], 1):
        nxt = post.filter(F.col("term") == t).select("doc_id", "field", F.explode(F.transform("positions", lambda x: x - F.lit(i))).alias("at"))
        out = out.join(nxt, ["doc_id", "field", "at"], "left_semi")
    return out.select("doc_id", "field").distinct()


def contains_phrase(text: Column, words: str) -> Column:
    """The same for short phrases, on the text's token string."""
    joined = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    return joined.contains(" " + " ".join(words.lower().split()) + " ")


def wildcard_terms(vocabulary: DataFrame, pattern: str) -> DataFrame:
    from metaloom.operators.predicates import wildcard

    return vocabulary.select("term").distinct().filter(wildcard(F.col("term"), pattern))


def _grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """The distinct substrings of these lengths."""
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: text.substr(i, F.lit(n)))
    return F.array_distinct(F.concat(*(F.when(F.length(text) >= n, at(n)).otherwise(F.array().cast("array<string>")) for n in sizes)))


def pattern_candidates(patterns: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``pattern, term``: terms that have the substring, of those that a pattern requires, that the fewest terms have.

    A pattern is cut at its wildcards; of each part of three and more characters all substrings of three are required,
    of a shorter one itself (``^`` and ``$`` stand for the ends of a term). Terms with each are counted, and both sides meet
    by an equi-join on the rarest one of each pattern alone. A pattern of nothing but wildcards requires the empty string,
    which all terms have.
    """
    asked = patterns.select("pattern").filter("pattern is not null").distinct()
    anchored = F.concat(F.lit("^"), F.lower("pattern"), F.lit("$"))
    parts = F.filter(F.split(F.regexp_replace(anchored, r"[*?]+", "*"), r"\*", -1), lambda x: ~x.isin("", "^", "$"))
    required = F.array_distinct(F.flatten(F.transform(parts, lambda x: F.when(F.length(x) >= 3, _grams(x, (3,))).otherwise(F.array(x)))))
    required = F.when(F.size(required) > 0, required).otherwise(F.array(F.lit("")))
    needs = cut(asked.select("pattern", F.explode(required).alias("gram")))
    terms = cut(vocabulary.select("term").filter("term is not null").distinct())
    has = terms.select("term", F.explode(F.concat(_grams(F.concat(F.lit("^"), F.lower("term"), F.lit("$")), (1, 2, 3)), F.array(F.lit("")))).alias("gram"))
    known = has.join(needs.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("least")
    rarest = cut(needs.join(known, "gram", "left").groupBy("pattern").agg(least).select("pattern", F.col("least.gram").alias("gram")))
    return has.join(rarest, "gram").select("pattern", "term")


def pattern_join(patterns: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``pattern, term`` of all pairs that match in full, whatever the case: ``*`` is any characters, ``?`` is one.

    Patterns run over their candidates alone, and as expressions over those that have fitting ends and length.
    """
    quoted = F.regexp_replace(F.lower("pattern"), r"([^\p{L}\p{N}*?])", r"\\$1")
    as_regex = F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    first, last = F.regexp_extract("low", r"^[^*?]*", 0), F.regexp_extract("low", r"[^*?]*$", 0)
    shape = patterns.select("pattern", F.lower("pattern").alias("low")).distinct().select("pattern", first.alias("first"), last.alias("last"), F.length(F.replace(F.col("low"), F.lit("*"), F.lit(""))).alias("least"), as_regex.alias("regex"))
    term = F.lower("term")
    near = pattern_candidates(patterns, vocabulary).join(cut(shape), "pattern").filter(F.startswith(term, F.col("first")) & F.endswith(term, F.col("last")) & (F.length(term) >= F.col("least")))
    return near.filter(F.rlike(term, F.col("regex"))).select("pattern", "term")


def damerau(a: str, b: str) -> int:
    """Edits, with a swap of neighbours as one (unrestricted)."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    d = [[top] * (len(b) + 2), [top, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, seen = [top, i], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            if x == y:
                seen = j
            row.append(min(d[i][j] + (x != y), row[j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        d.append(row)
        last[x] = i
    return d[-1][-1]


def fuzzy_terms(post: DataFrame, word: str, distance: int = 2) -> DataFrame:
    """``term, distance`` within so many edits. Plain Levenshtein distance, at most twice that, narrows the vocabulary first."""

    @F.pandas_udf("int")
    def exact(s: pd.Series) -> pd.Series:
        return s.map(lambda t: damerau(t, word))

    near = post.select("term").distinct().filter(F.levenshtein(F.col("term"), F.lit(word), 2 * distance) >= 0)
    return near.withColumn("distance", exact("term")).filter(F.col("distance") <= distance)


def _shortened(word: Column, distance: int, prefix: int) -> Column:
    """The distinct strings that the word's first ``prefix`` characters become when up to ``distance`` of them are taken out."""
    out = F.array(F.substring(word, 1, prefix))
    for _ in range(distance):
        without = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, 1, i - 1), s.substr(i + 1, F.lit(prefix))))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(F.filter(out, lambda s: s != ""), without))))
    return out


def fuzzy_join(words: DataFrame, vocabulary: DataFrame, distance: int = 2, prefix: int = 10) -> DataFrame:
    """``word, term, distance`` of all pairs within so many edits (a swap of neighbours is one), for tables of both.

    Two strings within d edits become equal when at most d characters are taken out of each, and so do their beginnings.
    Both sides are therefore written out as their beginnings with up to ``distance`` characters left out, and meet by
    an equi-join on those; pairs of fitting length are then compared in full.
    """

    @F.pandas_udf("int")
    def exact(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([damerau(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    variants = lambda df, c: df.select(c).filter(F.col(c).isNotNull()).distinct().select(c, F.explode(_shortened(F.col(c), distance, prefix)).alias("variant"))
    close = F.abs(F.length("word") - F.length("term")) <= distance
    pairs = variants(words, "word").join(variants(vocabulary, "term"), "variant").filter(close).select("word", "term").distinct()
    # Plain edits are at most twice as many.
    near = pairs.filter(F.levenshtein("term", "word", 2 * distance) >= 0)
    return near.withColumn("distance", exact("word", "term")).filter(F.col("distance") <= distance)


def fragments(docs: DataFrame, id_col: str, fields: list[str], terms: list[str], most: int = 3, width: int = 20) -> DataFrame:
    """``doc_id, field, rank, fragment, terms``: of each field up to ``most`` pieces of ``width`` words, hits marked, that do not overlap.

    The best piece has the most different terms, then the most hits, then comes first; the next is the best of those that
    do not overlap it, and so on. A piece begins with a hit and ends with the last one in it. Fields without a hit give no
    row.
    """
    wanted = sorted({t.lower() for t in terms})
    word = re.compile(r"[^\W_]+")

    def best(text: str) -> list[dict]:
        found = [(m.start(), m.end(), n, m[0].lower()) for n, m in enumerate(word.finditer(text))]
        hits = [h for h in found if h[3] in wanted]
        pieces, b = [], 0
        counts: Counter[str] = Counter()
        for a, hit in enumerate(hits):  # a window slides over the hits
            while b < len(hits) and hits[b][2] < hit[2] + width:
                counts[hits[b][3]] += 1
                b += 1
            pieces.append((-len(counts), a - b, a, b))
            counts[hit[3]] -= 1
            if not counts[hit[3]]:
                del counts[hit[3]]
        chosen: list[tuple] = []
        for p in sorted(pieces):
            if len(chosen) == most:
                break
            if all(p[3] <= c[2] or p[2] >= c[3] for c in chosen):
                chosen.append(p)
        out = []
        for different, _, a, b in chosen:
            at, parts = hits[a][0], []
            for start, end, _, _ in hits[a:b]:
                parts += [text[at:start], "<mark>", text[start:end], "</mark>"]
                at = end
            out.append({"fragment": "".join(parts), "terms": -different})
        return out

    @F.pandas_udf("array<struct<fragment: string, terms: int>>")
    def cut_out(s: pd.Series) -> pd.Series:
        return s.map(best)

    any_term = r"(?i)" + "|".join(r"\Q" + t + r"\E" for t in wanted)
    parts = [docs.select(F.col(id_col).alias("doc_id"), F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]
    rows = reduce(DataFrame.unionByName, parts).filter(F.col("text").rlike(any_term) if wanted else F.lit(False))  # most texts never leave the JVM
    out = rows.select("doc_id", "field", F.posexplode(cut_out("text")).alias("rank", "f"))
    return out.select("doc_id", "field", (F.col("rank") + 1).cast("long").alias("rank"), "f.fragment", "f.terms")


def highlight(text: Column, terms: list[str], around: int = 60) -> Column:
    """The text around the first hit, hits marked; null without one."""
    pattern = r"(?i)(?<!\w)(" + "|".join(r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E" for t in terms) + r")(?!\w)"
    at = F.regexp_instr(text, F.lit(pattern))
    cutout = F.substring(text, F.greatest(F.lit(1), at - around), F.lit(2 * around))
    return F.when(at > 0, F.regexp_replace(cutout, pattern, "<mark>$1</mark>"))


def with_fallback(ranked: DataFrame, scan: DataFrame) -> DataFrame:
    """``scan``'s rows join in only if nothing was ranked."""
    none = ranked.agg((F.count("*") == 0).alias("_none"))
    return ranked.unionByName(scan.crossJoin(F.broadcast(none)).filter("_none").drop("_none"))


def admitted(docs: DataFrame, text: Column, least: int) -> DataFrame:
    """``entry``: content if the text is long enough for the index, else reference."""
    return docs.withColumn("entry", F.when(F.length(text) >= least, "content").otherwise("reference"))


def shaped(df: DataFrame, fields: list[str], title: list[str], description: list[str]) -> DataFrame:
    from metaloom.functions.scalars import first_set

    return df.withColumn("title", first_set(*map(F.col, title))).withColumn("description", first_set(*map(F.col, description))).select(*fields)


def delete_documents(post: DataFrame, ids: DataFrame) -> DataFrame:
    return post.join(ids.select("doc_id"), "doc_id", "left_anti")


def routed(queries: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int = 10) -> DataFrame:
    """A table of queries (query_id, query), each answered by what it is about.

    ``docs`` has ``type``, ``platform`` and ``library_strategy`` beside id and text. Accessions are found by key; study
    queries are ranked among studies alone; technical and general ones among all documents, and of the hits of technical
    ones those stay that have the platform and strategy that the query names (ILLUMINA, RNA-Seq).
    """
    from metaloom.functions.scalars import intent, normalised_accession

    q = queries.withColumn("intent", intent(F.col("query")))
    exact = q.filter("intent = 'accession'").join(docs.select(F.col(id_col).alias("doc_id")), normalised_accession(F.col("query")) == F.col("doc_id")).select("query_id", "doc_id", F.lit(1.0).alias("score"))
    words = lambda x: x.select("query_id", F.explode(tokens(F.col("query"))).alias("term"))
    body = {text_col: "standard"}
    studies = search(docs.filter("type = 'study'"), id_col, body, words(q.filter("intent = 'study'")))
    whole = search(docs, id_col, body, words(q.filter("intent in ('technical', 'general')")))
    technical, name = F.col("intent") == "technical", F.upper("query")
    names = q.select("query_id", (technical & name.contains("ILLUMINA")).alias("by_platform"), (technical & name.contains("RNA-SEQ")).alias("by_strategy")).filter("by_platform or by_strategy")
    has = docs.select(F.col(id_col).alias("doc_id"), (F.col("platform") == "ILLUMINA").alias("illumina"), contains_phrase(F.col("library_strategy"), "rna seq").alias("rna_seq")).filter("illumina or rna_seq")
    fits = "(by_platform is null or not by_platform or illumina) and (by_strategy is null or not by_strategy or rna_seq)"
    # Hits lie by document already; what queries name is small and written, so no hit is moved.
    filtered = whole.join(has, "doc_id", "left").join(cut(names), "query_id", "left").filter(fits).select("query_id", "doc_id", "score")
    return top_hits(exact.unionByName(studies).unionByName(filtered), k)


def corpus(df: DataFrame, kind: str, key: str, parts: list[Column]) -> DataFrame:
    """``type, accession, body``: a record's parts that are not null, as one text."""
    return df.select(F.lit(kind).alias("type"), F.col(key).alias("accession"), F.concat_ws(" ", *parts).alias("body"))


def sample_corpus(samples: DataFrame) -> DataFrame:
    return corpus(samples, "sample", "sample_accession", [F.col(c) for c in ("description", "organism", "scientific_name", "tissue")])


def run_corpus(runs: DataFrame) -> DataFrame:
    return corpus(runs, "run", "run_accession", [F.col(c).cast("string") for c in ("total_spots", "total_bases")])


def index_documents(df: DataFrame, kind: str, key: str, title: str, others: list[str]) -> DataFrame:
    """``id, type, title`` and the other fields, as they go to an index."""
    return df.select(F.col(key).alias("id"), F.lit(kind).alias("type"), F.col(title).alias("title"), *others)
