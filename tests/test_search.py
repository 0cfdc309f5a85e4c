"""Search: what a plan shuffles, and the stored index."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from metaloom.operators import index as ix
from metaloom.operators import text as t
from metaloom.operators import vectors as vec
from metaloom.session import cut, new_folder, release, scratch

BODY = {"text": "standard"}


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def asked(spark, *words):
    return spark.createDataFrame([(1, w) for w in words], "query_id long, term string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_other_words_go_before_anything_is_shuffled(spark, docs):
    scan = plan(t.scanned(docs, "doc_id", BODY, ["thnd", "hend"]))
    assert "Exchange" not in scan and "Generate" not in scan
    # And what is shuffled afterwards comes from the written rows, not from the texts.
    hits = plan(t.matching(docs, "doc_id", BODY, asked(spark, "thnd", "hend")))
    assert "regexp_extract_all" not in hits


@pytest.mark.parametrize(("few", "size"), [(4096, 1 << 20), (1, 1 << 20), (1, 10)])
def test_ways_to_look_words_up_agree(spark, docs, monkeypatch, few, size):
    monkeypatch.setattr(t, "FEW_TERMS", few)
    monkeypatch.setattr(t, "SET_BYTES", size)
    q = spark.createDataFrame([(1, "thnd"), (1, "hend"), (2, "er"), (2, None), (3, "unheard"), (2, "er")], "query_id int, term string")
    got = rows(t.search(docs, "doc_id", BODY, q))
    a = t.analyse(docs, "doc_id", BODY)
    assert got == rows(t.bm25(q.filter("term is not null"), t.postings(a), t.doc_stats(a))) and len(got) > 50


def test_search_of_nothing(spark, docs):
    assert t.search(docs, "doc_id", BODY, asked(spark).limit(0)).collect() == []
    assert t.search(docs.limit(0), "doc_id", BODY, asked(spark, "a1")).collect() == []


@pytest.fixture
def folder(spark):
    return new_folder(spark, "index")


def test_manifest_is_checked(spark, docs, folder):
    t.store_index(docs.limit(40), "doc_id", BODY, folder, buckets=4)
    assert rows(t.stored_search(spark, folder, {1: ["ER", "es"]})) == rows(t.stored_search(spark, folder, {1: ["er", "es"]}, buckets=4)) != []
    with pytest.raises(ValueError, match="buckets"):
        t.stored_search(spark, folder, {1: ["er"]}, buckets=64)
    spark.createDataFrame([("doc_id", "{}", True, 4, 32, "other")], spark.read.parquet(f"{folder}/manifest").schema).write.mode("overwrite").parquet(f"{folder}/other/manifest")
    with pytest.raises(ValueError, match="analyser"):
        ix.manifest(spark, f"{folder}/other")


def ranked(spark, docs, queries, k, need_all=False):
    words = queries.select("query_id", F.explode(t.words_of(F.col("query"), "standard")).alias("term"))
    return rows(t.top_hits(t.search(docs, "doc_id", BODY, words, need_all), k))


@pytest.mark.parametrize("need_all", [False, True])
def test_first_k_are_exact_and_blocks_are_left_unread(spark, docs, folder, need_all):
    ix.create(docs, "doc_id", BODY, folder, buckets=4, block_size=2)
    queries = spark.createDataFrame([(1, "er"), (2, "en es"), (3, "thnd hend ingly"), (4, "the of"), (5, "unheard"), (6, None)], "query_id int, query string")
    assert rows(ix.search(spark, folder, queries, 3, need_all)) == ranked(spark, docs, queries, 3, need_all)
    common = ix.ask(queries.filter("query_id = 1"), ix.manifest(spark, folder))
    hits, blocks, read = ix.search_blocks(spark, folder, common, 3)
    assert hits.count() == 3 and 2 * read.count() < blocks.count()
    # More than there are.
    assert rows(ix.search(spark, folder, queries, 1000, need_all)) == ranked(spark, docs, queries, 1000, need_all)


def test_changes_equal_a_new_index(spark, docs, folder):
    rng = random.Random(3)
    now = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "doc_id long, text string")
    queries = spark.createDataFrame([(1, "er en"), (2, "thnd hend"), (3, "brandnew words")], "query_id int, query string")
    ix.create(frame(now), "doc_id", BODY, folder, buckets=4, block_size=4)
    for turn in range(3):
        batch = {i: f"brandnew {turn} " + " ".join(rng.choice(["er", "en", "hend", "the"]) for _ in range(rng.randrange(60))) for i in rng.sample(sorted(now), 20)} | {10_000 + turn: "words er", 20_000: None}
        gone = rng.sample(sorted(now), 10) + [77_777]
        ix.upsert(frame(batch), folder)
        ix.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"), folder)
        now = {i: x for i, x in (now | batch).items() if i not in gone}
    want = ranked(spark, frame(now), queries, 10)
    assert rows(ix.search(spark, folder, queries, 10)) == want
    to = new_folder(spark, "index")
    ix.compact(spark, folder, to)
    assert rows(ix.search(spark, to, queries, 10)) == want
    assert spark.read.parquet(f"{to}/generations").count() == 1


def test_a_write_that_failed_is_not_seen(spark, docs, folder):
    some = docs.limit(30)
    ix.create(some, "doc_id", BODY, folder, buckets=2)
    queries = spark.createDataFrame([(1, "er en")], "query_id int, query string")
    before = rows(ix.search(spark, folder, queries, 5))
    # Parts of a generation that was never listed.
    spark.read.parquet(f"{folder}/postings/generation=0").write.partitionBy("bucket").parquet(f"{folder}/postings/generation=1")
    spark.read.parquet(f"{folder}/forward/generation=0").select("doc_id").write.parquet(f"{folder}/gone/generation=1")
    assert rows(ix.search(spark, folder, queries, 5)) == before
    ix.delete(some.select("doc_id"), folder)
    assert ix.search(spark, folder, queries, 5).collect() == []


# Written tables


def left(spark):
    from metaloom.session import checkpoint_dir

    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    return len(path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def test_tables_go_when_released(spark, docs):
    release(spark)
    before = left(spark)
    got = t.search(docs, "doc_id", BODY, asked(spark, "er"))
    assert got.count() and left(spark) > before
    release(spark)
    assert left(spark) == before
    with scratch(spark):
        kept = cut(docs.limit(1))
        with scratch(spark):
            cut(docs.limit(2))
            assert left(spark) == before + 2
        assert left(spark) == before + 1 and kept.count() == 1
    assert left(spark) == before


# Words within some edits, pieces of texts, vectors by codes


@pytest.mark.parametrize("distance", [1, 2])
def test_fuzzy_join_against_all_pairs(spark, distance):
    rng = random.Random(distance)
    some = lambda n: ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 16))) for _ in range(n)]
    a = some(60) + ["ca", "abc", "a", "abcdefghijklmnop", None, "teh"]
    b = [w[:i] + w[i + 1 :] for w in a if w for i in (0, len(w) // 2)] + [w[:3] + w[4:5] + w[3:4] + w[5:] for w in a if w and len(w) > 5] + ["xx" + w for w in a if w] + [w + "yz" for w in a if w] + some(60) + ["the", None, ""]
    got = {tuple(r) for r in t.fuzzy_join(spark.createDataFrame([(w,) for w in a], "word string"), spark.createDataFrame([(w,) for w in b], "term string"), distance).collect()}
    want = {(x, y, t.damerau(x, y)) for x in a if x for y in b if y is not None and t.damerau(x, y) <= distance}
    assert got == want and len(want) > 80


def test_fuzzy_join_is_an_equi_join(spark):
    words = spark.createDataFrame([("a",)], "word string")
    joined = plan(t.fuzzy_join(words, words.toDF("term")))
    assert "Cartesian" not in joined and "NestedLoop" not in joined


def best_pieces(text, terms, most, width):
    """All windows tried one after the other."""
    import re

    words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text or "")]
    hits = [i for i, w in enumerate(words) if w[2] in terms]
    taken, out = [], []
    while len(out) < most:
        options = []
        for a in hits:
            inside = [i for i in hits if a <= i < a + width]
            if all(inside[-1] < x or a > y for x, y in taken):
                options.append((-len({words[i][2] for i in inside}), -len(inside), a, inside))
        if not options:
            return out
        different, _, a, inside = min(options)
        taken.append((a, inside[-1]))
        parts, at = [], words[a][0]
        for i in inside:
            parts.append(text[at : words[i][0]] + "<mark>" + text[words[i][0] : words[i][1]] + "</mark>")
            at = words[i][1]
        out.append(("".join(parts), -different))
    return out


@pytest.mark.parametrize(("most", "width"), [(1, 5), (3, 4), (5, 20)])
def test_fragments_against_all_windows(spark, most, width):
    rng = random.Random(most)
    texts = [" ".join(rng.choice(["cancer", "Lung", "lung,", "of", "the", "é", "x-lung", "cell"]) for _ in range(rng.randrange(60))) for _ in range(30)] + [None, "", "cancer", "no hit", "CANCER(lung)"]
    df = spark.createDataFrame([(i, x, "lung " * (i % 3)) for i, x in enumerate(texts)], "id int, title string, note string")
    got = {}
    for r in t.fragments(df, "id", ["title", "note"], ["Cancer", "lung"], most, width).orderBy("rank").collect():
        got.setdefault((r.doc_id, r.field), []).append((r.fragment, r.terms))
    want = {(i, f): best_pieces(x, {"cancer", "lung"}, most, width) for i, title in enumerate(texts) for f, x in (("title", title), ("note", "lung " * (i % 3)))}
    assert got == {k: v for k, v in want.items() if v}
    assert t.fragments(df, "id", ["title"], []).count() == 0


def test_codes_leave_few_distances(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    n = e.count()
    pairs = vec.coded_candidates(e, e, 5, blocks=3, slices=2, qid="vec_id")
    assert pairs.count() < 0.2 * n * n and pairs.count() == pairs.distinct().count()
    odd = e.select("vec_id", "embedding").unionByName(spark.createDataFrame([(10**6, [0.0] * len(e.first().embedding)), (10**6 + 1, None), (10**6 + 2, [1.0] * len(e.first().embedding))], "vec_id long, embedding array<float>"))
    some = odd.filter("vec_id % 7 = 0 or vec_id >= 1000000")
    real = "embedding is not null"
    for k in (1, 5, 400):
        assert rows(vec.coded_nearest(some, odd, k, blocks=3, slices=2, qid="vec_id")) == rows(vec.batch_nearest(some.filter(real), odd.filter(real), k, blocks=2, slices=1, qid="vec_id"))


def test_patterns_against_all_terms(spark):
    import re

    rng = random.Random(8)
    terms = ["".join(rng.choice("ab.é") for _ in range(rng.randrange(0, 8))) for _ in range(150)] + ["ABba", None, "a\nb"]
    patterns = ["".join(rng.choice("ab.é*?") for _ in range(rng.randrange(0, 6))) for _ in range(60)] + ["*", "??", "", "a*B", "*a?b*", None, "^a", "a$", "(a|b)*", r"\Ea"]
    got = {tuple(r) for r in t.pattern_join(spark.createDataFrame([(x,) for x in patterns], "pattern string"), spark.createDataFrame([(x,) for x in terms], "term string")).collect()}
    regex = {p: re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p.lower()), re.S) for p in patterns if p is not None}
    assert got == {(p, x) for p, r in regex.items() for x in terms if x is not None and r.fullmatch(x.lower())}


def test_patterns_have_few_candidates(spark, docs):
    terms = t.analyse(docs, "doc_id", BODY).select("term").distinct()
    patterns = spark.createDataFrame([("thst?nt*",), ("*tion",), ("ing*",)], "pattern string")
    n, found = t.pattern_candidates(patterns, terms).count(), t.pattern_join(patterns, terms)
    assert 0 < found.count() <= n < 0.2 * 3 * terms.count()
    assert "Cartesian" not in plan(found) and "NestedLoop" not in plan(found)
