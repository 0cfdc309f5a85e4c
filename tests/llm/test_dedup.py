"""Exact copies, near copies, lines, shards, URLs."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from metaloom.llm import exact_dedup, line_dedup, near_dedup, sharding, url_filter
from metaloom.llm.queries import QUERIES, SQL, URL_RULES
from metaloom.llm.words import exact_shingles, scan, shingles


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, name):
    same(spark, QUERIES[name], SQL[name], data)


def test_exact_odd_rows(odd, none, odd_rows):
    got = exact_dedup.exact_groups(odd).join(odd.select("doc_id").distinct(), "doc_id", "left").collect()
    assert len(got) == len(odd_rows)
    want = brute.exact(odd_rows)
    texts = dict(odd_rows)
    by_sha = defaultdict(list)
    for r in got:
        by_sha[r.text_sha256].append(r)
        if r.doc_id is not None:
            key = "".join(c for c in texts[r.doc_id] or "" if c not in " \t\n\v\f\r")
            assert (r.keep_id, r.group_size) == want[key]
    assert len(by_sha) == len(want) and all(sum(r.kept for r in v) == 1 and len(v) == v[0].group_size for v in by_sha.values())
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_group_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).when(F.col("id") % 3 == 1, F.lit("ho ttext")).otherwise(F.col("id").cast("string")).alias("text"))
        got = exact_dedup.exact_groups(df)
        hot = got.filter("group_size > 1")
        assert hot.count() == 2000 and [tuple(r) for r in hot.select("keep_id", "group_size").distinct().collect()] == [(0, 2000)]
        assert [r.doc_id for r in hot.filter("kept").collect()] == [0] and got.filter("kept").count() == 1001
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("batch", [1, 2, 7])
def test_exact_run_goes_on_over_whole_batches(spark, batch):
    """a batch in which no run begins, in the middle of a partition or at its end."""
    rows = [(i, "hot  text"[: 8 + i % 2] if i < 20 else f"t{i // 3}") for i in range(32)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()}
        want = brute.exact(rows)
        key = {i: t.replace(" ", "") for i, t in rows}
        assert got == {i: (*want[k], i == want[k][0]) for i, k in key.items()}
        assert {r.doc_id for r in exact_dedup.drop_exact_copies(df).collect()} == {k for k, _ in want.values()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_drop_exact_copies(odd):
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(brute.exact([(r.doc_id, r.text) for r in odd.collect()]))


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c", 1), (1, "abc", 2), (2, "a bc", 3), (None, "a b c", 4), (None, None, 5), (3, "", 6), (3, " ", 7), (3, " ", 8), (4, "x", 9), (4, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, metaloom_row_id int").withColumns({"digest": F.lit("d"), "prefix": F.lit("p"), "open": F.lit(True), "part": F.lit(0), "row": F.lit("r"), "norm": F.lit("n")})
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    got = sorted((r.metaloom_row_id, r.doc_id, r.text, r.digest) for r in kept.collect())
    assert [g[:3] for g in got if g[0] != 7 and g[0] != 8] == [(1, 1, "a b c"), (9, 4, "x")] and len(got) == 3 and got[1][1:] == (3, " ", "d")


def test_kept_rows_of_a_group_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 != 1, F.lit("hot text")).otherwise(F.col("id").cast("string")).alias("text")).repartition(6)
        assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(df).collect()) == [0, *range(1, 4000, 4)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


TWO = near_dedup.Sketch(width=2)


def near_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, TWO).collect()}


def agrees(got: dict, docs: list[tuple]):
    want = brute.near(docs)
    assert {i: got[i] for i in want} == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_near_odd_rows(odd, none, odd_rows):
    got = near_dedup.near_duplicates(odd, TWO).collect()
    assert len(got) == len(odd_rows) and all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    agrees({r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}, [(i, t) for i, t in dict(odd_rows).items() if i is not None])
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_chains_and_strays(spark):
    """Copies that drift: neighbours are similar, ends are not; and copies that are too far from all."""
    rng = np.random.default_rng(5)
    docs, words = [], [f"w{i}" for i in range(60)]
    for k in range(40):  # each a step away from the one before
        words = words.copy()
        words[int(rng.integers(60))] = f"new{k}"
        docs.append((k * 3, " ".join(words)))
    base = [f"v{i}" for i in range(80)]
    for k in range(80):
        w = base.copy()
        for place in rng.choice(80, int(rng.integers(1, 12)), replace=False):
            w[place] = f"e{rng.integers(6)}"
        docs.append((1000 + k, " ".join(w)))
    agrees(near_of(spark.createDataFrame(docs, "doc_id long, text string")), docs)


def test_ids_in_several_rows(spark):
    docs = [(1, "a b c d"), (2, "a b c d"), (2, "e f g h"), (3, "e f g h"), (4, "x y")]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), TWO).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    # An id that is the smallest of two classes stands for either text.
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = [(1, one), (1, two), (2, two + " end"), (3, one + " end"), (4, "x y z")]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), TWO).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_pairs_of_one_head_are_dealt_out(spark):
    texts = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(-1, 2000)], "node long, text string")
    pairs = spark.createDataFrame([(-1, i) for i in range(1600)] + [(i, 1999) for i in range(900)] + [(3, 4)], "a long, b long").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        largest = {}
        for most in (10_000, 50):
            met = near_dedup._with_texts(pairs, texts, most)
            assert sorted((r.a, r.b) for r in met.collect()) == sorted((r.a, r.b) for r in pairs.collect())
            assert met.filter("ta != repeat(concat('text ', a, ' '), 50) or tb != repeat(concat('text ', b, ' '), 50)").count() == 0
            largest[most] = met.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert largest[50] < 0.5 * largest[10_000]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", ["gone", "GONE", "metaloom_gone", "node", "label", "component_id", "kept", "mark"])
def test_near_stage_with_clashing_names(spark, name):
    df = spark.createDataFrame([(1, "a b c d", 5), (2, "a b c d", 6), (3, "x y z", 7)], f"doc_id long, text string, {name} long")
    out = near_dedup.drop_near_duplicates(df, TWO)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_near_by_five_words(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = [f"v{i}" for i in range(200)]
    far = [f"x{i}" if i % 25 == 12 else w for i, w in enumerate(base)]  # 183/215 on two words, 156/236 on five
    docs = [(0, " ".join(base)), (1, " ".join(far)), (2, "one two three"), (3, "One two  three"), (4, "one two"), (5, "a b c d"), (6, "a b c d e"), (7, ""), (8, None)]
    for k in range(60):
        w = base.copy()
        for place in rng.choice(200, int(rng.integers(0, 9)), replace=False):
            w[place] = f"e{rng.integers(6)}"
        docs.append((100 + k, " ".join(w)))
    df, five = spark.createDataFrame(docs, "doc_id long, text string"), near_dedup.Sketch(width=5)
    two = brute.near(docs[:2])
    monkeypatch.setattr(brute, "WIDTH", 5)
    assert two[1][1] == 0 and brute.near(docs[:2])[1][1] == 1
    agrees({r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, five).collect()}, docs)
    assert near_dedup.drop_near_duplicates(df.filter("doc_id < 2"), five).count() == 2 and near_dedup.drop_near_duplicates(df.filter("doc_id < 2"), TWO).count() == 1


def test_registers_merge_and_estimate():
    sketch = near_dedup.Sketch()
    a = np.arange(1, 1000, dtype=np.uint64) * np.uint64(2654435761)
    b = a[190:]
    ka, kb, kc = sketch.of([a, b, np.concatenate([a[:500], b])])
    assert (np.maximum(sketch.of([a[:300]])[0], sketch.of([a[300:]])[0]) == ka).all() and (kc == ka).all()
    grid = np.linspace(0, 0.99, 100)
    more, less = np.array([(ka > kb).sum()]), np.array([(ka < kb).sum()])
    at = sketch.likelihood(more, less, 252 - more - less, np.array([len(a) / (len(a) + len(b))]), grid * len(b) / len(a))
    assert abs(grid[at.argmax()] * len(b) / len(a) - 0.81) < 0.08
    one = lambda x, y, n, m: sketch.hopeful(x[None], y[None], np.array([float(n)]), np.array([float(m)]))[0]
    assert one(ka, kb, len(a), len(b)) and not one(ka, sketch.of([a[100:] + np.uint64(7)])[0], 999, 899)


def test_words_that_weak_hashes_confuse(spark):
    from test_tokens import twins

    a, b = twins()
    docs = [(1, a), (2, b), (3, a + " x"), (4, b + " x"), (5, a + " x")]
    agrees(near_of(spark.createDataFrame(docs, "doc_id long, text string")), docs)
    w = scan([a, b], lower=True)
    assert len(w.names) == 2 and w.digests[0].tolist() != w.digests[1].tolist()


def test_exact_shingles_are_word_sequences():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 6, int(n))) for n in rng.integers(0, 12, 60)]
    for width in (1, 2, 3, 5):
        sets = exact_shingles(scan(texts, lower=True), width)
        words = [t.split() for t in texts]
        want = [{tuple(x[i : i + width]) for i in range(len(x) - width + 1)} if len(x) >= width else {tuple(x)} if x else set() for x in words]
        for i in range(60):
            assert len(sets[i]) == len(want[i])
            assert all(len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j]) for j in range(i))


def test_shingles():
    sets = shingles(scan(["A b", "a B c", "", "one", None, "one one one"], lower=True))
    assert [len(s) for s in sets] == [1, 2, 0, 1, 0, 1] and sets[0][0] in sets[1]


def test_lines(odd, none, odd_rows):
    for min_docs, keep in ((2, "none"), (2, "first"), (10, "none")):
        rows = odd.select("doc_id", "text", "words", "pos").distinct()
        out = line_dedup.dedup_lines(rows, line_dedup.line_keep_bitmaps(rows, min_docs, 1, keep)).withColumn("sha", F.sha2("kept_text", 256)).collect()
        docs = [(r.doc_id, r.text) for r in out]
        assert [(r.n_lines, r.n_dropped, r.sha) for r in out] == brute.lines(docs, min_docs, keep == "first")
    assert line_dedup.line_keep_bitmaps(none).count() == 0 and line_dedup.dedup_lines(none, line_dedup.line_keep_bitmaps(odd)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.line_keep_bitmaps(odd, keep="some")


def test_long_documents_of_lines(spark):
    docs = [(i, "\n".join(["common"] + [f"{i}-{k}" for k in range(200)] + ["Common "])) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bitmaps = line_dedup.line_keep_bitmaps(df)
    assert {tuple(x % 2**64 for x in r.words) for r in bitmaps.collect()} == {(2**64 - 2, 2**64 - 1, 2**64 - 1, 2**64 - 1 - (1 << 201 % 64))}
    first = spark.createDataFrame([(i, "common\n" + "\n".join(f"{i}-{k}" for k in range(500))) for i in range(12)] + [(99, "own")], "doc_id long, text string")
    assert [[x % 2**64 for x in r.words] for r in line_dedup.line_keep_bitmaps(first).collect()] == [[2**64 - 2]] * 12
    twice = df.union(df).withColumns({"_id": F.lit(1), "__words": F.lit("x")})  # rows that repeat, names that clash
    out = line_dedup.dedup_lines(twice, line_dedup.line_keep_bitmaps(twice)).collect()
    assert len(out) == 24 and {(r.n_lines, r.n_dropped, r._id, r["__words"]) for r in out} == {(202, 2, 1, "x")}
    r = line_dedup.dedup_lines(df, bitmaps).first()
    assert (r.n_lines, r.n_dropped) == (202, 2) and r.kept_text.split("\n")[0] == f"{r.doc_id}-0"


def sharded_right(rows, texts, n=40):
    load, slots, place = Counter(), defaultdict(list), {}
    for r in rows:
        t = (texts[r.doc_id] or "") if r.doc_id is not None else None
        if t is not None:
            assert r["size"] == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode()) and place.setdefault(t, r.shard) == r.shard
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return load


def test_sharding_query(spark, data, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    load = sharded_right(QUERIES["op4_sharding"](spark, data).collect(), texts)
    groups = Counter()
    for t in texts.values():
        groups[t] += len(t.encode()) + 16
    plain = Counter()
    for name, shard in sharding.schedule([(n, t) for t, n in groups.items()], 40):
        plain[shard] += groups[name]
    assert sum(load.values()) == sum(plain.values()) and max(load.values()) <= 1.01 * max(plain.values())


def test_sharding_odd_rows(odd, none, odd_rows):
    got = sharding.shard_rows(odd, shards=3)
    assert got.count() == len(odd_rows)
    sharded_right(got.collect(), dict(odd_rows), 3)
    assert sharding.shard_rows(none).count() == 0


def test_schedule_is_longest_first():
    plan = dict(sharding.schedule([(7, "a"), (6, "b"), (5, "c"), (4, "d"), (3, "e"), (2, "f")], 3))
    load = Counter()
    for size, name in ((7, "a"), (6, "b"), (5, "c"), (4, "d"), (3, "e"), (2, "f")):
        load[plan[name]] += size
    assert sorted(load.values()) == [9, 9, 9]


def test_buckets_bound_the_schedule(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    rows = sharding.shard_rows(df, shards=4, items=64).collect()
    load = sharded_right(rows, {r.doc_id: f"t{r.doc_id}" for r in rows}, 4)
    assert max(load.values()) <= 1.2 * min(load.values())


URLS = [None, "", "no scheme", "http://", "http://A.Example.NET/en/x?y#z", "http://example.net", "http://net/x", "ftp://x.org/fr/1", "ftp://x.org/fr", "http://xorg/fr/1", "http://a.example.com/de/", "http://a.example.com/en/1", "https://www.a.example.com/en/1/", "https://u:p@h.com:80/p://q#f", "a://b://c/d", "http://h.com#f/x", "http://h.com?q/x", "http://notexample.net/en/", "http://İ.net/"]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, None, None) for i, u in enumerate(URLS)], "page_id long, url string, rule_ string, block int")
    listed = spark.createDataFrame([("a.example.com/en/1",), ("a.example.com/en/1",), (None,), ("never.seen/x",)], "canonical_url string")
    got = {r.page_id: r for r in url_filter.judge_urls(df.drop("block"), listed, URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = brute.url(u)
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, "block" if i in (11, 12) else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *rule), u
    assert url_filter.judge_urls(df.filter("false"), listed, URL_RULES).count() == 0


@pytest.mark.parametrize("url, want", [
    ("http://www.A.com:80/x/", "a.com/x"), ("https://u:p@a.com:443/x?b=2&a=1&utm_source=f#top", "a.com/x?a=1&b=2"), ("http://a.com:8080/", "a.com:8080"),
    ("http://a.com/x?id=1", "a.com/x?id=1"), ("http://a.com/x?ref=y&gclid=3&&", "a.com/x"), ("http://a.com/x?reference=1", "a.com/x?reference=1"), ("http://a.com/a/./b/../c//", "a.com/a/c"), ("http://a.com/../../x", "a.com/x"),
    ("http://a.com/%7euser/%c3%A9%2f%zz%4", "a.com/~user/%C3%A9%2F%zz%4"), ("no scheme", ""), ("http://a.com/.hidden", "a.com/.hidden"), ("http://a.com?q=%41", "a.com?q=A"), ("http://a.com/\nx", "a.com/\nx"),
])
def test_canonical(spark, url, want):
    assert spark.createDataFrame([(url,)], "url string").select(url_filter.canonical(F.col("url"))).first()[0] == want


def test_lists_beyond_the_filter(spark):
    keys = spark.range(300).select(F.concat(F.lit("h.com/"), F.col("id")).alias("canonical_url"))
    pages = spark.range(600).select(F.concat(F.lit("http://h.com/"), F.col("id")).alias("url"), F.lit(1).alias("_key"), F.lit(2).alias("__wanted"), F.lit("x").alias("Host"))
    got = url_filter.judge_urls(pages, keys, [], blocks=4)
    assert got.filter("listed").count() == 300 and got.columns == ["url", "_key", "__wanted", "host", "path", "rule", "listed", "verdict"]


def test_bloom_never_misses_and_false_hits_are_removed(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h.com/"), F.col("id")).alias("canonical_url"))
    pages = spark.range(6000).select(F.concat(F.lit("http://h.com/"), F.col("id")).alias("url"))
    got = url_filter.judge_urls(pages, keys, [], blocks=8)
    assert got.filter("listed").count() == 3000 and url_filter.blocked_bloom(keys, "canonical_url", 8).count() <= 8



@pytest.mark.parametrize("blocks", [4, 1 << 18])
@pytest.mark.parametrize("few", [0, 1 << 20])
def test_urls_of_long_lists(spark, blocks, few):
    """A filter too big to broadcast, and more confirmed URLs than are broadcast; a hot URL, settled ones and ones without host."""
    urls = [f"http://a.com/{i % 700}" for i in range(2000)] + ["http://a.com/hot"] * 3000 + ["http://x.net/1", None, "none"] * 200
    pages = spark.createDataFrame([(i, u, "html") for i, u in enumerate(urls)], "page_id long, url string, html string").repartition(5)
    listed = spark.createDataFrame([(f"a.com/{i}",) for i in range(0, 40_000, 7)] + [("a.com/hot",), ("x.net/1",)], "canonical_url string")
    got = url_filter.judge_urls(pages, listed, URL_RULES, blocks=blocks, few=few)
    assert {r.page_id for r in got.filter("listed").collect()} == {i for i, u in enumerate(urls) if u == "http://a.com/hot" or i < 2000 and (i % 700) % 7 == 0}
    assert got.count() == len(urls) and got.filter("rule = 'net/' and verdict = 'block'").count() == 200


def test_pages_are_not_moved_for_the_list(spark, data):
    """With Spark's own broadcasts off: no exchange has a page's columns in it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.read.parquet(f"{data}/pages.parquet")
        listed = pages.select(url_filter.canonical(F.col("url")).alias("canonical_url"))
        plan = url_filter.judge_urls(pages, listed, URL_RULES)._jdf.queryExecution().executedPlan().toString()
        keys = url_filter.confirmed_keys(pages.select(url_filter.canonical(F.col("url")).alias("key")), listed.toDF("key").distinct())
        assert "Exchange hashpartitioning" not in plan
        assert "html" not in keys._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
