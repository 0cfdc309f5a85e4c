"""Edge cases of single operators on tiny frames, streams included."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metaloom import plans
from metaloom.session import checkpoint_dir
from metaloom.functions import scalars as sc
from metaloom.operators import predicates as p
from metaloom.operators import ranking as r
from metaloom.operators import relations as rel
from metaloom.operators import stats
from metaloom.operators import text as t
from metaloom.operators import validation as v
from metaloom.operators import vectors as vec
from metaloom.operators.stemming import stems
from metaloom.streaming import incremental as inc


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_dates(spark):
    rows = spark.createDataFrame([("2024-01-15T10:30:00Z",), ("2024-01-15T10:30:00",), ("2024-01-15",), ("2024-01-15 10:30:00",), ("invalid_date",), (None,)], "c string")
    assert [x[0] is not None for x in rows.select(sc.parse_time(F.col("c"))).collect()] == [True] * 4 + [False] * 2


def test_scalars(spark):
    lit = F.lit
    assert one(spark, sc.intent(lit("SRP000001")), sc.intent(lit("protein")), sc.intent(lit("rna-seq x")), sc.intent(lit("cancer")))[:] == ("accession", "general", "technical", "study")
    assert one(spark, sc.ellipsis(lit("abcdefgh"), 6), sc.json_pairs(lit('[{"b":"2","a":"1"}]')), sc.json_pairs(lit("x")), sc.json_list(lit('["a","b"]'), ","))[:] == ("abc...", "a=1; b=2", "", "a,b")
    assert one(spark, sc.organism(lit(" E. coli ")), sc.organism(lit("fOo  BAR baz")), sc.organism(lit("")), sc.strategy(lit("hi c")))[:] == ("Escherichia coli", "Foo bar baz", "", "Hi-C")
    assert one(spark, sc.file_url(lit("SRR123456"), "ftp", "fastq"))[0].endswith("/SRR123/SRR123456/SRR123456.fastq.gz")
    assert one(spark, sc.text_hash(lit("ab")))[0] == format(97 * 31 + 98, "x").upper().lower()


def test_unset_bounds_and_missing_numbers(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "id int, n int")
    assert [x.id for x in df.filter(p.counts_between(F.col("n"), 0, 0)).collect()] == [1, 2, 3]
    assert [x.id for x in df.filter(p.counts_between(F.col("n"), 10, 0)).collect()] == [1, 3]
    assert df.filter(p.date_between(F.lit(None).cast("date"), "2020-01-01", None)).count() == 0


def test_first_date(spark):
    df = spark.createDataFrame([([("ENA-FIRST-PUBLIC", "bad"), ("submission_date", "2024-02-03"), ("ENA-LAST-UPDATE", "2020-01-01")],)], "a array<struct<tag:string,value:string>>")
    assert str(df.select(p.first_date(F.col("a"))).first()[0]) == "2024-02-03"


def test_orphans_keep_blank_keys(spark):
    kids = spark.createDataFrame([("a", "p1"), ("b", "p9"), ("c", ""), ("d", None)], "c string, k string")
    parents = spark.createDataFrame([("p1",)], "k string")
    assert {x.c for x in rel.without_orphans(kids, parents, "k").collect()} == {"a", "c", "d"}


def test_conversion(spark):
    e = spark.createDataFrame([("SRX1", "SRP1"), ("SRX2", "SRP1")], "experiment_accession string, study_accession string")
    runs = spark.createDataFrame([("SRR1", "SRX1")], "run_accession string, experiment_accession string")
    j = spark.createDataFrame([("SRX1", "SRS1")], "experiment_accession string, sample_accession string")
    edge = rel.edges(e, runs, j)
    w = spark.createDataFrame([("srp1 ", "SRX"), ("SRR1", "SRP"), ("", "SRX"), ("SRR1", "GSE"), ("SRP9", "SRX")], "source string, target_type string")
    got = {(x.source, x.target_type): (x.targets, x.error) for x in rel.convert(w, edge).collect()}
    assert got["SRP1", "SRX"] == (["SRX1", "SRX2"], None) and got["SRR1", "SRP"] == (["SRP1"], None)
    assert got["", "SRX"][1] == "unknown accession" and got["SRR1", "GSE"][1] == "unsupported conversion" and got["SRP9", "SRX"][1] == "not found"


def test_enriched_equals_raw_join(spark, data):
    from metaloom.plans import frames as f

    s, e, j, runs = (g(spark, data) for g in (f.study, f.experiment, f.junction, f.run))
    fast = rel.enriched_studies(s, e, j, runs).select("study_accession", "experiments", "samples", "runs")
    raw = s.join(e, "study_accession", "left").join(j, "experiment_accession", "left").join(runs.select("run_accession", "experiment_accession"), "experiment_accession", "left").groupBy("study_accession").agg(F.countDistinct("experiment_accession").alias("experiments"), F.countDistinct("sample_accession").alias("samples"), F.countDistinct("run_accession").alias("runs"))
    assert fast.exceptAll(raw).count() == 0 and raw.count() == fast.count()


def test_empty_pools(spark):
    none = spark.createDataFrame([], "parent_sample string, proportion double")
    assert stats.pool_sizes(none).first()[:] == (0, 0.0, 0)
    pools = spark.createDataFrame([("a", 0.5), ("a", 0.49), ("b", 0.5), ("b", 0.48), ("c", 0.0)], "parent_sample string, proportion double")
    assert {x.parent_sample: x.valid for x in stats.pool_proportions(pools).collect()} == {"a": True, "b": False, "c": True}
    with pytest.raises(ValueError):
        stats.top_values(pools, "password")


def test_upsert_same_key_twice(spark):
    old = spark.createDataFrame([("k", 5, "old"), ("l", 1, "stay")], "k string, seq int, v string")
    new = spark.createDataFrame([("k", 1, "first"), ("k", 2, "second")], "k string, seq int, v string")
    once = r.upsert(old, new, ["k"], "seq")
    assert {x.k: x.v for x in once.collect()} == {"k": "second", "l": "stay"}
    assert {x.k: x.v for x in r.upsert(once, new, ["k"], "seq").collect()} == {"k": "second", "l": "stay"}


def test_budget(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, score double")
    b = spark.createDataFrame([(3, 9.0), (4, 8.0)], "id int, score double")
    assert [x.id for x in r.budget_merge([a, b], "score", "id", 3).collect()] == [2, 1, 3]


def test_text(spark):
    docs = spark.createDataFrame([("a", "Human cancer study of the lung"), ("b", "Homo sapiens cells"), ("c", "")], "id string, body string")
    a = t.analyse(docs, "id", {"body": "standard"})
    post, lens = t.postings(a), t.doc_stats(a)
    assert t.lengths(docs, "id", {"body": "standard"}).exceptAll(lens).count() == 0 and lens.count() == 2
    q = spark.createDataFrame([(1, "cancer"), (2, "homo"), (2, "sapiens"), (3, "unheard")], "query_id int, term string")
    assert sorted((x.query_id, x.doc_id) for x in t.bm25(q, post, lens, need_all=True).collect()) == [(1, "a"), (2, "b")]
    found = sorted(map(tuple, t.bm25(q, post, lens).collect()))
    assert found == sorted(map(tuple, t.search(docs, "id", {"body": "standard"}, q).collect())) and len(found) == 2
    folder = f"{checkpoint_dir(spark)}/index"
    t.store_index(docs, "id", {"body": "standard"}, folder, buckets=4)
    stored = t.stored_search(spark, folder, {1: ["cancer"], 2: ["homo", "sapiens"], 3: ["unheard"]}, buckets=4)
    assert sorted(map(tuple, stored.collect())) == found
    assert [x.term for x in t.fuzzy_terms(post, "humna", 1).collect()] == ["human"]
    texts = spark.createDataFrame([("a c++ b",), ("a c b",), ("x C++.",), ("(re)*",)], "s string")
    assert [x[0] for x in texts.select(t.highlight(F.col("s"), ["c++", "(re)*"])).collect()] == ["a <mark>c++</mark> b", None, "x <mark>C++</mark>.", "<mark>(re)*</mark>"]
    assert [x.doc_id for x in t.phrase(t.postings(t.analyse(docs, "id", {"body": "standard"}, stop=False)), ["of", "the", "lung"]).collect()] == ["a"]
    assert {x.term for x in t.wildcard_terms(post, "*an*").collect()} == {"human", "cancer"}
    assert t.damerau("ca", "abc") == 2 and t.damerau("", "ab") == 2


PAIRS = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss filing file happy happi sky sky relational relat conditional condit valenci valenc vietnamization vietnam operator oper hopefulness hope formality formal triplicate triplic electrical electr goodness good revival reviv adjustable adjust replacement replac adoption adopt probate probat rate rate cease ceas controll control roll roll"


def test_stemming():
    words = PAIRS.split()
    assert stems(pd.Series(words[::2])).tolist() == words[1::2]


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [(x.vec_id, x.distance) for x in vec.nearest(e, "embedding", "vec_id", [1.0, 0.0], 4).collect()] == [(1, 0.0), (2, 1.0), (4, 1.0), (3, 2.0)]
    assert vec.similar_to(e, "embedding", "vec_id", 99, 3).count() == 0
    assert [x[0] for x in e.select(vec.quantised(F.col("embedding"))).collect()] == [[255, 0], [0, 255], [0, 255], [0, 0]]
    got = {(x.query_id, x["rank"]): x.vec_id for x in vec.batch_nearest(e, e, 2, blocks=3, slices=2, qid="vec_id").collect()}
    assert got[1, 1] == 1 and got[1, 2] == 2 and got[4, 1] == 1
    with pytest.raises(Exception):
        e.select(vec.cosine_distance(F.col("embedding"), F.array(F.lit(1.0)))).collect()
    ranked = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    assert vec.reciprocal_rank([ranked, ranked], "id").orderBy("id").first().score == round(2 / 61, 6)


def test_validation(spark):
    docs = spark.createDataFrame([(1, "<EXPERIMENT_SET><EXPERIMENT accession='x'></EXPERIMENT></EXPERIMENT_SET>"), (2, "<?xml version='1.0'?><STUDY><STUDY_TITLE/><STUDY_TYPE/></STUDY>"), (3, "<OTHER/>")], "doc_id long, xml string")
    got = v.required_in_xml(docs)
    assert got.filter("accession = 1").count() == 5 and got.filter("accession = 2").count() == 0
    st = {x.accession: x.status for x in v.status_of(got, docs.select(F.col("doc_id").alias("accession"))).collect()}
    assert st == {1: "INVALID", 2: "VALID", 3: "VALID"}


def test_manifest(spark):
    m = inc.with_source_hash(spark.createDataFrame([("a", "completed"), ("b", "failed"), ("c", "downloading")], "file string, state string"))
    assert [inc.start_or_resume(m, x) for x in "abcd"] == ["done", "start", "resume", "start"] and inc.start_or_resume(m, "a", force=True) == "start"


def test_stream_upserts_files_once(spark, tmp_path):
    src, target, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    record = '<RUN_SET><RUN accession="{}" spots="{}"><TITLE>t</TITLE></RUN></RUN_SET>'

    def go():
        s = inc.xml_stream(spark, str(src), "RUN").select("_accession", F.coalesce(F.col("_spots").cast("long"), F.lit(0)).alias("_spots"))
        inc.upsert_stream(s, target, ["_accession"], "_spots", ck).awaitTermination()
        return {x._accession: x._spots for x in inc.latest_version(spark, target, ["_accession"], "_spots").collect()}

    (src / "a.xml").write_text(record.format("SRR1", 1))
    assert go() == {"SRR1": 1}
    assert go() == {"SRR1": 1}  # nothing new
    (src / "b.xml").write_text(record.format("SRR1", 5))
    (src / "c.xml").write_text(record.format("SRR2", 2))
    assert go() == {"SRR1": 5, "SRR2": 2}
    moved = f"{target}-2"
    inc.compact(spark, target, moved, ["_accession"], "_spots")
    target = moved
    (src / "d.xml").write_text(record.format("SRR1", 3))  # a later batch wins, whatever its number
    assert spark.read.parquet(moved).count() == 2 and go() == {"SRR1": 3, "SRR2": 2}


def test_indexed_search_finds_most(spark):
    """Recall of the registered query against the exact search, on sf0.1; all cells give the exact result."""
    data = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    asked = e.filter("vec_id % 100 = 0")
    exact = {(x.query_id, x.vec_id) for x in vec.batch_nearest(asked, e, 5, qid="vec_id").collect()}
    found = {(x.query_id, x.vec_id) for x in plans.QUERIES["v5_indexed_nearest"](spark, data).collect()}
    assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)
    few = e.limit(300)
    centres = vec.fit_centres(few, 8)
    every = vec.indexed_nearest(few, few, 3, centres, probes=8, part_rows=20, qid="vec_id")
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, vec.batch_nearest(few, few, 3, qid="vec_id").select(*every.columns).collect()))


def test_vectors_as_bytes(spark):
    rows = [(1, [1.5, -2.0]), (2, None), (3, []), (4, [0.25])]
    df = spark.createDataFrame(rows, "k int, v array<float>").coalesce(1).withColumn("b", vec.to_bytes(F.col("v"))).withColumn("w", vec.from_bytes(F.col("b")))
    for r in df.collect():
        assert r.w == r.v and (r.b is None if r.v is None else bytes(r.b) == np.array(r.v, dtype="<f4").tobytes())


def test_changes_and_retention(spark):
    now = spark.createDataFrame([(1, 10), (2, 21), (4, 4)], "id int, hash int")
    was = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, hash int")
    assert {x.id: x.change for x in inc.changes(now, was, "id").collect()} == {2: "changed", 3: "deleted", 4: "new"}
    assert inc.recent(now, F.current_timestamp()).count() == 3


def test_embed_whole_texts(spark, data):
    fn = vec.hashing_embedder(16)
    texts = {1: "x " * 400 + "tail", 2: None, 3: "x " * 400}
    df = spark.createDataFrame(list(texts.items()), "k long, body string")
    got = {r.k: r.embedding for r in vec.embed(df, "k", "body", fn).collect()}
    assert got == {k: v.tolist() for k, v in zip(texts, fn(pd.Series([x or "" for x in texts.values()])))} and got[1] != got[3]
    assert len({tuple(r.embedding) for r in vec.embed(df, "k", "body", fn, longest=512).filter("k <> 2").collect()}) == 1
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    want = dict(zip(docs, (v.tolist() for v in fn(pd.Series(list(docs.values()))))))
    assert {r.doc_id: r.embedding for r in plans.QUERIES["v10_embed"](spark, data).collect()} == want


def test_routing_takes_whole_queries(spark, data, monkeypatch):
    monkeypatch.setattr(t, "routed", lambda queries, *_, **__: queries)
    got = {r.query_id: r.query for r in plans.QUERIES["t21_routing"](spark, data).collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    assert {i: got[i] for i in items} == items and max(map(len, items.values())) > 80


def test_routing_by_intent(spark):
    docs = spark.createDataFrame(
        [
            ("SRP1", "study", "cancer of the liver", None, None), ("SRP2", "study", "liver", None, None), ("SRX1", "experiment", "liver ILLUMINA RNA-Seq", "ILLUMINA", "RNA-Seq"), ("SRX2", "experiment", "liver ILLUMINA WGS", "ILLUMINA", "WGS"),
            ("SRX3", "experiment", "liver PACBIO RNA-Seq", "PACBIO", "RNA-Seq"), ("D1", "document", "liver cancer ILLUMINA RNA-Seq", None, None),
        ],
        "id string, type string, body string, platform string, library_strategy string",
    )
    asked = {1: "srp2", 2: "liver cancer", 3: "illumina liver", 4: "liver RNA-Seq", 5: "Illumina RNA-Seq liver", 6: "liver wgs", 7: "liver"}
    hits = t.routed(spark.createDataFrame(list(asked.items()), "query_id long, query string"), docs, "id", "body").collect()
    got = {i: {r.doc_id for r in hits if r.query_id == i} for i in asked}
    every = {"SRP1", "SRP2", "SRX1", "SRX2", "SRX3", "D1"}
    assert got == {1: {"SRP2"}, 2: {"SRP1", "SRP2"}, 3: {"SRX1", "SRX2"}, 4: {"SRX1", "SRX3"}, 5: {"SRX1"}, 6: every, 7: every}
    alone = t.search(docs.filter("type = 'study'"), "id", {"body": "standard"}, spark.createDataFrame([(2, "liver"), (2, "cancer")], "query_id long, term string")).collect()
    assert {(r.doc_id, r.score) for r in alone} == {(r.doc_id, r.score) for r in hits if r.query_id == 2}


def test_cut_tables_go(spark):
    import os

    from metaloom import session

    root = session.checkpoint_dir(spark).removeprefix("file:")
    there = lambda: {n for n in os.listdir(root) if n.startswith("cut-")}
    before = there()
    with session.scratch(spark):
        a, b = session.cut(spark.range(5)), session.cut(spark.range(0))
        assert a.count() == 5 and b.count() == 0 and b.dtypes == [("id", "bigint")] and len(there() - before) == 2
        session.discard(a)
        assert len(there() - before) == 1
    assert there() == before
