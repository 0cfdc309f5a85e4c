"""What plans read, shuffle and write, for queries that once grew faster than their tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from metaloom import plans
from metaloom.operators import index as ix
from metaloom.operators import relations as rel
from metaloom.operators import text
from metaloom.operators import vectors as vec
from metaloom.plans import records
from metaloom.session import new_folder
from metaloom.sources import sinks


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_of_both_directions_share_their_pairs(spark, data):
    """pairs are made distinct before they become edges."""
    plan = optimized(plans.QUERIES["j6_conversion_edges"](spark, data))
    assert "Aggregate [src_type#" in plan and "Aggregate [src_type" in plan
    assert not [x for x in plan.splitlines() if "Aggregate [" in x and "dst#" in x.split("]")[0]]


def test_runs_of_accessions_read_each_table_once(spark, data):
    """edges of runs are not made for all studies; repeated edges change nothing."""
    plan = optimized(plans.QUERIES["j5_expand_to_runs"](spark, data))
    assert plan.count("l_linenumber#") and plan.count("Relation [l_orderkey") == 2  # runs, and the junction of samples
    e = spark.createDataFrame([("SRP", "SRP1", "SRX", "SRX1"), ("SRX", "SRX1", "SRR", "SRR1"), ("SRS", "SRS1", "SRX", "SRX2"), ("SRX", "SRX2", "SRR", "SRR2")] * 2, "src_type string, src string, dst_type string, dst string")
    a = spark.createDataFrame([("srp1",), ("SRS1",), ("SRR9",)], "accession string")
    assert [r[0] for r in rel.expand_to_runs(a, e).collect()] == ["SRR1", "SRR2", "SRR9"]


def test_external_ids_read_no_runs(spark, data):
    """F8: edges of kinds that nobody asks for are not made."""
    assert "l_orderkey" not in optimized(plans.QUERIES["j7_external_ids"](spark, data))


def test_conversion_of_studies_reads_no_run_accessions(spark, data):
    """F16: the same for samples of studies."""
    plan = optimized(plans.QUERIES["j6_convert"](spark, data))
    assert "l_orderkey" in plan and "concat_ws(-" not in plan


def test_pool_members_multiply_nothing(spark):
    """pools are counted before they are joined; repeated experiments count as often as they stand."""
    e = spark.createDataFrame([("X1",), ("X1",), ("X2",), ("X3",)], "experiment_accession string")
    j = spark.createDataFrame([("X1", "S1"), ("X2", "S2"), ("X3", None)], "experiment_accession string, sample_accession string")
    p = spark.createDataFrame([("S1", "M1"), ("S1", "M2"), ("S1", None), (None, "M3")], "parent_sample string, member_sample string")
    df = rel.experiment_pool_sizes(e, j, p)
    assert sorted(map(tuple, df.collect()), key=str) == [("X1", "S1", 4), ("X2", "S2", 0), ("X3", None, 0)]
    assert "M1" not in optimized(df).split("Join LeftOuter")[0] and "Aggregate [parent_sample" in optimized(df)


def test_xml_files_have_so_many_records(spark, tmp_path):
    """a task reads a file, so files are of bounded size."""
    df = spark.range(25).selectExpr("cast(id as string) id", "'study' type", "1.5 score", "'t' title").coalesce(1)
    sinks.write_xml(df, str(tmp_path / "x"), rows_a_file=10)
    assert len(list((tmp_path / "x").glob("part-*"))) == 3
    back = spark.read.format("xml").option("rowTag", "result").schema("_id STRING").load(str(tmp_path / "x"))
    assert sorted(int(r[0]) for r in back.collect()) == list(range(25))


def test_nearest_rows_are_merged_tile_by_tile(monkeypatch):
    """groups come as Arrow tables, and of all tiles only the best k are held, ties by id."""
    monkeypatch.setattr(vec, "TILE", (3, 4))
    rng = np.random.default_rng(1)
    v = rng.integers(-1, 2, (23, 3)).astype(np.float32)  # many ties, some zero vectors
    ids = rng.permutation(23)
    lists = pa.array(v.tolist(), pa.list_(pa.float32()))
    got = vec._best(4)(pa.table({"query_id": ids, "q": lists}), pa.table({"vec_id": ids, "v": lists})).to_pylist()
    u = vec._unit(v.astype(np.float64))
    d = np.round(1 - u @ u.T, 6) + 0.0
    want = [(int(q), int(i)) for a, q in enumerate(ids) for _, i in sorted(zip(d[a], ids, strict=True))[:4]]
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == sorted(want)


def test_hits_are_dealt_by_what_meets(spark, monkeypatch):
    """a task has about so many meetings of hits and queries, whatever the number of shuffle partitions; scores stay."""
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 3}") for i in range(40)], "id long, body string")
    q = spark.createDataFrame([(n, w) for n in range(5) for w in ("alpha", "w1")], "query_id long, term string")
    ask = lambda: text.search(docs, "id", {"body": "standard"}, q)
    want = sorted(map(tuple, ask().collect()))
    monkeypatch.setattr(text, "MEETINGS", 10)
    df = ask()
    assert "RepartitionByExpression [doc_id" in optimized(df) and ", 27" in optimized(df).split("RepartitionByExpression [doc_id")[1].splitlines()[0]
    assert sorted(map(tuple, df.collect())) == want and len(want) == 200


def test_index_pairs_meet_no_blocks(spark, monkeypatch):
    """what a query and a document have in common is summed where the document lies, however many blocks are read."""
    docs = spark.createDataFrame([(i, " ".join(["alpha"] * (1 + i % 3) + ["beta"] * (i % 2) + [f"w{i % 5}"])) for i in range(90)], "id long, body string")
    q = spark.createDataFrame([(n, f"alpha beta w{n}") for n in range(4)], "query_id long, query string")
    folder = new_folder(spark, "index")
    ix.create(docs, "id", {"body": "standard"}, folder, buckets=2, block_size=4)
    monkeypatch.setattr(text, "MEETINGS", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = ix.search(spark, folder, q, 3)
        plan = optimized(df)
        assert "RepartitionByExpression [doc_id" in plan
        assert not [x for x in plan.splitlines() if "Join LeftSemi" in x and "query_id#" in x]  # pairs meet no table of blocks
        got = sorted(map(tuple, df.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    terms = q.selectExpr("query_id", "explode(split(query, ' ')) term")
    want = text.top_hits(text.search(docs, "id", {"body": "standard"}, terms), 3)
    assert got == sorted(map(tuple, want.select(*df.columns).collect())) and len(got) == 12


def test_index_tasks_hold_so_many_words(spark, monkeypatch):
    """words are counted inside their rows, and written by as many tasks as they ask for; documents that share an id stay apart."""
    monkeypatch.setattr(ix, "TASK_WORDS", 40)
    docs = spark.createDataFrame([(i // 2, f"b a b w{i} {'c ' * (i % 4)}", f"B a{i % 3}") for i in range(40)], "id long, body string, tag string")
    folder = new_folder(spark, "index")
    ix.create(docs, "id", {"body": "standard", "tag": "keyword"}, folder, buckets=2, block_size=4, stop=False)
    rows = spark.read.parquet(f"{folder}/postings").selectExpr("field", "term", "inline(entries)").select("field", "doc_id", "length", "term", "tf")
    want = [(f, i // 2, len(w), t, w.count(t)) for i in range(40) for f, w in (("body", f"b a b w{i} {'c ' * (i % 4)}".split()), ("tag", [f"b a{i % 3}"])) for t in set(w)]
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    made = ix._postings(spark.read.parquet(f"{folder}/forward").drop("generation"), {"body": "standard", "tag": "keyword"}, 2)
    plan = optimized(made)
    assert not [x for x in plan.splitlines() if x.strip(" +-:").startswith("Aggregate")], plan
    assert made.select("slice").distinct().count() > 1 and ", 7" in plan.split("RepartitionByExpression [bucket")[1].splitlines()[0]


def _odd_texts(spark):
    rows = [(1, "b a b the a b", "X y"), (2, "a", None), (2, "a c a", "X y"), (None, "c z", "q"), (None, "c", "q"), (3, None, None), (4, "", "q"), (5, "... the", None)]
    return spark.createDataFrame(rows, "id long, body string, tag string"), {"body": "standard", "tag": "keyword"}


def test_terms_are_counted_inside_their_rows(spark, data):
    """a row a term and task is shuffled; rows that share an id are one document, those without one are none."""
    assert "doc_id" not in "".join(x for x in optimized(plans.QUERIES["t5_analysis"](spark, data)).splitlines() if "Aggregate" in x)
    docs, fields = _odd_texts(spark)
    want = text.analyse(docs, "id", fields).groupBy("term").agg(F.count("*").alias("tokens"), F.countDistinct("doc_id").alias("docs"), F.sum("position").alias("places"))
    for some in (docs, docs.filter("body like 'b%'")):
        some_want = want if some is docs else text.analyse(some, "id", fields).groupBy("term").agg(F.count("*").alias("tokens"), F.countDistinct("doc_id").alias("docs"), F.sum("position").alias("places"))
        got = text.term_totals(some, "id", fields)
        assert got.dtypes == some_want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, some_want.collect()))


def test_postings_are_grouped_inside_their_rows(spark, data):
    """no posting is shuffled but of rows that share an id."""
    plan = optimized(plans.QUERIES["t25_delete"](spark, data))
    assert not [x for x in plan.splitlines() if "Aggregate [term" in x or "Aggregate [doc_id" in x]
    docs, fields = _odd_texts(spark)
    for some in (docs, docs.filter("id = 1")):
        want, got = text.postings(text.analyse(some, "id", fields)).drop("positions"), text.document_terms(some, "id", fields)
        assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_patterns_meet_terms_by_one_substring(spark):
    """a pattern meets the terms by the rarest substring that it requires, once; odd patterns too."""
    terms = spark.createDataFrame([(x,) for x in ["banana", "bandana", "Ban", "an", "a", "aba", "abba", "a.b", "axb", "éa", ""]] + [(None,)], "term string")
    patterns = spark.createDataFrame([(x,) for x in ["ban*", "*ana", "b?n*a", "?n", "a?b", "ab*ba", "*", "a.b", "zzz*", "É?", "", "*and*"]] + [(None,)], "pattern string")
    found = text.pattern_candidates(patterns, terms)
    assert found.count() == found.distinct().count()
    assert {r[1] for r in found.filter("pattern = 'b?n*a'").collect()} <= {"banana", "bandana", "Ban"}
    assert {r[1] for r in found.filter("pattern = 'ban*'").collect()} == {"banana", "bandana", "Ban"}
    assert {r[1] for r in found.filter("pattern = '*and*'").collect()} == {"bandana"} and not found.filter("pattern = 'zzz*'").count()
    assert "Aggregate [pattern#" not in optimized(text.pattern_join(patterns, terms))
    import re

    ts, ps = ([r[0] for r in df.collect() if r[0] is not None] for df in (terms, patterns))
    want = {(p, x) for p in ps for x in ts if re.fullmatch("(?s)" + re.escape(p.lower()).replace(r"\*", ".*").replace(r"\?", "."), x.lower())}
    got = [tuple(r) for r in text.pattern_join(patterns, terms).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_records_of_few_splits_are_dealt_before_they_are_parsed(spark, data):
    """F18 (and F4, where a table has few splits): files are split by bytes, and parsing takes much longer than reading."""
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(100, numPartitions=1).selectExpr("cast(id as string) as id", "'unused' as other")
    record = records.text('<RUN accession="{a}"/>', a=F.col("id"))
    got = records.parsed(df, "RUN", record)
    assert got.rdd.getNumPartitions() >= 2 * cores or cores == 1
    assert sorted(int(r[0]) for r in got.select("_accession").collect()) == list(range(100))
    plan = optimized(got)
    assert plan.count("Repartition ") == (cores > 1) and "from_xml" not in plan.split("Repartition ")[-1].splitlines()[-1]  # columns are moved, not records
    assert "Repartition " not in optimized(records.parsed(spark.range(100, numPartitions=cores).selectExpr("cast(id as string) as id"), "RUN", record))


def test_candidates_of_a_group_are_bounded(spark, monkeypatch):
    """rows that are all alike leave one row a query, which then meets whole vectors; results stay exact."""
    monkeypatch.setattr(vec, "CODE_TILE", (3, 24))
    monkeypatch.setattr(vec, "MOST_OPEN", 10)
    rng = np.random.default_rng(2)
    v = np.concatenate([np.tile([0.5, 0.25, -1.0], (30, 1)), np.zeros((2, 3)), rng.normal(size=(40, 3))]).astype(np.float32)
    e = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    c = e.select("vec_id", vec.coded(F.col("embedding")).alias("c")).select("vec_id", "c.*").toArrow()
    q = pa.table({"query_id": pa.array(range(len(v))), "q": pa.array(v.tolist(), pa.list_(pa.float32()))})
    got = vec._maybe_best(2)(q, c)
    assert isinstance(got, pa.Table) and max(got.group_by("query_id").aggregate([("vec_id", "count")])["vec_id_count"].to_pylist()) <= 10
    full = {r["query_id"] for r in got.to_pylist() if r["vec_id"] is None}
    assert set(range(32)) <= full and len(full) < 50
    for blocks in (1, 3):
        near = vec.coded_nearest(e, e, 2, blocks=blocks, slices=2, qid="vec_id")
        assert sorted(map(tuple, near.collect())) == sorted(map(tuple, vec.batch_nearest(e, e, 2, qid="vec_id").collect()))


def test_conversion_of_studies_makes_pairs_distinct_once(spark, data):
    """F16: pairs become distinct where they are collected, and are read once."""
    plan = optimized(plans.QUERIES["j6_convert"](spark, data))
    assert plan.count("Aggregate [") == 1 and plan.count("l_orderkey#") and plan.count("Relation [l_orderkey") == 1
    e = spark.createDataFrame([("SRX1", "SRP1"), ("SRX2", "SRP1"), ("SRX3", None)], "experiment_accession string, study_accession string")
    j = spark.createDataFrame([("SRX1", "SRS2"), ("SRX1", "SRS2"), ("SRX2", "SRS1"), ("SRX2", "SRS2"), ("SRX3", "SRS3"), ("SRX2", None)], "experiment_accession string, sample_accession string")
    runs = spark.createDataFrame([], "run_accession string, experiment_accession string")
    w = spark.createDataFrame([("srp1 ", "srs"), ("SRP2", "SRS"), ("SRP1", "GSE"), ("", "SRS")], "source string, target_type string")
    got = rel.converted(w, rel.edges(e, runs, j, unique=False)).collect()
    assert [tuple(r) for r in got] == [("SRP1", "SRS", ["SRS1", "SRS2"])]
    assert [tuple(r)[:3] for r in rel.convert(w, rel.edges(e, runs, j)).filter("error is null").collect()] == [tuple(r) for r in got]


def test_bundles_make_samples_distinct_once(spark, data):
    """samples are made distinct by study alone; repeated pairs change nothing."""
    plan = optimized(plans.QUERIES["j18_study_bundle"](spark, data))
    assert not [x for x in plan.splitlines() if "Aggregate [" in x and "concat(SRS" in x]  # no distinct of the junction's pairs
    st = spark.createDataFrame([("P1", "a"), ("P2", "b")], "study_accession string, study_title string")
    e = spark.createDataFrame([("X1", "P1"), ("X2", "P1"), ("X2", "P1"), ("X3", None)], "experiment_accession string, study_accession string")
    j = spark.createDataFrame([("X1", "S1"), ("X1", "S1"), ("X2", "S1"), ("X2", None)], "experiment_accession string, sample_accession string")
    runs = spark.createDataFrame([(f"R{i}", x) for i, x in enumerate(["X1", "X1", "X2", "X3", None, "X9"])], "run_accession string, experiment_accession string")
    got = sorted(map(tuple, rel.study_bundle(st, e, j, runs, limit=3).collect()))
    assert got == [("P1", "a", 3, 1, 4, ["R0", "R1", "R2"]), ("P2", "b", 0, 0, 0, None)]


def test_index_cuts_texts_once_and_shuffles_no_words(spark):
    """texts are cut into words once, blocks are inverted where they are read; batches that end inside a block, null ids and several fields change nothing."""
    docs = spark.createDataFrame([(i if i % 7 else None, f"b a b w{i % 9} {'c ' * (i % 4)}" if i % 5 else None, "B a" if i % 2 else "") for i in range(40)], "id long, body string, title string")
    fields = {"body": "standard", "title": "standard"}
    assert optimized(ix._documents(docs, "id", fields, False)).count("regexp_extract_all") == 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        folder = new_folder(spark, "index")
        ix.create(docs, "id", fields, folder, buckets=2, block_size=4, stop=False)
        made = ix._postings(spark.read.parquet(f"{folder}/forward").drop("generation"), fields, 2)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.read.parquet(f"{folder}/postings").selectExpr("field", "term", "peak", "mean", "size(entries) = n same", "inline(entries)").collect()
    words = [(r.id, f, (r[f] or "").lower().split()) for r in docs.collect() for f in fields]
    want = [(f, i, len(w), t, w.count(t)) for i, f, w in words for t in set(w)]
    assert sorted([(r.field, r.doc_id, r.length, r.term, r.tf) for r in rows], key=str) == sorted(want, key=str) and all(r.same for r in rows)
    for f in fields:
        sizes = [len(w) for _, x, w in words if x == f and w]
        mean = sum(sizes) / len(sizes)
        assert all(abs(r.mean - mean) < 1e-9 and r.peak >= r.tf / (r.tf + 1.2 * (0.25 + 0.75 * r.length / mean)) - 1e-9 for r in rows if r.field == f)


def test_few_changed_documents_move_no_others(spark, monkeypatch):
    """words of stored documents are not shuffled to find those that a change replaces."""
    seen, put = [], ix.cut
    monkeypatch.setattr(ix, "cut", lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), put(df))[1])
    folder = new_folder(spark, "index")
    docs = spark.range(50).selectExpr("id", "concat('a w', id % 3) body")
    ix.create(docs, "id", {"body": "standard"}, folder, buckets=2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ix.delete(spark.range(3).selectExpr("id doc_id"), folder)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(seen) == 1 and "BroadcastHashJoin [doc_id" in seen[0] and "LeftSemi" in seen[0]
    hits = ix.search(spark, folder, spark.createDataFrame([(1, "w1")], "query_id long, query string"), 100)
    assert sorted(r.doc_id for r in hits.collect()) == [i for i in range(3, 50) if i % 3 == 1]
