"""Scans, filters, joins, aggregates, rankings and set operations as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.operators import predicates as p
from metaloom.operators import ranking as r
from metaloom.operators import relations as rel
from metaloom.operators import states, stats
from metaloom.plans import frames as f
from metaloom.plans.registry import query
from metaloom.session import new_folder, table
from metaloom.sources import lists, sinks

STUDY, SRX, SRS = "SRP000000007", "SRX000000032", "SRS000000005"


# Scans and lists.
@query("s11_full_scan", "SELECT study_accession, study_title, organism FROM study")
def s11(s, d):
    return f.study(s, d).select("study_accession", "study_title", "organism")


@query("s12_accession_list", "SELECT trim(u) AS accession FROM (SELECT unnest(string_split(text, chr(10))) AS u FROM documents) WHERE trim(u) <> '' AND NOT starts_with(trim(u), '#')")
def s12(s, d):
    return lists.accession_list(table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("value")))


@query("s13_page_anchors", """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def s13(s, d):
    return lists.anchors(table(s, d, "pages"))


SNAPSHOTS = "SELECT event_id, 'file_' || event_id AS name, ts::DATE AS date, CASE WHEN event_type = 'purchase' THEN 'monthly' ELSE 'daily' END AS kind FROM events"


def _files(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.concat(F.lit("file_"), F.col("event_id").cast("string")).alias("name"), F.to_date("ts").alias("date"), F.when(F.col("event_type") == "purchase", "monthly").otherwise("daily").alias("kind"))


@query("s14_pick_snapshot", f"SELECT event_id, name, date::VARCHAR AS date, kind FROM ({SNAPSHOTS}) ORDER BY CASE WHEN kind = 'monthly' AND date_trunc('month', date) = DATE '2024-02-01' OR kind = 'daily' AND DATE '2024-02-03' - date < 7 THEN 0 WHEN kind = 'monthly' THEN 1 ELSE 2 END, date DESC, name LIMIT 1")
def s14(s, d):
    return r.pick_snapshot(_files(s, d), F.lit("2024-02-03").cast("date")).withColumn("date", F.col("date").cast("string"))


@query("o6_newest_files", f"SELECT event_id, name, date::VARCHAR AS date, kind FROM ({SNAPSHOTS}) ORDER BY date DESC, name")
def o6(s, d):
    return lists.newest_first(_files(s, d)).withColumn("date", F.col("date").cast("string"))


# Upserts, bridges, exports.
@query("k1_upsert", ", ranked AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM ranked WHERE n = 1")
def k1(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").withColumn("seq", F.struct("l_shipdate", "l_partkey", "l_suppkey"))
    old = li.filter("l_shipdate < '1995-06-01'")
    return r.upsert(old, li.filter("l_shipdate >= '1995-06-01'"), ["l_orderkey", "l_linenumber"], "seq").drop("seq", "l_shipdate")


@query("k2_bridge_upsert", ", e AS (SELECT * FROM links UNION ALL SELECT * FROM links WHERE link_type = 'url') SELECT DISTINCT * FROM e")
def k2(s, d):
    old = f.links(s, d)
    return r.append_links(old, old.filter("link_type = 'url'"))


@query("k9_conversion_table", ", w AS (SELECT study_accession AS source FROM study UNION ALL SELECT 'XYZ1' UNION ALL SELECT 'SRP999999999'), g AS (SELECT study_accession, string_agg(experiment_accession, ';' ORDER BY experiment_accession) AS targets FROM experiment GROUP BY 1) SELECT source, 'SRX' AS target_type, coalesce(targets, '') AS targets, CASE WHEN targets IS NULL THEN 'failed' ELSE 'ok' END AS status FROM w LEFT JOIN g ON source = study_accession")
def k9(s, d):
    w = f.study(s, d).select(F.col("study_accession").alias("source")).union(s.createDataFrame([("XYZ1",), ("SRP999999999",)], "source string"))
    return sinks.conversion_table(rel.convert(w.withColumn("target_type", F.lit("SRX")), rel.edges(f.experiment(s, d), f.run(s, d), f.junction(s, d)).filter("src_type = 'SRP' and dst_type = 'SRX'")))


# Filters.
@query("p1_taxon", "SELECT sample_accession, taxon_id FROM sample WHERE taxon_id IN (1, 5, 9, 12) AND taxon_id NOT IN (9)")
def p1(s, d):
    return f.sample(s, d).filter(p.in_lists(F.col("taxon_id"), [1, 5, 9, 12], [9])).select("sample_accession", "taxon_id")


@query("p2_organism", "SELECT study_accession, organism FROM study WHERE organism NOT IN ('FRANCE', 'CHINA')")
def p2(s, d):
    return f.study(s, d).filter(p.in_lists(F.col("organism"), None, ["FRANCE", "CHINA"])).select("study_accession", "organism")


@query("p3_date_range", "SELECT experiment_accession FROM experiment WHERE submission_date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'")
def p3(s, d):
    return f.experiment(s, d).filter(p.date_between(F.col("submission_date"), "1994-01-01", "1995-12-31")).select("experiment_accession")


@query("p4_platform", "SELECT experiment_accession, platform FROM experiment WHERE platform IN ('1-URGENT', '2-HIGH')")
def p4(s, d):
    return f.experiment(s, d).filter(p.by_platform(F.col("platform"), ["1-urgent", "2-HIGH"])).select("experiment_accession", "platform")


@query("p5_strategy", "SELECT experiment_accession, library_strategy FROM experiment WHERE library_strategy IN ('F', 'RNA-Seq')")
def p5(s, d):
    return f.experiment(s, d).filter(p.by_strategy(F.col("library_strategy"), ["F", "rnaseq"])).select("experiment_accession", "library_strategy")


@query("p6_instrument", "SELECT sample_accession, cell_type FROM sample WHERE cell_type IN ('Brand#11', 'Brand#23')")
def p6(s, d):
    return f.sample(s, d).filter(p.in_lists(F.col("cell_type"), ["Brand#11", "Brand#23"])).select("sample_accession", "cell_type")


@query("p7_center", "SELECT run_accession FROM run WHERE center_name IN ('R')")
def p7(s, d):
    return f.run(s, d).filter(p.in_lists(F.col("center_name"), ["R"])).select("run_accession")


@query("p8_read_counts", "SELECT run_accession, total_spots FROM run WHERE total_spots >= 20 AND total_bases <= 40000")
def p8(s, d):
    return f.run(s, d).filter(p.all_of(p.counts_between(F.col("total_spots"), 20, 0), p.counts_between(F.col("total_bases"), 0, 40000))).select("run_accession", "total_spots")


@query("p9_study_type", "SELECT study_accession FROM study WHERE study_type IS NULL OR study_type IN ('BUILDING', 'MACHINERY')")
def p9(s, d):
    return f.study(s, d).filter(p.by_study_type(F.col("study_type"), ["BUILDING", "MACHINERY"])).select("study_accession")


@query("p11_conjunction", "SELECT experiment_accession FROM experiment WHERE platform = '1-URGENT' AND library_strategy = 'O' AND submission_date >= DATE '1995-01-01'")
def p11(s, d):
    e = f.experiment(s, d)
    return e.filter(p.all_of(p.by_platform(F.col("platform"), ["1-URGENT"]), p.by_strategy(F.col("library_strategy"), ["O"]), p.date_between(F.col("submission_date"), "1995-01-01", None))).select("experiment_accession")


@query("p12_organism_contains", "SELECT study_accession, organism FROM study WHERE organism ILIKE '%an%' OR study_title ILIKE '%an%'")
def p12(s, d):
    return f.study(s, d).filter(p.should(p.contains(F.col("organism"), "an"), p.contains(F.col("study_title"), "an"))).select("study_accession", "organism")


@query("p13_strategy_contains", "SELECT experiment_accession FROM experiment WHERE platform ILIKE '%urg%'")
def p13(s, d):
    return f.experiment(s, d).filter(p.contains(F.col("platform"), "urg")).select("experiment_accession")


@query("p14_lookup", f"SELECT study_accession, study_title, study_type, organism FROM study WHERE study_accession = '{STUDY}'")
def p14(s, d):
    return rel.lookup(f.study(s, d), "study_accession", STUDY).select("study_accession", "study_title", "study_type", "organism")


@query("p15_json_field", "SELECT experiment_accession FROM experiment WHERE json_extract_string(metadata, '$.platform') = '5-LOW'")
def p15(s, d):
    return f.experiment(s, d).filter(p.json_equals(F.col("metadata"), "platform", "5-LOW")).select("experiment_accession")


@query("p16_ranges", "SELECT run_accession FROM run WHERE total_spots BETWEEN 10 AND 20 AND total_bases BETWEEN 10000 AND 20000 AND published BETWEEN '1994-01-01' AND '1996-01-01'")
def p16(s, d):
    return f.run(s, d).filter(p.must(p.in_range(F.col("total_spots"), 10, 20), p.in_range(F.col("total_bases"), 10000, 20000), p.in_range(F.col("published"), "1994-01-01", "1996-01-01"))).select("run_accession")


@query("p17_identifiers", "SELECT * FROM identifiers WHERE id_value = 'SAMN000000003' UNION ALL SELECT * FROM identifiers WHERE record_type = 'study' AND record_accession = 'SRP000000004'")
def p17(s, d):
    i = f.identifiers(s, d)
    return rel.lookup(i, "id_value", "SAMN000000003").union(i.filter(p.of_record("study", "SRP000000004")))


@query("p18_links_and_pools", "SELECT record_accession AS a, url AS b FROM links WHERE record_type = 'study' AND record_accession = 'SRP000000003' UNION ALL SELECT parent_sample, member_sample FROM pool WHERE parent_sample = 'SRS000000001'")
def p18(s, d):
    a = f.links(s, d).filter(p.of_record("study", "SRP000000003")).select(F.col("record_accession").alias("a"), F.col("url").alias("b"))
    return a.union(rel.lookup(f.pool(s, d), "parent_sample", "SRS000000001").select("parent_sample", "member_sample"))


@query("p19_filter_account", "SELECT CASE WHEN platform NOT IN ('1-URGENT', '2-HIGH') THEN 'platform' WHEN library_strategy NOT IN ('O') THEN 'strategy' WHEN submission_date < DATE '1995-01-01' THEN 'date' ELSE 'matched' END AS outcome, count(*) AS records FROM experiment GROUP BY 1")
def p19(s, d):
    checks = {"platform": p.by_platform(F.col("platform"), ["1-URGENT", "2-HIGH"]), "strategy": p.by_strategy(F.col("library_strategy"), ["O"]), "date": p.date_between(F.col("submission_date"), "1995-01-01", None)}
    return p.account(f.experiment(s, d), checks)


# Joins.
J = "JOIN experiment USING (experiment_accession)"


@query("j1_runs_of_study", f"SELECT run_accession, platform, library_strategy FROM run {J} WHERE study_accession = '{STUDY}'")
def j1(s, d):
    return rel.runs_of(f.run(s, d), f.experiment(s, d), f.junction(s, d), "study", STUDY).select("run_accession", "platform", "library_strategy")


@query("j1_runs_of_sample", f"SELECT run_accession, platform FROM run {J} WHERE experiment_accession IN (SELECT experiment_accession FROM junction WHERE sample_accession = '{SRS}')")
def j1b(s, d):
    return rel.runs_of(f.run(s, d), f.experiment(s, d), f.junction(s, d), "sample", SRS).select("run_accession", "platform")


@query("j2_samples_of_study", f"SELECT DISTINCT sample_accession, tissue FROM sample JOIN junction USING (sample_accession) {J} WHERE study_accession = '{STUDY}'")
def j2(s, d):
    return rel.samples_of(f.sample(s, d), f.experiment(s, d), f.junction(s, d), "study", STUDY).select("sample_accession", "tissue")


@query("j3_experiments_of_sample", f"SELECT experiment_accession, platform FROM experiment JOIN junction USING (experiment_accession) WHERE sample_accession = '{SRS}'")
def j3(s, d):
    return rel.experiments_of(f.experiment(s, d), f.junction(s, d), "sample", SRS).select("experiment_accession", "platform")


@query("j4_studies_of_sample", f"SELECT DISTINCT study_accession, study_title FROM study JOIN experiment USING (study_accession) JOIN junction USING (experiment_accession) WHERE sample_accession = '{SRS}'")
def j4(s, d):
    return rel.studies_of(f.study(s, d), f.experiment(s, d), f.run(s, d), f.junction(s, d), "sample", SRS).select("study_accession", "study_title")


@query("j5_expand_to_runs", f"SELECT DISTINCT run_accession FROM run {J} WHERE study_accession = '{STUDY}' OR experiment_accession = '{SRX}' OR experiment_accession IN (SELECT experiment_accession FROM junction WHERE sample_accession = '{SRS}')")
def j5(s, d):
    wanted = s.createDataFrame([(STUDY.lower() + " ",), (SRX,), (SRS,)], "accession string")
    return rel.expand_to_runs(wanted, rel.edges(f.experiment(s, d), f.run(s, d), f.junction(s, d), unique=False))


EDGES = """, e AS (
  SELECT 'SRP' AS a, study_accession AS x, 'SRX' AS b, experiment_accession AS y FROM experiment UNION SELECT 'SRP', study_accession, 'SRR', run_accession FROM experiment JOIN run USING (experiment_accession)
  UNION SELECT 'SRP', study_accession, 'SRS', sample_accession FROM experiment JOIN junction USING (experiment_accession) UNION SELECT 'SRX', experiment_accession, 'SRP', study_accession FROM experiment
  UNION SELECT 'SRX', experiment_accession, 'SRR', run_accession FROM run UNION SELECT 'SRX', experiment_accession, 'SRS', sample_accession FROM junction
  UNION SELECT 'SRR', run_accession, 'SRX', experiment_accession FROM run UNION SELECT 'SRR', run_accession, 'SRP', study_accession FROM experiment JOIN run USING (experiment_accession)
  UNION SELECT 'SRS', sample_accession, 'SRX', experiment_accession FROM junction)"""


@query("j6_conversion_edges", EDGES + " SELECT a AS src_type, b AS dst_type, count(*) AS edges, count(DISTINCT x) AS sources FROM e GROUP BY ALL")
def j6(s, d):
    return rel.edges(f.experiment(s, d), f.run(s, d), f.junction(s, d)).groupBy("src_type", "dst_type").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))


@query("j6_convert", EDGES + " SELECT x AS source, b AS target_type, string_agg(y, ';' ORDER BY y) AS targets FROM e WHERE a = 'SRP' AND b = 'SRS' GROUP BY ALL")
def j6b(s, d):
    w = f.study(s, d).select(F.col("study_accession").alias("source"), F.lit("srs").alias("target_type"))
    out = rel.converted(w, rel.edges(f.experiment(s, d), f.run(s, d), f.junction(s, d, unique=False), unique=False))
    return out.select("source", "target_type", F.array_join("targets", ";").alias("targets"))


@query("j7_external_ids", "SELECT id_value AS source, CASE record_type WHEN 'study' THEN 'SRP' ELSE 'SRS' END AS target_type, record_accession AS targets FROM identifiers")
def j7(s, d):
    ids = f.identifiers(s, d)
    w = ids.select(F.col("id_value").alias("source"), F.when(F.col("record_type") == "study", "SRP").otherwise("SRS").alias("target_type"))
    out = rel.convert(w, rel.edges(f.experiment(s, d), f.run(s, d), f.junction(s, d), ids))
    return out.select("source", "target_type", F.array_join("targets", ";").alias("targets"))


@query("j8_experiment_rows", "SELECT experiment_accession, sample_accession FROM experiment LEFT JOIN junction USING (experiment_accession)")
def j8(s, d):
    return rel.experiment_rows(f.experiment(s, d), f.junction(s, d)).select("experiment_accession", "sample_accession")


@query("j9_wide_record", "SELECT platform, study_type, count(*) AS n, sum(total_spots)::BIGINT AS spots, sum(taxon_id)::BIGINT AS taxa FROM run JOIN experiment USING (experiment_accession) JOIN junction USING (experiment_accession) JOIN sample USING (sample_accession) JOIN study USING (study_accession) GROUP BY ALL")
def j9(s, d):
    w = rel.wide(f.run(s, d), f.experiment(s, d), f.sample(s, d), f.junction(s, d), f.study(s, d))
    return w.groupBy("platform", "study_type").agg(F.count("*").alias("n"), F.sum("spots").cast("long").alias("spots"), F.sum("taxon_id").alias("taxa"))


@query("j10_metrics", "SELECT run_accession, total_spots::DOUBLE AS spots, total_bases::DOUBLE AS bases FROM run JOIN experiment USING (experiment_accession) WHERE total_spots IS NOT NULL OR total_bases IS NOT NULL")
def j10(s, d):
    return rel.with_metrics(f.run(s, d).join(f.experiment(s, d).select("experiment_accession"), "experiment_accession")).select("run_accession", "spots", "bases")


@query("j11_enriched_studies", "SELECT study_accession, study_title, study_type, organism, coalesce(string_agg(DISTINCT platform, ',' ORDER BY platform), '') AS platforms, coalesce(string_agg(DISTINCT library_strategy, ',' ORDER BY library_strategy), '') AS strategies, count(DISTINCT experiment_accession) AS experiments, count(DISTINCT sample_accession) AS samples, count(DISTINCT run_accession) AS runs FROM study LEFT JOIN experiment USING (study_accession) LEFT JOIN junction USING (experiment_accession) LEFT JOIN run USING (experiment_accession) GROUP BY ALL")
def j11(s, d):
    return rel.enriched_studies(f.study(s, d), f.experiment(s, d), f.junction(s, d), f.run(s, d)).drop("study_abstract")


ORPHANS = ", c AS (SELECT * FROM study WHERE study_type <> 'BUILDING'), e AS (SELECT * FROM experiment WHERE study_accession IN (SELECT study_accession FROM c))"


def _some_parents(s, d):
    return f.study(s, d).filter("study_type <> 'BUILDING'")


@query("j12_without_orphans", ORPHANS + " SELECT run_accession FROM run WHERE experiment_accession IN (SELECT experiment_accession FROM e)")
def j12(s, d):
    e = rel.without_orphans(f.experiment(s, d), _some_parents(s, d), "study_accession")
    return rel.without_orphans(f.run(s, d), e, "experiment_accession").select("run_accession")


@query("d2_cascade", "SELECT 'study' AS type, study_accession AS accession FROM study WHERE organism = 'CHINA' UNION ALL SELECT 'experiment', experiment_accession FROM experiment JOIN study USING (study_accession) WHERE organism = 'CHINA' UNION ALL SELECT 'run', run_accession FROM run JOIN experiment USING (experiment_accession) JOIN study USING (study_accession) WHERE organism = 'CHINA'")
def d2(s, d):
    st, e, ru = rel.cascade([(f.study(s, d).filter("organism = 'CHINA'"), "study_accession"), (f.experiment(s, d), "experiment_accession"), (f.run(s, d), "run_accession")])
    rows = lambda df, kind, key: df.select(F.lit(kind).alias("type"), F.col(key).alias("accession"))
    return rows(st, "study", "study_accession").unionByName(rows(e, "experiment", "experiment_accession")).unionByName(rows(ru, "run", "run_accession"))


@query("j13_orphan_counts", ORPHANS + " SELECT 'experiments' AS entity, count(*) AS orphans FROM experiment WHERE study_accession NOT IN (SELECT study_accession FROM c) UNION ALL SELECT 'runs', count(*) FROM run WHERE experiment_accession NOT IN (SELECT experiment_accession FROM e)")
def j13(s, d):
    e = rel.without_orphans(f.experiment(s, d), _some_parents(s, d), "study_accession")
    count = lambda df, n: df.agg(F.count("*").alias("orphans")).select(F.lit(n).alias("entity"), "orphans")
    return count(rel.orphans(f.experiment(s, d), _some_parents(s, d), "study_accession"), "experiments").union(count(rel.orphans(f.run(s, d), e, "experiment_accession"), "runs"))


@query("j14_experiment_full", "SELECT experiment_accession, study_title, organism, tissue, cell_type FROM experiment LEFT JOIN (SELECT study_accession, study_title, organism FROM study) USING (study_accession) LEFT JOIN junction USING (experiment_accession) LEFT JOIN (SELECT sample_accession, tissue, cell_type FROM sample) USING (sample_accession)")
def j14(s, d):
    return rel.experiment_full(f.experiment(s, d), f.study(s, d), f.sample(s, d), f.junction(s, d)).select("experiment_accession", "study_title", "organism", "tissue", "cell_type")


@query("j15_run_stats", "SELECT run_accession, total_spots, platform, study_title FROM run LEFT JOIN experiment USING (experiment_accession) LEFT JOIN study USING (study_accession)")
def j15(s, d):
    return rel.run_stats(f.run(s, d), f.experiment(s, d), f.study(s, d)).select("run_accession", "total_spots", "platform", "study_title")


@query("j16_experiment_pools", "SELECT experiment_accession, sample_accession, count(member_sample) AS members FROM experiment JOIN junction USING (experiment_accession) LEFT JOIN pool ON sample_accession = parent_sample GROUP BY ALL")
def j16(s, d):
    return rel.experiment_pool_sizes(f.experiment(s, d), f.junction(s, d), f.pool(s, d))


RELATED = ", r AS (SELECT study_accession, min(study_accession) OVER (PARTITION BY study_type, organism) AS related_accession FROM study)"


@query("j17_related_studies", RELATED + " SELECT a.study_accession, a.study_title, related_accession, b.study_title AS related_title FROM study a JOIN r ON a.study_accession = r.study_accession LEFT JOIN study b ON b.study_accession = related_accession")
def j17(s, d):
    st = f.study(s, d)
    first = st.groupBy("study_type", "organism").agg(F.min("study_accession").alias("related_accession"))
    return rel.related_studies(st, st.join(first, ["study_type", "organism"]).select("study_accession", "related_accession"))


@query("j18_study_bundle", ", o AS (SELECT study_accession, run_accession, row_number() OVER (PARTITION BY study_accession ORDER BY run_accession) AS n FROM run JOIN experiment USING (experiment_accession)), a AS (SELECT study_accession, count(*) AS n_runs, string_agg(run_accession, ';' ORDER BY run_accession) FILTER (n <= 100) AS first_runs FROM o GROUP BY 1), b AS (SELECT study_accession, count(*) AS n_experiments FROM experiment GROUP BY 1), c AS (SELECT study_accession, count(DISTINCT sample_accession) AS n_samples FROM junction JOIN experiment USING (experiment_accession) GROUP BY 1) SELECT study_accession, study_title, coalesce(n_experiments, 0) AS n_experiments, coalesce(n_samples, 0) AS n_samples, coalesce(n_runs, 0) AS n_runs, coalesce(first_runs, '') AS first_runs FROM study LEFT JOIN a USING (study_accession) LEFT JOIN b USING (study_accession) LEFT JOIN c USING (study_accession)")
def j18(s, d):
    out = rel.study_bundle(f.study(s, d), f.experiment(s, d), f.junction(s, d, unique=False), f.run(s, d))
    return out.withColumn("first_runs", F.coalesce(F.array_join("first_runs", ";"), F.lit("")))


@query("j19_accession_types", f"SELECT x AS accession, CASE WHEN x IN (SELECT study_accession FROM study) THEN 'study' WHEN x IN (SELECT experiment_accession FROM experiment) THEN 'experiment' WHEN x IN (SELECT sample_accession FROM sample) THEN 'sample' WHEN x IN (SELECT run_accession FROM run) THEN 'run' ELSE 'unknown' END AS type FROM (SELECT unnest(['{STUDY}', '{SRX}', '{SRS}', 'SRZ1']) AS x)")
def j19(s, d):
    wanted = s.createDataFrame([(STUDY,), (SRX,), (SRS,), ("SRZ1",)], "accession string")
    entities = [("study", f.study(s, d), "study_accession"), ("experiment", f.experiment(s, d), "experiment_accession"), ("sample", f.sample(s, d), "sample_accession"), ("run", f.run(s, d), "run_accession")]
    return rel.accession_types(wanted, entities)


# Aggregates.
def _entities(s, d):
    return {"studies": f.study(s, d), "experiments": f.experiment(s, d), "samples": f.sample(s, d), "runs": f.run(s, d)}


COUNTS = "SELECT 'studies' AS table_name, count(*) AS row_count FROM study UNION ALL SELECT 'experiments', count(*) FROM experiment UNION ALL SELECT 'samples', count(*) FROM sample UNION ALL SELECT 'runs', count(*) FROM run"


@query("a1_counts", COUNTS)
def a1(s, d):
    return stats.row_counts(_entities(s, d))


@query("a2_statistics", f"SELECT table_name, row_count, '2024-01-01 00:00:00' AS last_updated FROM ({COUNTS} UNION ALL SELECT 'submissions', count(*) FROM submission)")
def a2(s, d):
    return stats.statistics_table(_entities(s, d) | {"submissions": f.submission(s, d)}, F.lit("2024-01-01 00:00:00"))


@query("a3_top_values", 'SELECT organism AS value, count(*) AS "count" FROM study WHERE organism <> \'\' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10')
def a3(s, d):
    return stats.top_values(f.study(s, d), "organism", 10)


@query("a4_aggregation", 'SELECT platform AS value, count(*) AS "count" FROM experiment WHERE platform IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20')
def a4(s, d):
    return stats.top_values(f.experiment(s, d), "platform", 20, keep_blank=True)


@query("a5_study_children", "SELECT study_accession, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms, count(DISTINCT library_strategy) AS strategies FROM experiment GROUP BY 1")
def a5(s, d):
    return stats.study_children(f.experiment(s, d))


@query("a6_a7_pool_sizes", ", z AS (SELECT parent_sample, count(*) AS n FROM pool GROUP BY 1) SELECT count(*) AS pools, round(coalesce(avg(n), 0), 6) AS average_size, coalesce(max(n), 0) AS largest_size FROM z")
def a6(s, d):
    return stats.pool_sizes(f.pool(s, d)).withColumn("average_size", F.round("average_size", 6))


@query("a8_facets", """, p AS (SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS k FROM p WHERE value <> '') SELECT field, value, n AS "count" FROM r WHERE k <= CASE field WHEN 'lang' THEN 3 ELSE 10 END""")
def a8(s, d):
    return stats.facets(table(s, d, "documents").select("lang", "source"), {"lang": 3, "source": 10})


@query("a9_hits_by_field", "SELECT lang, count(*) AS hits FROM documents WHERE contains(text, 'the') GROUP BY 1")
def a9(s, d):
    return table(s, d, "documents").filter(F.contains("text", F.lit("the"))).groupBy("lang").agg(F.count("*").alias("hits"))


@query("a10_overview", "SELECT (SELECT count(*) FROM study) AS studies, (SELECT count(DISTINCT organism) FROM study) AS organisms, (SELECT count(*) FROM experiment) AS experiments, (SELECT count(DISTINCT platform) FROM experiment) AS platforms, (SELECT count(DISTINCT library_strategy) FROM experiment) AS strategies, (SELECT count(*) FROM sample) AS samples, (SELECT count(*) FROM run) AS runs, (SELECT sum(total_bases)::BIGINT FROM run) AS bases, (SELECT max(published) FROM run) AS last_update, (SELECT count(*) FROM submission) AS submissions")
def a10(s, d):
    return stats.overview(f.study(s, d), f.experiment(s, d), f.sample(s, d), f.run(s, d), f.submission(s, d))


@query("a11_runs_with_statistics", "SELECT count(*) AS runs, count(*) FILTER (total_spots > 0) AS with_spots FROM run")
def a11(s, d):
    return stats.runs_with_statistics(f.run(s, d))


@query("a12_daily_snapshot", "SELECT submission_date::VARCHAR AS stat_date, count(*) AS experiments, count(DISTINCT platform) AS platforms, count(DISTINCT library_strategy) AS strategies FROM experiment GROUP BY 1")
def a12(s, d):
    return f.experiment(s, d).groupBy(F.col("submission_date").cast("string").alias("stat_date")).agg(F.count("*").alias("experiments"), F.countDistinct("platform").alias("platforms"), F.countDistinct("library_strategy").alias("strategies"))


@query(
    "a10_a12_merged_states",
    "SELECT strftime(submission_date, '%Y-%m') AS period, 'study_accession' AS field, count(DISTINCT study_accession) AS distinct_values, count(*) AS rows FROM experiment GROUP BY 1 UNION ALL SELECT strftime(submission_date, '%Y-%m'), 'platform', count(DISTINCT platform), count(*) FROM experiment GROUP BY 1 UNION ALL SELECT 'all', 'study_accession', count(DISTINCT study_accession), count(*) FROM experiment UNION ALL SELECT 'all', 'platform', count(DISTINCT platform), count(*) FROM experiment",
)
def a10b(s, d):
    """Distinct studies and platforms of experiments, by month and over all, merged from states of months; the first years' are written twice."""
    folder = new_folder(s, "states")
    e = f.experiment(s, d).select(F.date_format("submission_date", "yyyy-MM").alias("month"), "study_accession", "platform")
    states.write_days(e.filter("month < '1994'").withColumn("platform", F.lit("old")), "month", ["study_accession", "platform"], folder)
    states.write_days(e, "month", ["study_accession", "platform"], folder)
    merged = lambda p: states.merged_distinct(s, folder, p).join(states.merged_totals(s, folder, p), "period")
    return merged(F.col("day").cast("string")).unionByName(merged(None)).select("period", "field", "distinct_values", "rows")


@query("a13_pool_proportions", "SELECT parent_sample, round(sum(CASE WHEN proportion > 0 AND member_sample <> 'SRS000000001' THEN proportion END), 6) AS total, abs(round(sum(CASE WHEN proportion > 0 AND member_sample <> 'SRS000000001' THEN proportion END) - 1, 9)) <= 0.01 AS valid FROM pool GROUP BY 1")
def a13(s, d):
    pools = f.pool(s, d).withColumn("proportion", F.when(F.col("member_sample") != "SRS000000001", F.col("proportion")))
    return stats.pool_proportions(pools)


@query("a14_cross_references", "SELECT record_accession, db, string_agg(id, ';' ORDER BY id) AS ids FROM links WHERE link_type = 'xref' AND db <> '' GROUP BY ALL")
def a14(s, d):
    x = stats.cross_references(f.links(s, d))
    return x.select("record_accession", F.explode("refs").alias("db", "ids")).select("record_accession", "db", F.array_join("ids", ";").alias("ids"))


@query("a15_match_rate", "SELECT count(DISTINCT CASE WHEN platform = '1-URGENT' THEN experiment_accession END) AS matched, count(DISTINCT experiment_accession) AS processed, round(count(DISTINCT CASE WHEN platform = '1-URGENT' THEN experiment_accession END) * 100.0 / count(DISTINCT experiment_accession), 4) AS percent FROM experiment")
def a15(s, d):
    e = f.experiment(s, d)
    return stats.match_rate(e.filter("platform = '1-URGENT'"), e, "experiment_accession").withColumn("percent", F.round("percent", 4))


@query("a16_counts_with_zeros", """SELECT x AS platform, count(platform) AS "count" FROM (SELECT unnest(['1-URGENT', '2-HIGH', 'NONE']) AS x) LEFT JOIN experiment ON platform = x GROUP BY 1""")
def a16(s, d):
    return stats.counts_with_zeros(f.experiment(s, d), "platform", ["1-URGENT", "2-HIGH", "NONE"])


@query("a17_vector_counts", "SELECT label, count(*) AS vectors FROM embeddings GROUP BY 1")
def a17(s, d):
    return table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"))


@query("a18_reconcile", "SELECT source AS type, count(*) FILTER (lang = 'en') AS indexed, count(*) AS stored, count(*) FILTER (lang = 'en') - count(*) AS difference FROM documents GROUP BY 1")
def a18(s, d):
    docs = table(s, d, "documents").withColumnRenamed("source", "type")
    count = lambda df: df.groupBy("type").agg(F.count("*").alias("documents"))
    return stats.reconcile(count(docs.filter("lang = 'en'")), count(docs))


# Windows, limits, sets.
@query("w1_dense_ids", "SELECT row_number() OVER (ORDER BY run_accession) AS id, run_accession FROM run")
def w1(s, d):
    return r.dense_ids(f.run(s, d).select("run_accession"), ["run_accession"])


@query("w3_top_percent", ", n AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, o_totalprice FROM n WHERE k <= greatest(1, floor(n * 2.5 / 100))")
def w3(s, d):
    return r.top_percent(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 2.5)


@query("w4_latest", ", n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type FROM n WHERE k = 1")
def w4(s, d):
    return r.latest(table(s, d, "events"), ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id", "event_type")


@query("w5_first_children", ", n AS (SELECT study_accession, experiment_accession, row_number() OVER (PARTITION BY study_accession ORDER BY experiment_accession) AS k FROM experiment) SELECT study_accession, experiment_accession FROM n WHERE k <= 3")
def w5(s, d):
    return r.first_children(f.experiment(s, d).select("study_accession", "experiment_accession"), "study_accession", "experiment_accession", 3)


@query("o1_page", "SELECT study_accession, study_title FROM study ORDER BY study_accession LIMIT 25 OFFSET 50")
def o1(s, d):
    return r.page(f.study(s, d).select("study_accession", "study_title"), [F.col("study_accession")], 25, 50)


@query("o1_page_after", "SELECT study_accession, study_title FROM study WHERE study_accession > 'SRP000000049' ORDER BY study_accession LIMIT 25")
def o1b(s, d):
    return r.page_after(f.study(s, d).select("study_accession", "study_title"), "study_accession", "SRP000000049", 25)


@query("o3_top_by_score", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 10")
def o3(s, d):
    return r.page(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 30, 10)


@query("o5_top_groups", "SELECT platform, library_strategy, count(*) AS experiments FROM experiment GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 5")
def o5(s, d):
    return stats.top_groups(f.experiment(s, d), ["platform", "library_strategy"], 5, "experiments")


@query("flagship_top_platforms", "SELECT platform, count(*) AS runs, sum(total_spots)::BIGINT AS spots FROM run JOIN experiment USING (experiment_accession) WHERE total_spots >= 10 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def flagship(s, d):
    e = f.experiment(s, d).select("experiment_accession", "platform")
    runs = f.run(s, d).filter(p.counts_between(F.col("total_spots"), 10, 0)).join(e, "experiment_accession")
    return runs.groupBy("platform").agg(F.count("*").alias("runs"), F.sum("total_spots").alias("spots")).orderBy(F.desc("runs"), "platform").limit(10)


@query("o8_budget_merge", "SELECT * FROM (SELECT 0 AS source_rank, o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_orderstatus = 'P' ORDER BY score DESC, id LIMIT 40) UNION ALL SELECT * FROM (SELECT 1, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY 3 DESC, 2 LIMIT (SELECT greatest(0, 40 - count(*)) FROM orders WHERE o_orderstatus = 'P'))")
def o8(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), "o_orderstatus")
    return r.budget_merge([o.filter("o_orderstatus = 'P'").drop("o_orderstatus"), o.filter("o_orderstatus = 'O'").drop("o_orderstatus")], "score", "id", 40)


@query("u1_corpus", "SELECT study_accession AS accession, 'study' AS type, study_title AS title FROM study UNION ALL SELECT experiment_accession, 'experiment', title FROM experiment UNION ALL SELECT sample_accession, 'sample', description FROM sample UNION ALL SELECT run_accession, 'run', published FROM run")
def u1(s, d):
    part = lambda df, key, kind, title: df.select(F.col(key).alias("accession"), F.lit(kind).alias("type"), F.col(title).alias("title"))
    return r.union_corpus([part(f.study(s, d), "study_accession", "study", "study_title"), part(f.experiment(s, d), "experiment_accession", "experiment", "title"), part(f.sample(s, d), "sample_accession", "sample", "description"), part(f.run(s, d), "run_accession", "run", "published")])


@query("u2_two_kinds", "(SELECT study_accession AS accession, study_title AS title FROM study WHERE study_abstract ILIKE '%building%' ORDER BY 1 LIMIT 10) UNION ALL (SELECT experiment_accession, title FROM experiment WHERE title ILIKE '%high%' ORDER BY 1 LIMIT 10)")
def u2(s, d):
    a = f.study(s, d).filter(p.contains(F.col("study_abstract"), "building")).select(F.col("study_accession").alias("accession"), F.col("study_title").alias("title"))
    b = f.experiment(s, d).filter(p.contains(F.col("title"), "high")).select(F.col("experiment_accession").alias("accession"), "title")
    return a.orderBy("accession").limit(10).unionByName(b.orderBy("accession").limit(10), allowMissingColumns=True)


@query("u3_filter_matches", "SELECT experiment_accession, 'platform' AS filter FROM experiment WHERE platform = '1-URGENT' UNION ALL SELECT experiment_accession, 'strategy' FROM experiment WHERE library_strategy = 'P'")
def u3(s, d):
    e = f.experiment(s, d)
    return e.filter("platform = '1-URGENT'").select("experiment_accession", F.lit("platform").alias("filter")).unionByName(e.filter("library_strategy = 'P'").select("experiment_accession", F.lit("strategy").alias("filter")))


@query("u4_distinct", "SELECT DISTINCT platform, library_strategy FROM experiment")
def u4(s, d):
    return f.experiment(s, d).select("platform", "library_strategy").distinct()


@query("u5_insert_or_ignore", "SELECT * FROM junction")
def u5(s, d):
    j = f.junction(s, d)
    return r.insert_or_ignore(j.filter("sample_accession < 'SRS000000100'"), j, ["experiment_accession", "sample_accession"])


@query("u6_not_yet", "SELECT experiment_accession FROM experiment WHERE experiment_accession NOT IN (SELECT experiment_accession FROM run)")
def u6(s, d):
    return r.not_yet(f.experiment(s, d), f.run(s, d), ["experiment_accession"]).select("experiment_accession")
