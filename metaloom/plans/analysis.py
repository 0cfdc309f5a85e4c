"""Scalar functions, extraction rules, validation and incremental operators as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom import schemas
from metaloom.functions import scalars as sc
from metaloom.operators import ranking as r
from metaloom.operators import relations as rel
from metaloom.operators import validation as v
from metaloom.plans import frames as f
from metaloom.plans.registry import query
from metaloom.session import table
from metaloom.sources import xml
from metaloom.streaming import incremental as inc


def quoted(values) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in values)


@query("e2_study_type", "SELECT study_accession, CASE WHEN study_type = 'BUILDING' THEN organism ELSE study_type END AS study_type FROM study")
def e2(s, d):
    existing = F.when(F.col("study_type") == "BUILDING", F.lit("Other")).otherwise(F.col("study_type"))
    return f.study(s, d).select("study_accession", xml.study_type(existing, F.col("organism")).alias("study_type"))


@query("e22_junction", "SELECT experiment_accession, sample_accession FROM junction")
def e22(s, d):
    return f.junction(s, d)


@query("e23_organism", "SELECT p_partkey, CASE lower(p_name) WHEN 'human' THEN 'Homo sapiens' ELSE upper(substr(w[1], 1, 1)) || lower(substr(w[1], 2)) || coalesce(' ' || nullif(lower(array_to_string(w[2:], ' ')), ''), '') END AS organism FROM (SELECT p_partkey, p_name, string_split(regexp_replace(trim(upper(p_name)), '\\s+', ' ', 'g'), ' ') AS w FROM part)")
def e23(s, d):
    return table(s, d, "part").select("p_partkey", sc.organism(F.concat(F.lit("  "), F.regexp_replace(F.upper("p_name"), " ", "   "))).alias("organism"))


@query("e24_strategy", f"SELECT o_orderkey, CASE {' '.join(f'''WHEN k = {i} THEN '{sc.schemas.STRATEGY_SPELLINGS[x]}' ''' for i, x in enumerate(schemas.STRATEGY_SPELLINGS))} ELSE o_orderpriority END AS strategy FROM (SELECT *, o_orderkey % 20 AS k FROM orders)")
def e24(s, d):
    names = F.array(*(F.lit(f" {x.upper()} ") for x in schemas.STRATEGY_SPELLINGS))
    raw = F.coalesce(F.get(names, (F.col("o_orderkey") % 20).cast("int")), F.col("o_orderpriority"))
    return table(s, d, "orders").select("o_orderkey", sc.strategy(raw).alias("strategy"))


ACCS = ", a AS (SELECT study_accession AS acc FROM study UNION ALL SELECT lower(experiment_accession) FROM experiment UNION ALL SELECT id_value FROM identifiers UNION ALL SELECT study_title FROM study)"


def _accs(s, d):
    one = lambda df, c: df.select(F.col(c).alias("acc"))
    return one(f.study(s, d), "study_accession").union(f.experiment(s, d).select(F.lower("experiment_accession"))).union(one(f.identifiers(s, d), "id_value")).union(one(f.study(s, d), "study_title"))


@query("f1_f4_accessions", ACCS + " SELECT acc, CASE upper(substr(acc, 1, 3)) WHEN 'SRP' THEN 'study' WHEN 'SRX' THEN 'experiment' ELSE 'unknown' END AS type, regexp_extract(upper(trim(acc)), '^(PRJNA|PRJEB|PRJDB|SAMN|SAME|SAMD|[SED]R[PXSR]|GSE|GSM)', 1) AS system, regexp_matches(acc, '^(SRP|ERP|DRP)[0-9]{6,9}$') AS valid_study, upper(trim(acc)) AS upper_acc FROM a")
def f1(s, d):
    a = F.col("acc")
    return _accs(s, d).select("acc", sc.record_type(a).alias("type"), sc.id_system(a).alias("system"), sc.is_accession(a, "study").alias("valid_study"), sc.normalised_accession(a).alias("upper_acc"))


@query("f5_f8_columns", "SELECT event_id, coalesce(nullif(event_type, 'click'), '') AS filled, event_type || '-' || nullif(event_type, 'view') AS joined, value::BIGINT::VARCHAR AS as_text, json_extract_string(props, '$.k') AS k FROM (SELECT event_id, event_type, props, floor(value) AS value FROM events)")
def f5(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.coalesce(F.nullif("event_type", F.lit("click")), F.lit("")).alias("filled"), sc.concat_or_null(F.col("event_type"), F.lit("-"), F.nullif("event_type", F.lit("view"))).alias("joined"), F.floor("value").cast("string").alias("as_text"), sc.json_field(F.col("props"), "k").alias("k"))


@query("f9_f10_json", "SELECT event_id, 'k=' || json_extract_string(props, '$.k') || '; t=' || event_type AS pairs, event_type || '; ' || event_id AS listed, '' AS neither FROM events")
def f9(s, d):
    e = table(s, d, "events")
    k = F.get_json_object("props", "$.k")
    pairs = F.concat(F.lit('[{"t":"'), F.col("event_type"), F.lit('","k":"'), k, F.lit('"}]'))
    listed = F.concat(F.lit('["'), F.col("event_type"), F.lit('","'), F.col("event_id").cast("string"), F.lit('"]'))
    return e.select("event_id", sc.json_pairs(pairs).alias("pairs"), sc.json_list(listed).alias("listed"), sc.json_pairs(F.lit("not json")).alias("neither"))


@query("f11_f12_strings", "SELECT sample_accession, concat_ws('|', 'tissue=' || tissue, CASE WHEN cell_type <> 'Brand#11' THEN 'cell_type=' || cell_type END) AS attributes, 'https://www.ncbi.nlm.nih.gov/sra/' || sample_accession AS url, 'https://www.ncbi.nlm.nih.gov/sra/?term=' || sample_accession AS search FROM sample")
def f11(s, d):
    cell = F.when(F.col("cell_type") == "Brand#11", F.lit("")).otherwise(F.col("cell_type"))
    a = F.col("sample_accession")
    return f.sample(s, d).select(a, sc.attribute_string({"tissue": F.col("tissue"), "cell_type": cell}).alias("attributes"), sc.record_url(a).alias("url"), sc.search_url(a).alias("search"))


@query("f13_file_urls", "SELECT a, 'ftp://ftp.sra.ebi.ac.uk/vol1/fastq/' || substr(a, 1, 6) || '/' || CASE WHEN length(a) > 9 THEN '00' || right(a, 1) || '/' ELSE '' END || a || '/' || a || '.fastq.gz' AS fastq, 'ftp://ftp-trace.ncbi.nlm.nih.gov/sra/sra-instant/reads/ByRun/sra/' || substr(a, 1, 3) || '/' || substr(a, 1, 6) || '/' || a || '/' || a || '.sra' AS ftp, 'https://sra-pub-run-odp.s3.amazonaws.com/sra/' || a || '/' || a AS aws, 'https://storage.googleapis.com/sra-pub-run-1/' || a || '/' || a || '.1' AS gcp, 'https://sra-downloadb.be-md.ncbi.nlm.nih.gov/sos2/sra-pub-run-11/' || a || '/' || a || '.1' AS ncbi FROM (SELECT 'SRR' || (o_orderkey * 7919)::VARCHAR AS a FROM orders)")
def f13(s, d):
    a = F.col("a")
    runs = table(s, d, "orders").select(F.concat(F.lit("SRR"), (F.col("o_orderkey") * 7919).cast("string")).alias("a"))
    return runs.select("a", sc.file_url(a, "ftp", "fastq").alias("fastq"), *(sc.file_url(a, x).alias(x) for x in ("ftp", "aws", "gcp", "ncbi")))


@query("f14_f16_text", "SELECT event_id, CASE WHEN event_type = 'click' THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at, nullif(event_type, '') AS type, nullif(user_id, 0) AS user_id, CASE WHEN length(props) > 8 THEN substr(props, 1, 5) || '...' ELSE props END AS short FROM events")
def f14(s, d):
    ts = F.when(F.col("event_type") != "click", F.col("ts"))
    return table(s, d, "events").select("event_id", sc.time_text(ts).alias("at"), sc.null_if_blank(F.col("event_type")).alias("type"), sc.null_if_zero(F.col("user_id")).alias("user_id"), sc.ellipsis(F.col("props"), 8).alias("short"))


@query("f17_f19_hashes", "SELECT n_nationkey, lower(to_hex(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(n_name, ''), lambda c: ascii(c)::HUGEINT)), lambda a, b: (a * 31 + b) % 4294967296)::UBIGINT)) AS text_hash, sha256(n_name) AS source_hash, md5('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}') AS row_hash FROM nation")
def f17(s, d):
    return table(s, d, "nation").select("n_nationkey", sc.text_hash(F.col("n_name")).alias("text_hash"), F.sha2("n_name", 256).alias("source_hash"), sc.row_checksum("n_nationkey", "n_name").alias("row_hash"))


@query("f20_f22_embedding_texts", "SELECT study_accession, 'Organism: ' || organism || ' Method: ' || study_type || ' ' || study_title || ' ' || study_abstract AS general, substr(study_title || ' ' || study_title || ' ' || substr(study_abstract, 1, 300) || ' Organism: ' || organism, 1, 512) AS of_study, study_title || ' ' || study_abstract AS combined FROM study")
def f20(s, d):
    o, t, title, abstract = (F.col(c) for c in ("organism", "study_type", "study_title", "study_abstract"))
    return f.study(s, d).select("study_accession", sc.embedding_text(o, t, title, abstract).alias("general"), sc.study_text(title, abstract, o).alias("of_study"), sc.combined_text(title, F.lit("NULL"), F.lit("  "), abstract).alias("combined"))


@query("f21_sample_texts", "SELECT sample_accession, substr(substr(description, 1, 200) || ' organism:' || organism || ' tissue:' || tissue || ' cell:' || cell_type, 1, 512) AS of_sample FROM sample")
def f21(s, d):
    return f.sample(s, d).select("sample_accession", sc.sample_text(F.col("description"), F.col("organism"), F.col("tissue"), F.col("cell_type")).alias("of_sample"))


@query("f23_last_hour", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def f23(s, d):
    e = table(s, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.crossJoin(F.broadcast(now)).filter(sc.within_last(F.col("ts"), F.col("now"))).select("event_id")


@query("f24_rates", "SELECT l_orderkey, round(coalesce(sum(l_extendedprice) / nullif(sum(l_quantity - 1), 0), 0), 4) AS rate FROM lineitem GROUP BY 1")
def f24(s, d):
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("a"), F.sum(F.col("l_quantity") - 1).alias("b"))
    return g.select("l_orderkey", F.round(sc.rate(F.col("a"), F.col("b")), 4).alias("rate"))


@query("f25_confidence", "SELECT event_id, CASE WHEN s > 0 THEN CASE WHEN s > 0.8 THEN 'high' WHEN s > 0.5 THEN 'medium' ELSE 'low' END WHEN value > 5 THEN 'high' WHEN value > 2 THEN 'medium' ELSE 'low' END AS label FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN (event_id % 100) / 100.0 ELSE 0 END AS s FROM events)")
def f25(s, d):
    sim = F.when(F.col("user_id") % 2 == 0, (F.col("event_id") % 100) / 100.0).otherwise(F.lit(0.0))
    return table(s, d, "events").select("event_id", sc.confidence(F.col("value"), sim).alias("label"))


@query("f26_intent", ACCS + f" SELECT acc, CASE WHEN regexp_matches(upper(acc), '^[SED]R[RSXP][0-9]+$') THEN 'accession' WHEN regexp_matches(upper(acc), '{'|'.join(schemas.TECHNICAL_TERMS)}') THEN 'technical' WHEN regexp_matches(upper(acc), '{'|'.join(schemas.STUDY_TERMS)}') THEN 'study' ELSE 'general' END AS intent FROM (SELECT acc FROM a UNION ALL SELECT study_abstract FROM study)")
def f26(s, d):
    q = _accs(s, d).union(f.study(s, d).select("study_abstract"))
    return q.select("acc", sc.intent(F.col("acc")).alias("intent"))


@query("p20_parse_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, NULL::VARCHAR AS bad FROM events")
def p20(s, d):
    text = lambda c: F.date_format(sc.parse_time(c), "yyyy-MM-dd HH:mm:ss")
    return table(s, d, "events").select("event_id", text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("iso"), text(F.date_format("ts", "yyyy-MM-dd")).alias("day"), text(F.lit("invalid_date")).alias("bad"))


# Validation.
@query("q1_document_type", "SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'EXPERIMENT' WHEN 1 THEN 'STUDY' WHEN 2 THEN 'SAMPLE' WHEN 3 THEN 'RUN' WHEN 4 THEN 'ANALYSIS' WHEN 5 THEN 'SUBMISSION' ELSE '' END AS kind FROM pages")
def q1(s, d):
    """Sets, single records, prologues and comments; pages and look-alikes are none of the six."""
    k = F.col("page_id") % 8
    doc = (
        F.when(k == 0, F.concat(F.lit('<?xml version="1.0"?>\n<EXPERIMENT_SET><EXPERIMENT><STUDY_REF accession="'), F.col("page_id").cast("string"), F.lit('"/></EXPERIMENT></EXPERIMENT_SET>')))
        .when(k == 1, F.lit('<STUDY accession="SRP000001">')).when(k == 2, F.lit("<!-- <RUN> -->\n<SAMPLE_SET>")).when(k == 3, F.lit("  <RUN/>")).when(k == 4, F.lit("<!DOCTYPE x>\n<ANALYSIS>")).when(k == 5, F.lit("<SUBMISSION alias='a'>"))
        .when(k == 6, F.concat(F.lit("<STUDYING>"), F.col("url"))).otherwise(F.col("html"))
    )
    return table(s, d, "pages").select("page_id", v.document_type(doc).alias("kind"))


@query("q2_elements", "SELECT page_id, len(regexp_extract_all(html, '<[A-Za-z]'))::INT AS elements FROM pages")
def q2(s, d):
    return table(s, d, "pages").select("page_id", v.elements(F.col("html")).alias("elements"))


REQ = "SELECT 'experiment' AS record_type, experiment_accession AS accession, 'error' AS severity, 'missing_field' AS rule, 'library_strategy' AS field, 'library_strategy is required' AS message FROM experiment WHERE library_strategy = 'P'"


def _required(s, d):
    e = f.experiment(s, d).withColumn("library_strategy", F.when(F.col("library_strategy") != "P", F.col("library_strategy")))
    return v.required(e, "experiment", "experiment_accession", ["title", "platform", "library_strategy"])


@query("q3_required_fields", REQ)
def q3(s, d):
    return _required(s, d)


@query("q4_taxon_numeric", "SELECT sample_accession FROM sample WHERE NOT regexp_matches(cell_type, '^[0-9]+$')")
def q4(s, d):
    return f.sample(s, d).filter(v.not_numeric(F.col("cell_type")) & ~v.not_numeric(F.col("taxon_id"))).select("sample_accession")


@query("q5_study_types", f"SELECT study_accession, study_type FROM study WHERE study_type <> '' AND study_type NOT IN ({quoted(schemas.STUDY_TYPES)})")
def q5(s, d):
    return f.study(s, d).filter(v.not_in(F.col("study_type"), schemas.STUDY_TYPES)).select("study_accession", "study_type")


MODELS = ", m AS (SELECT sample_accession, CASE taxon_id % 3 WHEN 0 THEN 'ILLUMINA' WHEN 1 THEN 'PACBIO_SMRT' ELSE 'UNHEARD' END AS platform, CASE taxon_id % 2 WHEN 0 THEN 'illumina miseq' ELSE 'Sequel II' END AS model FROM sample)"


@query("q6_models", MODELS + " SELECT sample_accession, platform, model FROM m WHERE platform = 'ILLUMINA' AND model <> 'illumina miseq' OR platform = 'PACBIO_SMRT' AND model <> 'Sequel II'")
def q6(s, d):
    t = F.col("taxon_id")
    m = f.sample(s, d).select("sample_accession", F.when(t % 3 == 0, "ILLUMINA").when(t % 3 == 1, "PACBIO_SMRT").otherwise("UNHEARD").alias("platform"), F.when(t % 2 == 0, "illumina miseq").otherwise("Sequel II").alias("model"))
    return v.model_mismatch(m, "platform", "model")


@query("q7_library_enumerations", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'strategy' WHEN 2 THEN 'source' WHEN 3 THEN 'selection' END AS bad FROM orders WHERE o_orderkey % 5 IN (1, 2, 3)")
def q7(s, d):
    """Good values, empty ones, and in turn a bad strategy, source and selection."""
    k = F.col("o_orderkey") % 5
    named = {"strategy": (schemas.STRATEGIES, 1), "source": (schemas.SOURCES, 2), "selection": (schemas.SELECTIONS, 3)}
    cols = {n: F.when(k == at, F.lit("no such")).when(k == 4, F.lit("")).otherwise(F.element_at(F.array(*map(F.lit, values)), (1 + F.col("o_custkey") % len(values)).cast("int"))) for n, (values, at) in named.items()}
    rows = table(s, d, "orders").select("o_orderkey", *(c.alias(n) for n, c in cols.items()))
    bad = {n: v.not_in(F.col(n), values) for n, (values, _) in named.items()}
    return rows.filter(v.any_of(*bad.values())).select("o_orderkey", F.concat_ws("+", *(F.when(c, n) for n, c in bad.items())).alias("bad"))


@query("q8_strategy_categories", f"SELECT CASE o_orderkey % 4 WHEN 0 THEN 'genomic' WHEN 1 THEN 'transcriptomic' WHEN 2 THEN 'epigenetic' ELSE 'unknown' END AS category, count(*) AS experiments FROM orders GROUP BY 1")
def q8(s, d):
    k = F.col("o_orderkey") % 4
    name = F.when(k == 0, "WGS").when(k == 1, "RNA-Seq").when(k == 2, "ATAC-seq").otherwise("none")
    return table(s, d, "orders").groupBy(v.strategy_category(name).alias("category")).agg(F.count("*").alias("experiments"))


REF = "CASE o_orderkey % 6 WHEN 0 THEN 'SRX' || lpad(o_orderkey::VARCHAR, 9, '0') WHEN 1 THEN 'ERX' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') WHEN 2 THEN 'SRP' || lpad(o_orderkey::VARCHAR, 9, '0') WHEN 3 THEN 'SRX' || (o_orderkey % 100000) WHEN 4 THEN '' END"


@query("q9_reference_format", f"SELECT o_orderkey, ref FROM (SELECT o_orderkey, {REF} AS ref FROM orders) WHERE ref <> '' AND NOT regexp_full_match(ref, '[SED]RX[0-9]{{6,9}}')")
def q9(s, d):
    """Of right references, those of another kind, short ones, empty and absent ones: what is no experiment's."""
    k = F.col("o_orderkey") % 6
    ref = F.when(k == 0, f.acc("SRX", "o_orderkey")).when(k == 1, F.concat(F.lit("ERX"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"))).when(k == 2, f.acc("SRP", "o_orderkey")).when(k == 3, F.concat(F.lit("SRX"), (F.col("o_orderkey") % 100000).cast("string"))).when(k == 4, "")
    return table(s, d, "orders").select("o_orderkey", ref.alias("ref")).filter(v.bad_reference(F.col("ref"), "experiment"))


@query("q10_referential_issues", "SELECT experiment_accession AS accession, 'orphan' AS rule FROM experiment WHERE study_accession IN (SELECT study_accession FROM study WHERE study_type = 'BUILDING')")
def q10(s, d):
    return rel.orphans(f.experiment(s, d), f.study(s, d).filter("study_type <> 'BUILDING'"), "study_accession").select(F.col("experiment_accession").alias("accession"), F.lit("orphan").alias("rule"))


@query("q11_run_files", "SELECT run_accession, center_name = 'A' AS no_name, center_name = 'R' AS odd_type FROM run")
def q11(s, d):
    files = F.array(F.struct(F.when(F.col("center_name") == "A", F.lit("")).otherwise(F.col("run_accession")).alias("filename"), F.when(F.col("center_name") == "R", F.lit("zip")).otherwise(F.lit("sra")).alias("filetype")))
    return f.run(s, d).select("run_accession", v.files_without_name(files).alias("no_name"), v.unknown_file_types(files).alias("odd_type"))


@query("q13_strict_mode", "SELECT experiment_accession FROM experiment WHERE library_strategy <> 'P'")
def q13(s, d):
    good, _ = v.split_by_errors(f.experiment(s, d), _required(s, d), "experiment_accession")
    return good.select("experiment_accession")


@query("q14_status", "SELECT experiment_accession AS accession, CASE WHEN library_strategy = 'P' THEN 1 ELSE 0 END AS errors, 0 AS warnings, CASE WHEN library_strategy = 'P' THEN 'INVALID' ELSE 'VALID' END AS status FROM experiment")
def q14(s, d):
    return v.status_of(_required(s, d), f.experiment(s, d).select(F.col("experiment_accession").alias("accession")))


# Incremental work.
@query("i4_file_log", "SELECT event_type AS batch, user_id::VARCHAR AS file, count(*) AS records, true AS order_free, bool_or(event_id % 7 = 0) AS changed FROM events GROUP BY ALL")
def i4(s, d):
    """The log of the events, beside those of the events in another order and with every seventh value changed."""
    e = table(s, d, "events").select(F.col("event_type").alias("batch"), F.col("user_id").cast("string").alias("file"), "event_id", "value")
    log = lambda rows, name: inc.file_log(rows, "file", "batch").withColumnRenamed("checksum", name)
    now, again = log(e, "now"), log(e.orderBy(F.desc("event_id")), "again").drop("records")
    other = log(e.withColumn("value", F.when(F.col("event_id") % 7 == 0, F.col("value") + 1).otherwise(F.col("value"))), "other").drop("records")
    both = now.join(again, ["batch", "file"]).join(other, ["batch", "file"])
    return both.select("batch", "file", "records", (F.col("now") == F.col("again")).alias("order_free"), (F.col("now") != F.col("other")).alias("changed"))


CHANGES = ", old AS (SELECT event_id, event_type AS h FROM events WHERE ts < TIMESTAMP '2024-01-20'), new AS (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'x' ELSE event_type END AS h FROM events WHERE ts >= TIMESTAMP '2024-01-05')"


@query("i5_changes", CHANGES + " SELECT coalesce(o.event_id, n.event_id) AS event_id, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM old o FULL JOIN new n USING (event_id) WHERE o.h IS NULL OR n.h IS NULL OR o.h <> n.h")
def i5(s, d):
    e = table(s, d, "events")
    old = e.filter("ts < timestamp'2024-01-20 00:00:00'").select("event_id", F.col("event_type").alias("hash"))
    new = e.filter("ts >= timestamp'2024-01-05 00:00:00'").select("event_id", F.when(F.col("user_id") % 5 == 0, "x").otherwise(F.col("event_type")).alias("hash"))
    return inc.changes(new, old, "event_id")


@query("i6_recent", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1 HOUR")
def i6(s, d):
    e = table(s, d, "events").withColumnRenamed("ts", "updated_at")
    return inc.recent(e, F.lit("2024-01-15 12:00:00").cast("timestamp")).select("event_id")


@query("i1_new_files", "SELECT DISTINCT user_id::VARCHAR AS file, sha256(user_id::VARCHAR) AS source_hash FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click')")
def i1(s, d):
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("file"), "event_type")
    done = inc.with_source_hash(e.filter("event_type = 'click'"))
    return inc.new_files(inc.with_source_hash(e.select("file").distinct()), done)


@query("i2_next_actions", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'done' WHEN event_type IN ('view', 'purchase') THEN 'start' ELSE 'resume' END AS action FROM events")
def i2(s, d):
    t = F.col("event_type")
    state = F.when(t == "click", "completed").when(t == "view", "failed").when(t != "purchase", "downloading")
    return table(s, d, "events").select("event_id", inc.next_action(state).alias("action"))


@query("i10_ingest_statistics", "SELECT count(*) AS files, sum(records)::BIGINT AS records, sum(bytes)::BIGINT AS bytes, round(sum(records) / sum(seconds), 4) AS records_s, round(sum(bytes) / sum(seconds), 4) AS bytes_s, round(sum(bytes) * 100 / sum(total_bytes), 4) AS percent, round((sum(total_bytes) - sum(bytes)) / (sum(bytes) / sum(seconds)), 4) AS eta_s FROM (SELECT user_id % 10 + 1 AS records, event_id AS bytes, event_id + user_id AS total_bytes, event_id % 7 + 1 AS seconds FROM events)")
def i10(s, d):
    u, e = F.col("user_id"), F.col("event_id")
    return inc.ingest_statistics(table(s, d, "events").select((u % 10 + 1).alias("records"), e.alias("bytes"), (e + u).alias("total_bytes"), (e % 7 + 1).alias("seconds")))


@query("i11_retention", "SELECT event_id AS progress_id, event_type AS state FROM events WHERE NOT (event_type IN ('click') AND ts < TIMESTAMP '2024-01-15')")
def i11(s, d):
    state = F.when(F.col("event_type") == "click", "completed").otherwise(F.col("event_type"))
    p = table(s, d, "events").select(F.col("event_id").alias("progress_id"), state.alias("state"), F.col("ts").alias("updated_at"), "event_type")
    return inc.retained(p, [], F.lit("2024-01-15 00:00:00").cast("timestamp"))[0].select("progress_id", F.col("event_type").alias("state"))


@query("i12_update_journal", ", o AS (SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02'), n AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29') SELECT count(*) FILTER (user_id NOT IN (SELECT user_id FROM o)) AS inserted, count(*) FILTER (user_id IN (SELECT user_id FROM o)) AS updated FROM n")
def i12(s, d):
    e = table(s, d, "events")
    return r.update_journal(e.filter("ts < timestamp'2024-01-02 00:00:00'"), e.filter("ts >= timestamp'2024-01-29 00:00:00'"), ["user_id"])
