"""Records as XML text derived from the given tables, parsed and flattened; exports read back; a stream of the events table."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.operators import ranking
from metaloom.operators import validation as v
from metaloom.plans import frames as f
from metaloom.plans.registry import query
from metaloom.session import cut, new_folder, table
from metaloom.sources import listing_source, sinks, xml
from metaloom.streaming import changes as ch
from metaloom.streaming import incremental as inc


def text(template: str, **cols: Column) -> Column:
    """The template with ``{name}`` replaced by columns; null if one is."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), cols[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def parsed(df: DataFrame, tag: str, record: Column) -> DataFrame:
    """Files of few splits are dealt over all tasks first: parsing takes much longer than reading, and one task would parse millions of records."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        df = df.repartition(max(2 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return df.select(F.from_xml(record, xml.READ_SCHEMAS[tag]).alias("r")).select("r.*")


def studies(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    t = (
        '<STUDY accession="{a}" center_name="{o}"><IDENTIFIERS><PRIMARY_ID>{a}</PRIMARY_ID><EXTERNAL_ID namespace="GEO">G{a}</EXTERNAL_ID><UUID>u{a}</UUID></IDENTIFIERS><DESCRIPTOR><STUDY_TITLE>{t}</STUDY_TITLE>'
        '<STUDY_TYPE existing_study_type="Other" new_study_type="{k}"/></DESCRIPTOR><STUDY_LINKS><STUDY_LINK><URL_LINK><LABEL>l</LABEL><URL>http://x/{a}</URL></URL_LINK></STUDY_LINK><STUDY_LINK><XREF_LINK><DB>pubmed</DB><ID>{a}</ID></XREF_LINK></STUDY_LINK></STUDY_LINKS>'
        "<STUDY_ATTRIBUTES><STUDY_ATTRIBUTE><TAG>organism</TAG><VALUE>human</VALUE></STUDY_ATTRIBUTE><STUDY_ATTRIBUTE><TAG>ENA-FIRST-PUBLIC</TAG><VALUE>2024-01-15</VALUE></STUDY_ATTRIBUTE></STUDY_ATTRIBUTES></STUDY>"
    )
    return parsed(f.study(s, d), "STUDY", text(t, a=c("study_accession"), o=c("organism"), t=c("study_title"), k=c("study_type")))


@query("s4_e1_studies", "SELECT study_accession, study_title, study_type, organism AS center_name, 'Homo sapiens' AS organism, '2024-01-15' AS first_public, 2::BIGINT AS links, 'G' || study_accession AS external FROM study")
def e1(s, d):
    out = xml.studies(studies(s, d))
    return out.select("study_accession", "study_title", "study_type", "center_name", "organism", F.date_format("first_public", "yyyy-MM-dd").alias("first_public"), F.size("study_links").cast("long").alias("links"), F.col("external_ids")[0]["value"].alias("external"))


@query("e19_identifier_rows", "SELECT study_accession AS record_accession, 'primary' AS id_type, study_accession AS id_value FROM study UNION ALL SELECT study_accession, 'external', 'G' || study_accession FROM study UNION ALL SELECT study_accession, 'uuid', 'u' || study_accession FROM study")
def e19(s, d):
    return xml.identifier_rows(studies(s, d), "study").select("record_accession", "id_type", "id_value")


@query("e20_link_rows", "SELECT study_accession AS record_accession, 'url' AS link_type, 'http://x/' || study_accession AS target FROM study UNION ALL SELECT study_accession, 'xref', study_accession FROM study")
def e20(s, d):
    return xml.link_rows(studies(s, d), "study", "STUDY_LINKS.STUDY_LINK").select("record_accession", "link_type", F.coalesce("url", "id").alias("target"))


def experiments(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    o = table(s, d, "orders")
    single = c("o_orderkey") % 2 == 0
    lay = F.when(single, "<SINGLE/>").otherwise('<PAIRED NOMINAL_LENGTH="300" NOMINAL_SDEV="2.5"/>')
    plat = F.when(c("o_orderkey") % 3 == 0, "ILLUMINA").when(c("o_orderkey") % 3 == 1, "LS454").otherwise("ELEMENT")
    pool = F.when(single, F.lit("")).otherwise(text('<POOL><DEFAULT_MEMBER accession="D{k}" proportion="0.25"/><MEMBER accession="M{k}" member_name="m" proportion="0.75"><READ_LABEL>r1</READ_LABEL><READ_LABEL>r2</READ_LABEL></MEMBER></POOL>', k=c("o_orderkey")))
    t = (
        '<EXPERIMENT accession="{a}"><TITLE>{t}</TITLE><STUDY_REF accession="{st}"/><DESIGN><SAMPLE_DESCRIPTOR accession="S{k}">{pool}</SAMPLE_DESCRIPTOR><LIBRARY_DESCRIPTOR><LIBRARY_STRATEGY>{y}</LIBRARY_STRATEGY><LIBRARY_LAYOUT>{lay}</LIBRARY_LAYOUT>'
        '<TARGETED_LOCI><LOCUS locus_name="16S rRNA"/></TARGETED_LOCI></LIBRARY_DESCRIPTOR><SPOT_DESCRIPTOR><SPOT_DECODE_SPEC><SPOT_LENGTH>100</SPOT_LENGTH><READ_SPEC><READ_INDEX>0</READ_INDEX><READ_LENGTH>0</READ_LENGTH></READ_SPEC></SPOT_DECODE_SPEC></SPOT_DESCRIPTOR></DESIGN>'
        "<PLATFORM><{p}><INSTRUMENT_MODEL>model {k}</INSTRUMENT_MODEL></{p}></PLATFORM></EXPERIMENT>"
    )
    return parsed(o, "EXPERIMENT", text(t, a=f.acc("SRX", "o_orderkey"), t=c("o_orderpriority"), st=f.acc("SRP", "o_custkey"), k=c("o_orderkey"), pool=pool, y=c("o_orderstatus"), lay=lay, p=plat))


@query("s3_e3_experiments", f"SELECT {f.pad('SRX', 'o_orderkey')} AS experiment_accession, {f.pad('SRP', 'o_custkey')} AS study_accession, o_orderstatus AS library_strategy, CASE o_orderkey % 2 WHEN 0 THEN 'SINGLE' ELSE 'PAIRED' END AS library_layout, CASE o_orderkey % 2 WHEN 1 THEN 300 END AS nominal_length, CASE o_orderkey % 3 WHEN 0 THEN 'ILLUMINA' WHEN 1 THEN 'LS454' ELSE 'ELEMENT' END AS platform, 'model ' || o_orderkey AS instrument_model, CASE o_orderkey % 2 WHEN 1 THEN 2 ELSE 0 END AS pool_member_count, NULL::INT AS read_length, '16S rRNA' AS locus FROM orders")
def e3(s, d):
    out = xml.experiments(experiments(s, d))
    return out.select("experiment_accession", "study_accession", "library_strategy", "library_layout", "nominal_length", "platform", "instrument_model", "pool_member_count", F.col("spot_decode_spec.read_specs")[0]["read_length"].alias("read_length"), F.col("targeted_loci")[0]["name"].alias("locus"))


@query("e21_pool_rows", "SELECT 'S' || o_orderkey AS parent_sample, 'D' || o_orderkey AS member_sample, 0.25::DOUBLE AS proportion, NULL::VARCHAR AS read_label FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 'S' || o_orderkey, 'M' || o_orderkey, 0.75, 'r1' FROM orders WHERE o_orderkey % 2 = 1")
def e21(s, d):
    return xml.pool_rows(experiments(s, d)).select("parent_sample", "member_sample", "proportion", "read_label")


@query("e22_junction_rows", f"SELECT {f.pad('SRX', 'o_orderkey')} AS experiment_accession, 'S' || o_orderkey AS sample_accession FROM orders UNION ALL SELECT {f.pad('SRX', 'o_orderkey')}, 'M' || o_orderkey FROM orders WHERE o_orderkey % 2 = 1")
def e22(s, d):
    return xml.junction_rows(experiments(s, d))


def samples(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    t = (
        '<SAMPLE accession="{a}"><SAMPLE_NAME><TAXON_ID>{x}</TAXON_ID><SCIENTIFIC_NAME>{n}</SCIENTIFIC_NAME></SAMPLE_NAME><DESCRIPTION>{n}</DESCRIPTION><SAMPLE_ATTRIBUTES><SAMPLE_ATTRIBUTE><TAG>Tissue</TAG><VALUE>first</VALUE></SAMPLE_ATTRIBUTE><SAMPLE_ATTRIBUTE><TAG>TISSUE</TAG><VALUE>{t}</VALUE></SAMPLE_ATTRIBUTE>'
        "<SAMPLE_ATTRIBUTE><TAG>gender</TAG><VALUE>female</VALUE></SAMPLE_ATTRIBUTE><SAMPLE_ATTRIBUTE><TAG>age</TAG><VALUE>{x}</VALUE><UNITS>years</UNITS></SAMPLE_ATTRIBUTE><SAMPLE_ATTRIBUTE><TAG>barcode</TAG><VALUE>AC{x}</VALUE></SAMPLE_ATTRIBUTE></SAMPLE_ATTRIBUTES></SAMPLE>"
    )
    return parsed(table(s, d, "part"), "SAMPLE", text(t, a=f.acc("SRS", "p_partkey"), x=c("p_size"), n=c("p_name"), t=c("p_type")))


@query("s5_e9_e10_samples", f"SELECT {f.pad('SRS', 'p_partkey')} AS sample_accession, p_size AS taxon_id, p_type AS tissue, 'female' AS sex, p_size || ' years' AS age, p_name AS scientific_name, NULL::VARCHAR AS disease FROM part")
def e9(s, d):
    return xml.samples(samples(s, d)).select("sample_accession", "taxon_id", "tissue", "sex", "age", "scientific_name", "disease")


@query("e25_e26_attributes", "SELECT 'AC' || p_size AS barcode, 'first' AS tissue, '' AS missing, count(*) AS n FROM part GROUP BY ALL")
def e25(s, d):
    a = samples(s, d).select(xml.attributes(F.col("SAMPLE_ATTRIBUTES.SAMPLE_ATTRIBUTE")).alias("a"))
    out = a.select(xml.barcodes(F.col("a"))["barcode"].alias("barcode"), xml.first_value(F.col("a"), "Tissue").alias("tissue"), xml.first_value(F.col("a"), "none").alias("missing"))
    return out.groupBy("barcode", "tissue", "missing").agg(F.count("*").alias("n"))


@query("e11_exact_tags", f"SELECT {f.pad('SRS', 'p_partkey')} AS sample_accession, p_type AS tissue, '' AS lower_tissue, 'female' AS sex, p_size::VARCHAR AS age FROM part")
def e11(s, d):
    """Tags in the case that they are asked for; the first of several."""
    a = xml.attributes(F.col("SAMPLE_ATTRIBUTES.SAMPLE_ATTRIBUTE"))
    return samples(s, d).select(F.col("_accession").alias("sample_accession"), xml.first_value(a, "TISSUE").alias("tissue"), xml.first_value(a, "tissue").alias("lower_tissue"), xml.first_value(a, "gender").alias("sex"), xml.first_value(a, "age").alias("age"))


@query("e18_identifiers", "SELECT study_accession, study_accession AS primary_id, 'GEO' AS namespace, 'G' || study_accession AS value, 0 AS submitter_ids FROM study")
def e18(s, d):
    i = studies(s, d).select(F.col("_accession").alias("study_accession"), xml.identifiers(F.col("IDENTIFIERS")).alias("i"))
    none = F.coalesce(F.size("i.submitter_ids"), F.lit(0))
    return i.select("study_accession", "i.primary_id", F.col("i.external_ids")[0]["namespace"].alias("namespace"), F.col("i.external_ids")[0]["value"].alias("value"), F.when(none > 0, none).otherwise(0).alias("submitter_ids"))


def runs(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    stats = F.when(c("l_linenumber") == 1, F.lit("")).otherwise(text('<Statistics total_spots="{q}" total_bases="{b}"/>', q=c("l_quantity").cast("long"), b=c("l_extendedprice").cast("long")))
    t = (
        '<RUN accession="{a}" run_date="{day}" spots="7"><EXPERIMENT_REF accession="{e}"/>{stats}<DATA_BLOCK><FILES><FILE filename="{a}.bam" filetype="bam"/></FILES></DATA_BLOCK>'
        "<RUN_ATTRIBUTES><RUN_ATTRIBUTE><TAG>quality_score_mean</TAG><VALUE>{n}.5</VALUE></RUN_ATTRIBUTE><RUN_ATTRIBUTE><TAG>read_count_r1</TAG><VALUE>many</VALUE></RUN_ATTRIBUTE></RUN_ATTRIBUTES></RUN>"
    )
    key = F.concat_ws("-", f.acc("SRR", "l_orderkey"), c("l_partkey").cast("string"), c("l_suppkey").cast("string"), c("l_linenumber").cast("string"))
    return parsed(table(s, d, "lineitem"), "RUN", text(t, a=key, day=F.date_format("l_shipdate", "yyyy-MM-dd"), e=f.acc("SRX", "l_orderkey"), stats=stats, n=c("l_linenumber")))


@query("s6_e12_e13_e28_runs", f"SELECT {f.pad('SRR', 'l_orderkey')} || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS run_accession, strftime(l_shipdate, '%Y-%m-%d') AS run_date, CASE WHEN l_linenumber = 1 THEN 7 ELSE trunc(l_quantity)::BIGINT END AS total_spots, CASE WHEN l_linenumber = 1 THEN 0 ELSE trunc(l_extendedprice)::BIGINT END AS total_bases, l_linenumber + 0.5::DOUBLE AS quality_score_mean, NULL::BIGINT AS read_count_r1, 'bam' AS filetype FROM lineitem")
def e12(s, d):
    out = xml.runs(runs(s, d))
    return out.select("run_accession", F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "total_spots", "total_bases", "quality_score_mean", "read_count_r1", F.col("data_files")[0]["filetype"].alias("filetype"))


@query("e13_numeric_attributes", "SELECT 'E' || event_id AS run_accession, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS mean, CASE WHEN event_id % 3 = 0 THEN user_id END::BIGINT AS reads FROM events")
def e13(s, d):
    """Numbers and words as values of two attributes of runs."""
    t = '<RUN accession="E{a}"><RUN_ATTRIBUTES><RUN_ATTRIBUTE><TAG>quality_score_mean</TAG><VALUE>{m}</VALUE></RUN_ATTRIBUTE><RUN_ATTRIBUTE><TAG>read_count_r1</TAG><VALUE>{n}</VALUE></RUN_ATTRIBUTE></RUN_ATTRIBUTES></RUN>'
    mean, reads = F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")), F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).otherwise(F.col("event_type"))
    out = xml.runs(parsed(table(s, d, "events"), "RUN", text(t, a=F.col("event_id"), m=mean, n=reads)))
    return out.select("run_accession", F.col("quality_score_mean").alias("mean"), F.col("read_count_r1").alias("reads"))


def analyses(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("s_suppkey") % 2 == 0, F.lit('<REFERENCE_ALIGNMENT><ASSEMBLY><STANDARD short_name="GRCh38"/></ASSEMBLY><PROCESSING><PIPELINE><PIPE_SECTION><PROGRAM>bwa</PROGRAM><VERSION>1</VERSION></PIPE_SECTION></PIPELINE></PROCESSING></REFERENCE_ALIGNMENT>')).otherwise("<DE_NOVO_ASSEMBLY/>")
    t = '<ANALYSIS accession="{a}"><TITLE>{n}</TITLE><ANALYSIS_TYPE>{k}</ANALYSIS_TYPE><TARGETS><TARGET accession="T{a}"/><TARGET accession=""/></TARGETS></ANALYSIS>'
    return parsed(table(s, d, "supplier"), "ANALYSIS", text(t, a=f.acc("SRZ", "s_suppkey"), n=F.col("s_name"), k=kind))


@query("s7_e14_e27_analyses", f"SELECT {f.pad('SRZ', 's_suppkey')} AS analysis_accession, s_name AS title, CASE s_suppkey % 2 WHEN 0 THEN 'REFERENCE_ALIGNMENT' ELSE 'DE_NOVO_ASSEMBLY' END AS analysis_type, CASE s_suppkey % 2 WHEN 0 THEN 'GRCh38' END AS ref_name, CASE s_suppkey % 2 WHEN 0 THEN 'bwa' END AS pipeline_name, 'T' || {f.pad('SRZ', 's_suppkey')} AS targets FROM supplier")
def e14(s, d):
    out = xml.analyses(analyses(s, d))
    return out.select("analysis_accession", "title", "analysis_type", F.col("assembly_ref.ref_name").alias("ref_name"), F.col("processing.pipeline_name").alias("pipeline_name"), F.array_join("target_accessions", ";").alias("targets"))


def submissions(s: SparkSession, d: str) -> DataFrame:
    t = '<SUBMISSION accession="{a}" submission_date="2024-01-15T10:30:00Z"><CONTACTS><CONTACT name="{n}"/></CONTACTS><ACTIONS><ACTION><ADD source="{a}.xml" schema="study"/></ACTION><ACTION><HOLD target="{a}" HoldUntilDate="2025-01-01"/></ACTION><ACTION><RELEASE/></ACTION></ACTIONS></SUBMISSION>'
    return parsed(table(s, d, "supplier"), "SUBMISSION", text(t, a=f.acc("SRA", "s_suppkey"), n=F.col("s_name")))


@query("s8_e15_q12_submissions", f"SELECT {f.pad('SRA', 's_suppkey')} AS submission_accession, s_name AS contact, 'ADD;HOLD;RELEASE' AS actions, {f.pad('SRA', 's_suppkey')} || '.xml' AS source, '2025-01-01' AS hold_until FROM supplier")
def e15(s, d):
    out = xml.submissions(submissions(s, d))
    a = F.col("actions")
    return out.select("submission_accession", F.col("contacts")[0]["name"].alias("contact"), F.array_join(F.transform(a, lambda x: x["action_type"]), ";").alias("actions"), a[0]["source"].alias("source"), a[1]["hold_until_date"].alias("hold_until"))


@query("s2_routing", "SELECT event_id, CASE event_type WHEN 'click' THEN 'EXPERIMENT' WHEN 'view' THEN 'RUN' END AS kind FROM events")
def s2(s, d):
    name = F.when(F.col("event_type") == "click", "My_Experiment_study.xml").when(F.col("event_type") == "view", "a/run.XML").otherwise("study.txt")
    return table(s, d, "events").select("event_id", xml.route(name).alias("kind"))


@query("q3_required_in_xml", f"SELECT {f.pad('SRA', 's_suppkey')} AS accession, count(*) AS issues FROM supplier, (SELECT unnest(range(3))) GROUP BY 1")
def q3x(s, d):
    docs = table(s, d, "supplier").select(f.acc("SRA", "s_suppkey").alias("doc_id"), text('<EXPERIMENT_SET><EXPERIMENT accession="{k}"><STUDY_REF accession="x"/><PLATFORM/></EXPERIMENT></EXPERIMENT_SET>', k=F.col("s_suppkey")).alias("xml"))
    return v.required_in_xml(docs).groupBy("accession").agg(F.count("*").alias("issues"))


# Exports, written and read back.
def _scratch(s: SparkSession) -> str:
    return new_folder(s, "files")


RESULTS = "SELECT study_accession AS id, 'study' AS type, study_title AS title, study_abstract AS description, organism, study_type AS platform, 'x' AS library_strategy FROM study"


def _results(s: SparkSession, d: str) -> DataFrame:
    return f.study(s, d).select(F.col("study_accession").alias("id"), F.lit("study").alias("type"), F.col("study_title").alias("title"), F.col("study_abstract").alias("description"), "organism", F.col("study_type").alias("platform"), F.lit("x").alias("library_strategy"))


@query("k3_k4_k10_json", RESULTS)
def k3(s, d):
    sinks.write_json(_results(s, d), path := _scratch(s), sinks.RESULT_FIELDS, "gzip")
    return s.read.schema(", ".join(f"{c} string" for c in sinks.RESULT_FIELDS)).json(path)


@query("k5_csv", RESULTS)
def k5(s, d):
    sinks.write_csv(_results(s, d), path := _scratch(s))
    return s.read.option("header", True).csv(path)


@query("k6_tsv", RESULTS)
def k6(s, d):
    sinks.write_tsv(_results(s, d), path := _scratch(s))
    return s.read.option("header", True).option("sep", "\t").csv(path)


@query("k7_xml", "SELECT study_accession AS id, 'study' AS type, study_title AS title FROM study")
def k7(s, d):
    sinks.write_xml(_results(s, d).withColumn("score", F.lit(1.5)), path := _scratch(s))
    back = s.read.format("xml").option("rowTag", "result").schema("_id STRING, _type STRING, data STRUCT<title: STRING>").load(path)
    return back.select(F.col("_id").alias("id"), F.col("_type").alias("type"), "data.title")


@query("k8_accessions", "SELECT study_accession AS value FROM study")
def k8(s, d):
    sinks.write_accessions(_results(s, d), path := _scratch(s))
    return s.read.text(path)


@query("k11_bundle", "SELECT 'sample' AS table_name, count(*) AS n FROM sample UNION ALL SELECT 'study', count(*) FROM study UNION ALL SELECT 'col_desc', 12 UNION ALL SELECT 'metaInfo', 2")
def k11(s, d):
    sinks.write_bundle({"study": f.study(s, d), "sample": f.sample(s, d)}, path := _scratch(s))
    out = None
    for name in ("study", "sample", "col_desc", "metaInfo"):
        part = s.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("w2_sra_ids", "SELECT row_number() OVER (ORDER BY run_accession) AS sra_id, run_accession, platform FROM run JOIN experiment USING (experiment_accession)")
def w2(s, d):
    return ranking.dense_ids(f.run(s, d).join(f.experiment(s, d).select("experiment_accession", "platform"), "experiment_accession").select("run_accession", "platform"), ["run_accession"], "sra_id")


# Archives: the studies as members of gzipped archives, in sets and alone; some with comments, CDATA and prefixes, some broken.
def _archives(s: SparkSession, d: str, folder: str) -> DataFrame:
    """Files of up to 10,000 studies for each eighth of them, written where Spark runs the groups; one file for the eighth that is no archive."""
    k = F.col("k")
    comment = F.when(k % 4 == 0, "<!-- </STUDY> <STUDY> -->").otherwise("")
    title = F.when(k % 3 == 0, F.concat(F.lit("<![CDATA["), F.col("study_title"), F.lit("]]>"))).otherwise(F.col("study_title"))
    name = F.when(k % 5 == 1, "s:STUDY").otherwise("STUDY")
    end = F.when(k % 10 == 9, "").otherwise("</STUDY_TITLE>")  # a record that does not parse
    one = F.concat(F.lit("<"), name, F.lit(' alias="a > b" accession="'), F.col("study_accession"), F.lit('">'), comment, F.lit("<DESCRIPTOR><STUDY_TITLE>"), title, end, F.lit("</DESCRIPTOR>"), F.when(k % 10 == 7, "").otherwise(F.concat(F.lit("</"), name, F.lit(">"))))
    alone = F.lit('<STUDY accession="SRP0"/>')
    whole = F.when(k % 2 == 0, F.concat(F.lit("<STUDY_SET>\n"), one, F.lit("\n</STUDY_SET>"))).when(k % 10 == 7, F.concat(F.lit("<STUDY_SET>"), one, alone, F.lit("</STUDY_SET>"))).otherwise(one)
    rows = f.study(s, d).withColumn("k", F.substring("study_accession", 4, 20).cast("long")).select((F.col("k") % 8).alias("part"), F.floor(F.col("k") / 80_000).alias("n"), F.concat("study_accession", F.lit(".study.xml")).alias("name"), whole.alias("xml"))
    rows = rows.filter("part <> 5").unionByName(rows.filter("part = 5").limit(1))  # nothing of the others would be written

    def write(part: pd.DataFrame) -> pd.DataFrame:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"{path}/part-{part['part'].iloc[0]}-{part['n'].iloc[0]}.tar.gz"
        with fs.open_output_stream(name, compression=None) as out:
            if part["part"].iloc[0] == 5:  # not an archive
                out.write(b"not gzip data")
            else:
                with tarfile.open(fileobj=out, mode="w|gz", compresslevel=1) as tar:
                    for n, x in zip(part["name"], part["xml"], strict=True):
                        info = tarfile.TarInfo(n)
                        info.size = len(x.encode())
                        tar.addfile(info, io.BytesIO(x.encode()))
        return pd.DataFrame({"file": [name], "members": [len(part)]})

    files = 8 * (1 + table(s, d, "customer").count() // 80_000)  # by number: small tasks given by a key alone would be put together
    return rows.repartition(files, "part", "n").groupBy("part", "n").applyInPandas(write, "file string, members long")


@query(
    "s1_s9_s10_archives",
    "SELECT what, title, count(*) AS members FROM (SELECT CASE WHEN k % 10 = 9 THEN 'does not parse' WHEN k % 10 = 7 THEN 'not closed' ELSE 'record' END AS what, CASE WHEN k % 10 NOT IN (7, 9) THEN study_title END AS title FROM (SELECT *, substr(study_accession, 4)::BIGINT AS k FROM study) WHERE k % 8 <> 5 UNION ALL SELECT 'record', NULL FROM (SELECT substr(study_accession, 4)::BIGINT AS k FROM study) WHERE k % 10 = 7 AND k % 8 <> 5) GROUP BY 1, 2 UNION ALL SELECT 'unreadable archive', NULL, 1 FROM (SELECT 1 FROM study WHERE substr(study_accession, 4)::BIGINT % 8 = 5 LIMIT 1)",
)
def s1(s, d):
    """What the archives give: records by title, broken records, archives that don't open."""
    folder = new_folder(s, "archives")
    cut(_archives(s, d, folder))
    members = cut(xml.archive_members(s, folder + "/*.tar.gz"))
    found = xml.parsed(members, "STUDY").select(F.coalesce("error", F.lit("record")).alias("what"), F.when(F.col("error").isNull(), F.col("r.DESCRIPTOR.STUDY_TITLE")).alias("title"))
    bad = members.filter("error is not null").select(F.lit("unreadable archive").alias("what"), F.lit(None).cast("string").alias("title"))
    return found.unionByName(bad).groupBy("what", "title").agg(F.count("*").alias("members"))


# Streams.
@query("i7_i9_stream_upsert", ", n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type FROM n WHERE k = 1")
def i9(s, d):
    """The events table as a stream of files, each row written over its user's last; the table as of its newest version."""
    folder = _scratch(s)
    stream = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/[e]vents.parquet")  # a pattern: a stream's plain path must be a folder
    stream = stream.select("user_id", "event_id", "event_type")
    inc.upsert_stream(stream, f"{folder}/table", ["user_id"], "event_id", f"{folder}/offsets").awaitTermination()
    return inc.latest_version(s, f"{folder}/table", ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query(
    "i5_i9_change_log",
    ", v AS (SELECT user_id AS key, event_id AS seq, event_type AS hash, event_type = 'error' AS gone, lag(event_type) OVER w AS was, lag(event_type <> 'error') OVER w AS was_there FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), c AS (SELECT key, seq, CASE WHEN gone THEN CASE WHEN was_there THEN 'deleted' END WHEN NOT coalesce(was_there, false) THEN 'new' WHEN hash <> was THEN 'changed' END AS change FROM v) SELECT * FROM c WHERE change IS NOT NULL",
)
def i5_log(s, d):
    """Each user's events as versions of a row, from state kept in a stream; an error takes the row away."""
    folder = _scratch(s)
    stream = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/[e]vents.parquet")
    versions = stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("hash"), (F.col("event_type") == "error").alias("gone"))
    ch.write_changes(ch.changed_rows(versions), f"{folder}/log", f"{folder}/offsets").awaitTermination()
    return ch.read_changes(s, f"{folder}/log")


@query(
    "i1_s13_listing_stream",
    "SELECT DISTINCT 'Meta_' || strftime(o_orderdate, '%Y%m%d') || '.tar.gz' AS name, o_orderdate::DATE AS date, 'daily' AS kind, (1 + month(o_orderdate))::BIGINT * 1048576 AS size FROM orders UNION SELECT 'Meta_Full_' || strftime(o_orderdate, '%Y%m%d') || '.tar.gz', o_orderdate::DATE, 'monthly', 3::BIGINT * 1073741824 FROM orders WHERE day(o_orderdate) = 1",
)
def i1_stream(s, d):
    """A listing that names a daily archive for each day with orders and a monthly one for first days, read as a stream by the listing source."""
    folder = _scratch(s)
    day = F.date_format("o_orderdate", "yyyyMMdd")
    line = lambda name, size: F.concat(F.lit('<a href="'), name, F.lit('">x</a>  2024-01-01 10:00  '), size)
    days = table(s, d, "orders").select("o_orderdate").distinct()
    daily = days.select(line(F.concat(F.lit("Meta_"), day, F.lit(".tar.gz")), F.concat((1 + F.month("o_orderdate")).cast("string"), F.lit("M"))).alias("value"))
    monthly = days.filter(F.dayofmonth("o_orderdate") == 1).select(line(F.concat(F.lit("Meta_Full_"), day, F.lit(".tar.gz")), F.lit("3G")).alias("value"))
    daily.unionByName(monthly).coalesce(1).write.text(f"{folder}/page")  # a line a day
    page = s.read.format("binaryFile").load(f"{folder}/page").filter("length > 0").select("path").first()[0]
    listing_source.register(s)
    stream = s.readStream.format("archive_listing").option("page", page).option("log", f"{folder}/seen").load()
    stream.writeStream.format("parquet").option("path", f"{folder}/files").option("checkpointLocation", f"{folder}/offsets").trigger(once=True).start().awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{folder}/files")
