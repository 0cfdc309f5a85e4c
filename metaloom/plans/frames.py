"""Stand-in entity frames over the given tables, in Spark and as SQL, so that every operator can be held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.session import table


def acc(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.lpad(F.col(c).cast("string"), 9, "0"))


def study(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select("n_nationkey", "n_name")
    return (
        table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(acc("SRP", "c_custkey").alias("study_accession"), F.col("c_name").alias("study_title"), F.concat(F.col("c_mktsegment"), F.lit(" study of "), F.col("n_name")).alias("study_abstract"), F.col("c_mktsegment").alias("study_type"), F.col("n_name").alias("organism"))
    )


def experiment(s: SparkSession, d: str) -> DataFrame:
    meta = F.concat(F.lit('{"platform":"'), F.col("o_orderpriority"), F.lit('","library_strategy":"'), F.col("o_orderstatus"), F.lit('"}'))
    return table(s, d, "orders").select(
        acc("SRX", "o_orderkey").alias("experiment_accession"), acc("SRP", "o_custkey").alias("study_accession"), F.col("o_orderpriority").alias("title"), F.col("o_orderpriority").alias("platform"), F.col("o_orderstatus").alias("library_strategy"),
        F.to_date("o_orderdate").alias("submission_date"), meta.alias("metadata"),
    )


def run(s: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("-", acc("SRR", "l_orderkey"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"))
    return table(s, d, "lineitem").select(
        key.alias("run_accession"), acc("SRX", "l_orderkey").alias("experiment_accession"), F.col("l_quantity").cast("long").alias("total_spots"), F.col("l_extendedprice").cast("long").alias("total_bases"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("published"), F.col("l_returnflag").alias("center_name"),
    )


def sample(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(acc("SRS", "p_partkey").alias("sample_accession"), F.col("p_name").alias("description"), F.col("p_name").alias("scientific_name"), F.col("p_type").alias("tissue"), F.col("p_brand").alias("cell_type"), F.col("p_size").alias("taxon_id"), F.concat(F.lit("org "), F.col("p_size").cast("string")).alias("organism"))


def junction(s: SparkSession, d: str, unique: bool = True) -> DataFrame:
    """Pairs, each once unless ``unique`` is False: for what makes its results distinct itself."""
    pairs = table(s, d, "lineitem").select(acc("SRX", "l_orderkey").alias("experiment_accession"), acc("SRS", "l_partkey").alias("sample_accession"))
    return pairs.distinct() if unique else pairs


def submission(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").select(acc("SRA", "s_suppkey").alias("submission_accession"), F.col("s_name").alias("center_name"))


def pool(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    t = q.groupBy("l_suppkey").agg(F.sum("q").alias("t"))
    return q.join(t, "l_suppkey").select(acc("SRS", "l_suppkey").alias("parent_sample"), acc("SRS", "l_partkey").alias("member_sample"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("member_name"), (F.col("q") / F.col("t")).alias("proportion"))


def identifiers(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select(F.lit("sample").alias("record_type"), acc("SRS", "p_partkey").alias("record_accession"), F.lit("external").alias("id_type"), F.lit("BioSample").alias("id_namespace"), acc("SAMN", "p_partkey").alias("id_value"), F.col("p_brand").alias("id_label"))
    c = table(s, d, "customer").select(F.lit("study").alias("record_type"), acc("SRP", "c_custkey").alias("record_accession"), F.lit("external").alias("id_type"), F.lit("GEO").alias("id_namespace"), F.concat(F.lit("GSE"), F.col("c_custkey").cast("string")).alias("id_value"), F.col("c_mktsegment").alias("id_label"))
    return p.unionByName(c)


def links(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "pages").select(F.lit("study").alias("record_type"), acc("SRP", "page_id").alias("record_accession"), F.lit("url").alias("link_type"), F.lit("").alias("db"), F.lit("").alias("id"), F.lit("page").alias("label"), "url")
    x = table(s, d, "part").select(F.lit("sample").alias("record_type"), acc("SRS", "p_partkey").alias("record_accession"), F.lit("xref").alias("link_type"), F.regexp_extract("p_brand", "^([^#]*)", 1).alias("db"), F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("id"), F.lit("").alias("label"), F.lit("").alias("url"))
    return u.unionByName(x)


def pad(prefix: str, c: str) -> str:
    return f"'{prefix}' || lpad({c}::VARCHAR, 9, '0')"


CTE = {
    "study": f"SELECT {pad('SRP', 'c_custkey')} AS study_accession, c_name AS study_title, c_mktsegment || ' study of ' || n_name AS study_abstract, c_mktsegment AS study_type, n_name AS organism FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "experiment": f"""SELECT {pad("SRX", "o_orderkey")} AS experiment_accession, {pad("SRP", "o_custkey")} AS study_accession, o_orderpriority AS title, o_orderpriority AS platform, o_orderstatus AS library_strategy, o_orderdate::DATE AS submission_date, '{{"platform":"' || o_orderpriority || '","library_strategy":"' || o_orderstatus || '"}}' AS metadata FROM orders""",
    "run": f"SELECT {pad('SRR', 'l_orderkey')} || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS run_accession, {pad('SRX', 'l_orderkey')} AS experiment_accession, trunc(l_quantity)::BIGINT AS total_spots, trunc(l_extendedprice)::BIGINT AS total_bases, strftime(l_shipdate, '%Y-%m-%d') AS published, l_returnflag AS center_name FROM lineitem",
    "sample": f"SELECT {pad('SRS', 'p_partkey')} AS sample_accession, p_name AS description, p_name AS scientific_name, p_type AS tissue, p_brand AS cell_type, p_size AS taxon_id, 'org ' || p_size AS organism FROM part",
    "junction": f"SELECT DISTINCT {pad('SRX', 'l_orderkey')} AS experiment_accession, {pad('SRS', 'l_partkey')} AS sample_accession FROM lineitem",
    "submission": f"SELECT {pad('SRA', 's_suppkey')} AS submission_accession, s_name AS center_name FROM supplier",
    "pool": f"SELECT {pad('SRS', 'l_suppkey')} AS parent_sample, {pad('SRS', 'l_partkey')} AS member_sample, 'm' || l_partkey AS member_name, q / sum(q) OVER (PARTITION BY l_suppkey) AS proportion FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)",
    "identifiers": f"SELECT 'sample' AS record_type, {pad('SRS', 'p_partkey')} AS record_accession, 'external' AS id_type, 'BioSample' AS id_namespace, {pad('SAMN', 'p_partkey')} AS id_value, p_brand AS id_label FROM part UNION ALL SELECT 'study', {pad('SRP', 'c_custkey')}, 'external', 'GEO', 'GSE' || c_custkey, c_mktsegment FROM customer",
    "links": f"SELECT 'study' AS record_type, {pad('SRP', 'page_id')} AS record_accession, 'url' AS link_type, '' AS db, '' AS id, 'page' AS label, url FROM pages UNION ALL SELECT 'sample', {pad('SRS', 'p_partkey')}, 'xref', regexp_extract(p_brand, '^([^#]*)', 1), 'x' || p_partkey, '', '' FROM part",
}


def with_frames(sql: str) -> str:
    """The SQL with those frames it names put before it. ``sql`` may open with its own CTEs, written as ``, name AS (...)``."""
    import re

    used = [f"{k} AS ({v})" for k, v in CTE.items() if re.search(rf"\b{k}\b", sql)]
    body = sql.strip()
    if body.startswith(","):
        return f"WITH {', '.join(used)}{body}" if used else f"WITH {body[1:]}"
    return f"WITH {', '.join(used)} {body}" if used else body
