"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm import bpe_codec, exact_dedup, html_text, line_dedup, lm, merkle, near_dedup, packing, prefix_trie, quality, sharding, token_counts, url_filter
from metaloom.llm.merkle_sql import crc32, manifest_sql
from metaloom.session import ship_package, table

COUNTED, MULTI = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs, public_tokenizers.path(COUNTED), limit=512).drop("text")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    path = public_tokenizers.path(MULTI)
    names = [str(i) for i in range(1 << 16)]

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(s: pd.Series) -> pd.DataFrame:
        rows = []
        for ids in bpe_codec.encode_run(s.tolist(), path):
            listed = ",".join(map(names.__getitem__, ids.tolist())) if not len(ids) or ids.max() < len(names) else ",".join(map(str, ids.tolist()))
            rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(bpe_codec.decode_ids(ids, path)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return table(spark, sf_dir, "documents").select("doc_id", digests(F.coalesce("text", F.lit(""))).alias("d")).select("doc_id", "d.*")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs under which two or more pages were fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    urls = pages.filter(url_filter.host_and_path(F.col("url"))[0] != "").select(url_filter.canonical(F.col("url")).alias("canonical_url"))
    listed = urls.groupBy("canonical_url").count().filter("count >= 2").select("canonical_url")
    return url_filter.judge_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=40)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Sketch(width=2))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNTED), capacity=1024)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, line_dedup.line_keep_bitmaps(docs, min_docs=10, min_chars=1))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands are fitted to the texts that ``labels`` calls good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.with_quality(docs, bands=quality.fit_bands(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_bad_chunks")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering: texts of every fifth id (by CRC-32) lose their capitals."""
    text = F.col("text")
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered={"text": F.when(hit, lowered).otherwise(text)})


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.with_shared_openings(prefix_trie.positions(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(turns, convs)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_bpe_codec, op3_url_filter, op4_sharding, op5_near_dedup, op6_lm_score, op7_packing, op8_line_dedup, op9_quality_rules, op10_exact_dedup, op11_merkle_manifest, op12_html_text, op13_prefix_trie, pipeline)}

_WS = r"\x20\x09-\x0D"
SQL = {
    "op11_merkle_manifest": manifest_sql(),
    "op3_url_filter": r"""
WITH p AS (
  SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) END, '') AS rest FROM pages),
q AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
e AS (
  SELECT page_id, host, path, string_split(path, '%') AS pp, string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '%') AS qq FROM q),
u AS (
  SELECT page_id, host, path, [pp[1]] || list_transform(pp[2:], lambda x: CASE WHEN NOT regexp_matches(x, '^[0-9A-Fa-f]{2}') THEN '%' || x
           WHEN regexp_matches(x, '^(3[0-9]|4[1-9A-Fa-f]|5[0-9Aa]|6[1-9A-Fa-f]|7[0-9Aa]|2[DdEe]|5[Ff]|7[Ee])') THEN chr(('0x' || x[1:2])::INT) || x[3:] ELSE '%' || upper(x[1:2]) || x[3:] END) AS pp,
         [qq[1]] || list_transform(qq[2:], lambda x: CASE WHEN NOT regexp_matches(x, '^[0-9A-Fa-f]{2}') THEN '%' || x
           WHEN regexp_matches(x, '^(3[0-9]|4[1-9A-Fa-f]|5[0-9Aa]|6[1-9A-Fa-f]|7[0-9Aa]|2[DdEe]|5[Ff]|7[Ee])') THEN chr(('0x' || x[1:2])::INT) || x[3:] ELSE '%' || upper(x[1:2]) || x[3:] END) AS qq FROM e),
k AS (
  SELECT page_id, host, path, array_to_string(pp, '') AS plain, list_sort(list_filter(string_split(array_to_string(qq, ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|msclkid|ref|ref_src)(=|$)'))) AS kept FROM u),
c AS (
  SELECT page_id, host, path, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)?$', ''), '^www\.', '')
         || regexp_replace(plain, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM k),
l AS (SELECT canonical FROM c WHERE host <> '' GROUP BY canonical HAVING count(*) >= 2),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN host <> '' AND canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END AS verdict,
       rule IS NULL AND host <> '' AND canonical IN (SELECT canonical FROM l) AS listed
FROM r""",
    "op5_near_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_WS}]+') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS items FROM w),
n AS (SELECT doc_id, len(items) AS n FROM s),
u AS (SELECT doc_id, unnest(items) AS item FROM s),
both_ AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM both_ JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x AS a, x AS b FROM edges UNION SELECT reach.a, edges.y FROM reach JOIN edges ON reach.b = edges.x),
label AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(component, n.doc_id) AS component_id, coalesce(component, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN label ON label.a = n.doc_id""",
    "op8_line_dedup": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[{_WS}]+', ''), '[{_WS}]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM f)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM f)), '')) AS kept_sha256
FROM k GROUP BY doc_id""",
    "op13_prefix_trie": rf"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, {crc32("conv_id::VARCHAR")} % 6 AS h, conv_id - conv_id % 100 AS base FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, 0 AS part, b.pos, b.role, b.text FROM c JOIN t b ON b.conv_id = c.base AND b.pos <= c.h
  UNION ALL SELECT t.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t USING (conv_id) WHERE t.pos > c.h),
s AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, sha256(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '') OVER w) AS node,
         coalesce(sha256(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), '') AS parent
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT conv_id, coalesce(max_by(node, depth), '') AS node FROM c LEFT JOIN s USING (conv_id) GROUP BY conv_id),
x AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM e GROUP BY node),
n AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM s GROUP BY node
  UNION ALL SELECT '', NULL, 0, min(conv_id), count(*), 0 FROM c HAVING count(*) > 0),
k AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n z WHERE z.parent = n.node) AS n_children FROM n LEFT JOIN n p ON p.node = n.parent),
a AS (SELECT DISTINCT s.node, u.node AS above FROM s JOIN s u ON u.conv_id = s.conv_id AND u.depth <= s.depth UNION SELECT node, '' FROM n)
SELECT above.conv_id, above.depth::BIGINT AS depth, above.parent_conv_id, above.n_convs, above.n_children, sum((k.n_children = 0)::INT)::BIGINT AS n_leaves, sum((k.n_convs - 1) * k.chars)::BIGINT AS saved_tokens,
       coalesce(any_value(x.ends_sha256), sha256('')) AS ends_sha256
FROM k above JOIN a ON a.above = above.node JOIN k ON k.node = a.node LEFT JOIN x ON x.node = above.node GROUP BY ALL""",
    "op10_exact_dedup": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[{_WS}]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER g = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)""",
}
