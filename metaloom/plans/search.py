"""Text and vector search as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom import schemas
from metaloom.functions import scalars as sc
from metaloom.operators import index as ix
from metaloom.operators import predicates as p
from metaloom.operators import text as t
from metaloom.operators import vectors as vec
from metaloom.operators.stemming import stems
from metaloom.plans import frames as f
from metaloom.plans.registry import query
from metaloom.session import new_folder, table

STOP = ", ".join(f"'{w}'" for w in t.STOP_WORDS)
TOKENS = f", tk AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS position FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents)), a AS (SELECT * FROM tk WHERE term NOT IN ({STOP}))"
WORDS = ["onanthan", "and", "thnd", "der", "los", "est"]


def _analysed(s, d):
    return t.analyse(table(s, d, "documents"), "doc_id", {"text": "standard"})


def _search(s, d, queries):
    return t.search(table(s, d, "documents"), "doc_id", {"text": "standard"}, queries)


def _query(s, words):
    return s.createDataFrame([(1, w) for w in words], "query_id int, term string")


def bm25_sql(words: list[str], extra: str = "") -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return TOKENS + f", n AS (SELECT doc_id, count(*) AS len FROM a GROUP BY 1), g AS (SELECT count(*) AS docs, avg(len) AS mean FROM n), x AS (SELECT doc_id, term, count(*) AS tf FROM a WHERE term IN ({listed}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM x GROUP BY 1), r AS (SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score, count(*) AS terms FROM x JOIN df USING (term) JOIN n USING (doc_id), g GROUP BY doc_id)" + extra


@query("t1_t3_corpora", "SELECT 'sample' AS type, sample_accession AS accession, concat_ws(' ', description, organism, scientific_name, tissue) AS body FROM sample UNION ALL SELECT 'run', run_accession, total_spots::VARCHAR || ' ' || total_bases::VARCHAR FROM run")
def t1(s, d):
    return t.sample_corpus(f.sample(s, d)).unionByName(t.run_corpus(f.run(s, d)))


@query("t4_documents", "SELECT study_accession AS id, 'study' AS type, study_title AS title, organism, NULL::VARCHAR AS platform FROM study UNION ALL SELECT experiment_accession, 'experiment', title, NULL, platform FROM experiment")
def t4(s, d):
    a = t.index_documents(f.study(s, d), "study", "study_accession", "study_title", ["organism"])
    return a.unionByName(t.index_documents(f.experiment(s, d), "experiment", "experiment_accession", "title", ["platform"]), allowMissingColumns=True)


@query("t5_analysis", TOKENS + " SELECT term, count(*) AS tokens, count(DISTINCT doc_id) AS docs, sum(position)::BIGINT AS places FROM a GROUP BY 1")
def t5(s, d):
    return t.term_totals(table(s, d, "documents"), "doc_id", {"text": "standard"})


@query("t6_stemming")
def t6(s, d):
    return t.stem(_analysed(s, d), stems).groupBy("term").agg(F.count("*").alias("tokens"))


@query("t7_bm25_top", bm25_sql(["onanthan", "thnd", "hend"], " SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 20"))
def t7(s, d):
    return t.top_hits(_search(s, d, _query(s, ["onanthan", "thnd", "hend"])), 20).select("doc_id", "score")


@query("t9_any_term", bm25_sql(["eronouen", "thstinnt", "leux", "keit"], " SELECT doc_id, score FROM r"))
def t9(s, d):
    return _search(s, d, _query(s, ["eronouen", "thstinnt", "leux", "keit"])).select("doc_id", "score")


def ranked_sql(tag: str) -> str:
    """BM25 of the queries in ``ask<tag>`` (query_id, term) over ``corpus<tag>`` (id, body), as ``r<tag>``."""
    return f", tk{tag} AS (SELECT id, unnest(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+')) AS term FROM corpus{tag}), a{tag} AS (SELECT * FROM tk{tag} WHERE term NOT IN ({STOP})), n{tag} AS (SELECT id, count(*) AS len FROM a{tag} GROUP BY 1), g{tag} AS (SELECT count(*) AS docs, avg(len) AS mean FROM n{tag}), x{tag} AS (SELECT id, term, count(*) AS tf FROM a{tag} WHERE term IN (SELECT term FROM ask{tag}) GROUP BY ALL), df{tag} AS (SELECT term, count(*) AS df FROM x{tag} GROUP BY 1), r{tag} AS (SELECT query_id, id AS doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score FROM x{tag} JOIN df{tag} USING (term) JOIN n{tag} USING (id) JOIN ask{tag} USING (term), g{tag} GROUP BY ALL)"


def terms_sql(queries: str) -> str:
    return f"SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {queries})"


BEST = " QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {k}"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank"


@query("t9_every_benchmark_item", f", corpus AS (SELECT doc_id AS id, text AS body FROM documents), asking AS (SELECT item_id AS query_id, text AS query FROM benchmark), ask AS ({terms_sql('asking')})" + ranked_sql("") + f" SELECT query_id, doc_id, score, {RANK} FROM r" + BEST.format(k=5))
def t9b(s, d):
    """Each benchmark text as a query against all documents."""
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(t.tokens(F.col("text"))).alias("term")).filter(~F.col("term").isin(t.STOP_WORDS))
    return t.top_hits(_search(s, d, q), 5)


ALL_ITEMS = f", asking AS (SELECT item_id AS query_id, text AS query FROM benchmark), ask AS ({terms_sql('asking')})" + ranked_sql("") + f" SELECT query_id, doc_id, score, {RANK} FROM r" + BEST.format(k=5)


def _items(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("t5_t9_index_blocks", ", corpus AS (SELECT doc_id AS id, text AS body FROM documents)" + ALL_ITEMS)
def t9c(s, d):
    """Documents stored as an index; of each benchmark text the first five, by blocks whose bounds allow it."""
    folder = new_folder(s, "index")
    ix.create(table(s, d, "documents"), "doc_id", {"text": "standard"}, folder, buckets=16)
    return ix.search(s, folder, _items(s, d), 5)


@query(
    "t25_i8_index_updates",
    ", corpus AS (SELECT doc_id AS id, CASE WHEN quality = 0 THEN concat_ws(' ', lang, source, text, 'thnd license') ELSE text END AS body FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) <> 1)" + ALL_ITEMS,
)
def t25b(s, d):
    """The same after changes: documents called poor get a new text, toxic ones are deleted, and what is left is made one generation."""
    docs, labels = table(s, d, "documents"), table(s, d, "labels")
    first, folder = new_folder(s, "index"), new_folder(s, "index")
    ix.create(docs, "doc_id", {"text": "standard"}, first, buckets=16)
    poor = docs.join(labels.filter("quality = 0"), "doc_id", "left_semi")
    ix.upsert(poor.withColumn("text", F.concat_ws(" ", "lang", "source", "text", F.lit("thnd license"))), first)
    ix.delete(labels.filter("toxic = 1").select("doc_id"), first)
    ix.compact(s, first, folder)
    return ix.search(s, folder, _items(s, d), 5)


@query("t10_field_terms", "SELECT experiment_accession FROM experiment WHERE lower(platform) = '1-urgent' AND lower(library_strategy) = 'o'")
def t10(s, d):
    e = f.experiment(s, d)
    return e.filter(p.must(p.field_equals(e, "tech", "1-Urgent", {"tech": "platform"}), p.field_equals(e, "library_strategy", "O"))).select("experiment_accession")


@query("t8_t11_phrase", TOKENS + " SELECT DISTINCT x.doc_id FROM tk x JOIN tk y ON x.doc_id = y.doc_id AND y.position = x.position + 1 WHERE x.term = 'of' AND y.term = 'thnd'")
def t11(s, d):
    a = t.analyse(table(s, d, "documents"), "doc_id", {"text": "standard"}, stop=False)
    return t.phrase(t.postings(a), ["of", "thnd"]).select("doc_id")


@query("t11_phrase_contains", TOKENS + " SELECT DISTINCT x.doc_id FROM tk x JOIN tk y ON x.doc_id = y.doc_id AND y.position = x.position + 1 WHERE x.term = 'of' AND y.term = 'thnd'")
def t11b(s, d):
    return table(s, d, "documents").filter(t.contains_phrase(F.col("text"), "of thnd")).select("doc_id")


@query("t12_wildcard", TOKENS + " SELECT DISTINCT doc_id, term FROM a WHERE regexp_full_match(term, 'thst.nt.*')")
def t12(s, d):
    post = t.postings(_analysed(s, d))
    return post.join(t.wildcard_terms(post, "Thst?nt*"), "term", "left_semi").select("doc_id", "term").distinct()


@query("t12_wildcard_table", TOKENS + ", v AS (SELECT DISTINCT term FROM a), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM benchmark), q AS (SELECT word[1:3] || '*' || word[-2:] AS pattern FROM w UNION SELECT '?' || word[2:] FROM w UNION SELECT '*' || word[2:4] || '??' FROM w) SELECT pattern, term FROM q JOIN v ON term LIKE replace(replace(pattern, '*', '%'), '?', '_')")
def t12b(s, d):
    """Three patterns of each word of the benchmark against all terms of the documents."""
    word = F.col("word")
    words = table(s, d, "benchmark").select(F.explode(t.tokens(F.col("text"))).alias("word")).distinct()
    each = F.array(F.concat(F.substring(word, 1, 3), F.lit("*"), F.right(word, F.lit(2))), F.concat(F.lit("?"), F.substring(word, 2, 1000)), F.concat(F.lit("*"), F.substring(word, 2, 3), F.lit("??")))
    return t.pattern_join(words.select(F.explode(each).alias("pattern")), _analysed(s, d).select("term").distinct())


@query("t13_range", "SELECT doc_id FROM documents WHERE n_chars BETWEEN 500 AND 900 AND lang BETWEEN 'de' AND 'es'")
def t13(s, d):
    return table(s, d, "documents").filter(p.must(p.in_range(F.col("n_chars"), 500, 900), p.in_range(F.col("lang"), "de", "es"))).select("doc_id")


@query("t14_boolean", "SELECT doc_id FROM documents WHERE (lang = 'en' AND n_chars > 2000 OR lang = 'fr' AND source = 'src0') AND NOT contains(lower(text), 'license')")
def t14(s, d):
    c = F.col
    either = p.should(p.must(c("lang") == "en", c("n_chars") > 2000), p.must(c("lang") == "fr", c("source") == "src0"))
    return table(s, d, "documents").filter(p.must(either, p.must_not(F.contains(F.lower("text"), F.lit("license"))))).select("doc_id")


@query("t15_filtered_search", bm25_sql(["thnd", "hend"], " SELECT doc_id, score FROM r WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src0' AND lang = 'en')"))
def t15(s, d):
    allowed = table(s, d, "documents").filter("source = 'src0' and lang = 'en'").select("doc_id")
    return _search(s, d, _query(s, ["thnd", "hend"])).join(allowed, "doc_id", "left_semi").select("doc_id", "score")


@query("t16_fuzzy", TOKENS + " SELECT DISTINCT term, damerau_levenshtein(term, 'thnad')::INT AS distance FROM a WHERE damerau_levenshtein(term, 'thnad') <= 1")
def t16(s, d):
    return t.fuzzy_terms(t.postings(_analysed(s, d)), "thnad", 1)


def _letters(word: str) -> str:
    """Capitals for letters of two bytes, as DuckDB's distance counts bytes (words are in small letters)."""
    return f"translate({word}, 'áäçèéêíñóöúüßàâëîïôùûœ', 'ABCDEFGHIJKLMNOPQRSTUV')"


@query("t16_fuzzy_table", TOKENS + f", v AS (SELECT DISTINCT term, {_letters('term')} AS t FROM a), w AS (SELECT DISTINCT word, {_letters('word')} AS w FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM benchmark)) SELECT word, term, damerau_levenshtein(w, t)::INT AS distance FROM w JOIN v ON abs(length(w) - length(t)) <= 1 WHERE damerau_levenshtein(w, t) <= 1")
def t16b(s, d):
    """All words of the benchmark against all terms of the documents."""
    words = table(s, d, "benchmark").select(F.explode(t.tokens(F.col("text"))).alias("word"))
    return t.fuzzy_join(words, _analysed(s, d).select("term").distinct(), 1)


@query("t17_fragments")
def t17b(s, d):
    """The best pieces of texts and sources; held against brute force in the tests."""
    return t.fragments(table(s, d, "documents"), "doc_id", ["text", "source"], ["license", "public", "thnd", "hend", "src0"])


@query("t17_highlight", "SELECT doc_id, CASE WHEN hit > 0 THEN regexp_replace(substr(text, greatest(1, hit - 60), 120), '(?i)\\b(license|public)\\b', '<mark>\\1</mark>', 'g') END AS fragment FROM (SELECT doc_id, text, CASE WHEN regexp_matches(text, '(?i)\\b(license|public)\\b') THEN length(regexp_extract(text, '(?is)^(.*?)\\b(license|public)\\b', 1)) + 1 ELSE 0 END AS hit FROM documents WHERE lang = 'en')")
def t17(s, d):
    return table(s, d, "documents").filter("lang = 'en'").select("doc_id", t.highlight(F.col("text"), ["license", "public"]).alias("fragment"))


@query("t18_floors", bm25_sql(["thnd", "hend"], " SELECT doc_id, score, CASE WHEN score > 5 THEN 'high' WHEN score > 2 THEN 'medium' ELSE 'low' END AS confidence FROM r WHERE score >= 1"))
def t18(s, d):
    hits = _search(s, d, _query(s, ["thnd", "hend"])).filter("score >= 1")
    return hits.select("doc_id", "score", sc.confidence(F.col("score"), F.lit(0.0)).alias("confidence"))


@query("t19_fallback", "SELECT study_accession, study_title FROM study WHERE study_abstract ILIKE '%build%'")
def t19(s, d):
    none = f.study(s, d).filter("study_title = 'nothing of the kind'").select("study_accession", "study_title")
    return t.with_fallback(none, f.study(s, d).filter(p.contains(F.col("study_abstract"), "build")).select("study_accession", "study_title"))


@query("t20_substring", "SELECT study_accession FROM study WHERE contains(lower(study_title || ' ' || study_abstract), 'machinery')")
def t20(s, d):
    return f.study(s, d).filter(F.contains(F.lower(F.concat_ws(" ", "study_title", "study_abstract")), F.lit("machinery"))).select("study_accession")


def routed_sql() -> str:
    either = "|".join
    intent = f"CASE WHEN regexp_matches(upper(query), '^[SED]R[RSXP][0-9]+$') THEN 'accession' WHEN regexp_matches(upper(query), '{either(schemas.TECHNICAL_TERMS)}') THEN 'technical' WHEN regexp_matches(upper(query), '{either(schemas.STUDY_TERMS)}') THEN 'study' ELSE 'general' END"
    everything = "SELECT 'study' AS type, study_accession AS id, study_abstract AS body, NULL AS platform, NULL AS library_strategy FROM study UNION ALL SELECT 'experiment', experiment_accession, concat_ws(' ', title, platform, library_strategy), platform, library_strategy FROM experiment UNION ALL SELECT 'document', doc_id::VARCHAR, text, NULL, NULL FROM documents"
    queries = "SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT -1 - substr(study_accession, 4)::BIGINT, study_accession FROM study"
    named = "intent = 'technical' AND contains(upper(query), '{}') AND NOT coalesce({}, false)"
    other = named.format("ILLUMINA", "platform = 'ILLUMINA'"), named.format("RNA-SEQ", "regexp_matches(lower(library_strategy), '(^|[^\\p{L}\\p{N}])rna[^\\p{L}\\p{N}]+seq($|[^\\p{L}\\p{N}])')")
    return (
        f", everything AS ({everything}), asked AS (SELECT *, {intent} AS intent FROM ({queries})), corpus1 AS (SELECT id, body FROM everything WHERE type = 'study'), ask1 AS ({terms_sql('asked WHERE intent = $$study$$')}), corpus2 AS (SELECT id, body FROM everything), ask2 AS ({terms_sql('asked WHERE intent IN ($$technical$$, $$general$$)')})"
        + ranked_sql("1") + ranked_sql("2")
        + f", hits AS (SELECT query_id, id AS doc_id, 1.0::DOUBLE AS score FROM asked JOIN everything ON upper(trim(query)) = id WHERE intent = 'accession' UNION ALL SELECT query_id, doc_id, score FROM r1 UNION ALL SELECT query_id, doc_id, score FROM r2 JOIN asked USING (query_id) JOIN everything ON id = doc_id WHERE NOT ({other[0]}) AND NOT ({other[1]})) SELECT query_id, doc_id, score, {RANK} FROM hits" + BEST.format(k=3)
    )


@query("t21_routing", routed_sql())
def t21(s, d):
    """Each benchmark text and some accessions, routed by what they are about."""
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    st = f.study(s, d)
    both = q.unionByName(st.select((-1 - F.substring("study_accession", 4, 20).cast("long")).alias("query_id"), F.col("study_accession").alias("query")))
    e = f.experiment(s, d)
    docs = (
        st.select(F.lit("study").alias("type"), F.col("study_accession").alias("id"), F.col("study_abstract").alias("body"))
        .unionByName(e.select(F.lit("experiment").alias("type"), F.col("experiment_accession").alias("id"), F.concat_ws(" ", "title", "platform", "library_strategy").alias("body"), "platform", "library_strategy"), allowMissingColumns=True)
        .unionByName(table(s, d, "documents").select(F.lit("document").alias("type"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body")), allowMissingColumns=True)
    )
    return t.routed(both, docs, "id", "body", 3)


@query("t22_admission", "SELECT doc_id, CASE WHEN length(text) >= 1000 THEN 'content' ELSE 'reference' END AS entry FROM documents")
def t22(s, d):
    return t.admitted(table(s, d, "documents"), F.col("text"), 1000).select("doc_id", "entry")


@query("t23_database_search", "SELECT experiment_accession FROM experiment WHERE (title ILIKE '%urg%' OR platform ILIKE '%urg%') AND json_extract_string(metadata, '$.library_strategy') = 'F'")
def t23(s, d):
    e = f.experiment(s, d)
    return e.filter(p.must(p.should(p.contains(F.col("title"), "urg"), p.contains(F.col("platform"), "urg")), F.get_json_object("metadata", "$.library_strategy") == "F")).select("experiment_accession")


@query("t24_shaped", "SELECT study_accession AS id, study_title AS title, study_abstract AS description FROM study")
def t24(s, d):
    st = f.study(s, d).withColumn("title0", F.lit(""))
    return t.shaped(st.withColumn("id", F.col("study_accession")), ["id", "title", "description"], ["title0", "study_title"], ["study_abstract"])


@query("t25_delete", TOKENS + " SELECT count(*) AS postings FROM (SELECT DISTINCT doc_id, term FROM a WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))")
def t25(s, d):
    gone = table(s, d, "labels").filter("toxic = 1").select("doc_id")
    return t.delete_documents(t.document_terms(table(s, d, "documents"), "doc_id", {"text": "standard"}), gone).agg(F.count("*").alias("postings"))


# Vectors.
DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
DIST = f"round(1 - {DOT} / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6)"


@query("v2_nearest", f"SELECT b.vec_id, {DIST} AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.vec_id <> 3 AND b.label = a.label ORDER BY distance, b.vec_id LIMIT 10")
def v2(s, d):
    e = table(s, d, "embeddings")
    label = e.filter("vec_id = 3").select("label").first()[0]
    return vec.similar_to(e.filter((F.col("label") == label) | (F.col("vec_id") == 3)), "embedding", "vec_id", 3, 10).select("vec_id", "distance")


@query("v3_v4_similar", f"SELECT b.vec_id, {DIST} AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 17 AND b.vec_id <> 17 ORDER BY distance, b.vec_id LIMIT 25")
def v3(s, d):
    return vec.similar_to(table(s, d, "embeddings"), "embedding", "vec_id", 17, 25).select("vec_id", "distance")


NEAREST = f", x AS (SELECT a.vec_id AS query_id, b.vec_id, {DIST} AS distance FROM embeddings a, embeddings b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM x) SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= 5"


@query("v5_batch_nearest", NEAREST)
def v5(s, d):
    e = table(s, d, "embeddings")
    return vec.batch_nearest(e, e, 5, qid="vec_id")


@query("v5_v7_coded_nearest", NEAREST)
def v5c(s, d):
    """The same by codes of a byte a dimension and bounds."""
    e = table(s, d, "embeddings")
    return vec.coded_nearest(e, e, 5, qid="vec_id")


@query("v5_indexed_nearest")
def v5i(s, d):
    """Every hundredth vector against all, through a coarse quantiser; held against the exact search in the tests."""
    e = table(s, d, "embeddings")
    return vec.indexed_nearest(e.filter("vec_id % 100 = 0"), e, 5, vec.fit_centres(e, 32), probes=20, qid="vec_id")


@query("v1_v6_norms", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm, CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS unit FROM embeddings")
def v6(s, d):
    v = F.col("embedding")
    return table(s, d, "embeddings").select("vec_id", F.round(vec.norm(v), 4).alias("norm"), F.round(vec.norm(vec.normalised(v)), 4).alias("unit"))


@query("v7_quantised", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: trunc((x::DOUBLE - lo) / (hi - lo) * 255)))::BIGINT AS total FROM (SELECT *, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)")
def v7(s, d):
    return table(s, d, "embeddings").select("vec_id", F.aggregate(vec.quantised(F.col("embedding")), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("v8_bytes", "SELECT vec_id, len(embedding) * 4 AS bytes, true AS same FROM embeddings")
def v8(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding", vec.to_bytes(F.col("embedding")).alias("b"))
    return e.select("vec_id", F.octet_length("b").cast("long").alias("bytes"), (vec.from_bytes(F.col("b")) == F.col("embedding")).alias("same"))


@query("v9_to_embed", "SELECT doc_id FROM documents WHERE lang <> 'en' OR source = 'src0'")
def v9(s, d):
    docs = table(s, d, "documents")
    stored = docs.filter("lang = 'en'").select("doc_id", F.xxhash64(F.when(F.col("source") == "src0", F.lit("old")).otherwise(F.col("text"))).alias("text_hash"))
    return vec.to_embed(docs, stored, "doc_id", "text").select("doc_id")


@query("v10_embed")
def v10(s, d):
    return vec.embed(table(s, d, "documents"), "doc_id", "text", vec.hashing_embedder(16))


@query("v11_hybrid", ", tt AS (SELECT o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_orderstatus = 'P'), vv AS (SELECT o_orderkey AS id, (o_orderkey % 97) / 97.0 AS similarity FROM orders WHERE o_orderpriority = '2-HIGH'), a AS (SELECT id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS x FROM tt), b AS (SELECT id, (similarity - min(similarity) OVER ()) / (max(similarity) OVER () - min(similarity) OVER ()) AS y FROM vv) SELECT id, round(coalesce(y, 0) * 0.7 + coalesce(x, 0) * 0.3, 6) AS score FROM a FULL JOIN b USING (id)")
def v11(s, d):
    o = table(s, d, "orders")
    a = o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    b = o.filter("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 97) / 97.0).alias("similarity"))
    return vec.hybrid(a, b, "id")
