"""Accessions, names, labels, dates, hashes and texts for embedding, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaloom import schemas


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def record_type(acc: Column) -> Column:
    """Record type by the three-letter prefix, in any case; else ``unknown``."""
    head = F.upper(F.substring(acc, 1, 3))
    out = F.lit("unknown")
    for name, prefixes in schemas.RECORD_TYPES.items():
        out = F.when(head.isin(prefixes), name).otherwise(out)
    return out


def id_system(acc: Column) -> Column:
    """Identifier system: the longest known prefix; ``''`` if none."""
    return F.regexp_extract(F.upper(F.trim(acc)), "^(" + "|".join(sorted(schemas.ID_SYSTEMS, key=len, reverse=True)) + ")", 1)


def is_accession(acc: Column, kind: str) -> Column:
    return acc.rlike("^(" + "|".join(schemas.RECORD_TYPES[kind]) + r")\d{6,9}$")


def normalised_accession(acc: Column) -> Column:
    return F.upper(F.trim(acc))


def organism(name: Column) -> Column:
    """Common names to scientific ones; else ``Genus species`` with single spaces."""
    clean = F.trim(F.regexp_replace(name, r"\s+", " "))
    words = F.split(clean, " ")
    cased = F.concat_ws(" ", F.initcap(F.get(words, F.lit(0))), F.lower(F.nullif(F.array_join(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), " "), F.lit(""))))
    return F.coalesce(F.element_at(_map(schemas.ORGANISMS), F.lower(F.trim(name))), F.when(clean == "", name).otherwise(cased))


def strategy(name: Column) -> Column:
    return F.coalesce(F.element_at(_map(schemas.STRATEGY_SPELLINGS), F.lower(F.trim(name))), name)


def concat_or_null(*cols: Column) -> Column:
    """Concatenation that is null if any side is."""
    return F.concat(*cols)


def json_field(c: Column, field: str) -> Column:
    return F.get_json_object(c, f"$.{field}")


def json_pairs(c: Column, sep: str = "; ") -> Column:
    """A JSON array of flat objects as ``k=v`` in key order; anything else gives ``''``."""
    rows = F.from_json(c, "array<map<string,string>>")
    pairs = F.flatten(F.transform(rows, lambda m: F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))))
    return F.coalesce(F.array_join(pairs, sep), F.lit(""))


def json_list(c: Column, sep: str = "; ") -> Column:
    return F.coalesce(F.array_join(F.from_json(c, "array<string>"), sep), F.lit(""))


def attribute_string(pairs: dict[str, Column]) -> Column:
    """``k=v`` joined by bars, blanks left out."""
    return F.concat_ws("|", *(F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}="), v)) for k, v in pairs.items()))


def record_url(acc: Column) -> Column:
    return F.concat(F.lit("https://www.ncbi.nlm.nih.gov/sra/"), acc)


def search_url(acc: Column) -> Column:
    return F.concat(F.lit("https://www.ncbi.nlm.nih.gov/sra/?term="), acc)


def file_url(acc: Column, source: str, kind: str = "sra") -> Column:
    """Place of a run's data file; null where a source has no such file."""
    p3, p6 = F.substring(acc, 1, 3), F.substring(acc, 1, 6)
    if source == "ftp" and kind == "fastq":
        sub = F.when(F.length(acc) > 9, F.concat(F.lit("00"), F.substring(acc, -1, 1), F.lit("/"))).otherwise("")
        return F.when(acc.startswith("SRR"), F.concat(F.lit("ftp://ftp.sra.ebi.ac.uk/vol1/fastq/"), p6, F.lit("/"), sub, acc, F.lit("/"), acc, F.lit(".fastq.gz")))
    if source == "ftp":
        return F.concat(F.lit("ftp://ftp-trace.ncbi.nlm.nih.gov/sra/sra-instant/reads/ByRun/sra/"), p3, F.lit("/"), p6, F.lit("/"), acc, F.lit("/"), acc, F.lit(".sra"))
    if source == "aws":
        return F.concat(F.lit("https://sra-pub-run-odp.s3.amazonaws.com/sra/"), acc, F.lit("/"), acc, F.lit(".fastq.gz" if kind == "fastq" else ""))
    if source == "gcp":
        return F.concat(F.lit("https://storage.googleapis.com/sra-pub-run-1/"), acc, F.lit("/"), acc, F.lit(".1")) if kind == "sra" else F.lit(None).cast("string")
    if source == "ncbi":
        return F.concat(F.lit("https://sra-downloadb.be-md.ncbi.nlm.nih.gov/sos2/sra-pub-run-11/"), acc, F.lit("/"), acc, F.lit(".1"))
    raise ValueError(f"unknown source {source}")


def time_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def null_if_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def null_if_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0).cast("long"))


def ellipsis(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def text_hash(c: Column) -> Column:
    """``h = h * 31 + code`` over the characters modulo 2**32, in hexadecimal."""
    step = lambda h, x: (h * 31 + F.ascii(x)) % F.lit(1 << 32)
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.lower(F.hex(F.aggregate(chars, F.lit(0).cast("long"), step)))


def row_checksum(*cols: str) -> Column:
    return F.md5(F.to_json(F.struct(*cols)))


def embedding_text(organism_: Column, method: Column, title: Column, abstract: Column) -> Column:
    filled = lambda c: c.isNotNull() & (c != "")
    short = F.when(F.length(abstract) > 200, F.concat(F.substring(abstract, 1, 200), F.lit("..."))).otherwise(abstract)
    return F.concat_ws(" ", F.when(filled(organism_), F.concat(F.lit("Organism: "), organism_)), F.when(filled(method), F.concat(F.lit("Method: "), method)), F.when(filled(title), title), F.when(filled(abstract), short))


def study_text(title: Column, abstract: Column, organism_: Column) -> Column:
    filled = lambda c: c.isNotNull() & (c != "")
    return F.substring(F.concat_ws(" ", F.when(filled(title), title), F.when(filled(title), title), F.when(filled(abstract), F.substring(abstract, 1, 300)), F.when(filled(organism_), F.concat(F.lit("Organism: "), organism_))), 1, 512)


def sample_text(description: Column, organism_: Column, tissue: Column, cell: Column) -> Column:
    named = lambda k, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{k}:"), c))
    return F.substring(F.concat_ws(" ", F.substring(F.nullif(description, F.lit("")), 1, 200), named("organism", organism_), named("tissue", tissue), named("cell", cell)), 1, 512)


def combined_text(*cols: Column) -> Column:
    """Non-blank fields, the literal ``NULL`` left out, 2000 characters at most."""
    return F.substring(F.concat_ws(" ", *(F.when((F.trim(c) != "") & (c != "NULL"), F.trim(c)) for c in cols)), 1, 2000)


def within_last(ts: Column, now: Column, interval: str = "1 HOUR") -> Column:
    return ts > now - F.expr(f"INTERVAL {interval}")


def rate(amount: Column, seconds: Column) -> Column:
    return F.coalesce(F.try_divide(amount.cast("double"), seconds.cast("double")), F.lit(0.0))


def confidence(score: Column, similarity: Column) -> Column:
    by_vector = F.when(similarity > 0.8, "high").when(similarity > 0.5, "medium").otherwise("low")
    by_text = F.when(score > 5, "high").when(score > 2, "medium").otherwise("low")
    return F.when(similarity > 0, by_vector).otherwise(by_text)


def intent(query: Column) -> Column:
    """What a query is about: accession, technical, study or general."""
    q = F.upper(query)
    has = lambda terms: q.rlike("|".join(terms))
    return F.when(q.rlike("^[SED]R[RSXP][0-9]+$"), "accession").when(has(schemas.TECHNICAL_TERMS), "technical").when(has(schemas.STUDY_TERMS), "study").otherwise("general")


TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")


def parse_time(c: Column, formats: tuple[str, ...] = TIME_FORMATS) -> Column:
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def first_set(*cols: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))
