"""Data quality as issues: ``record_type, accession, severity, rule, field, message`` rows over documents or entity frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom import schemas
from metaloom.functions.scalars import is_accession

# What each record must have.
REQUIRED = {
    "STUDY": ["STUDY_TITLE", "STUDY_TYPE"],
    "SAMPLE": ["SAMPLE_NAME", "TAXON_ID"],
    "EXPERIMENT": ["STUDY_REF", "DESIGN", "SAMPLE_DESCRIPTOR", "LIBRARY_DESCRIPTOR", "PLATFORM"],
    "RUN": ["EXPERIMENT_REF"],
    "ANALYSIS": ["TITLE", "STUDY_REF", "DESCRIPTION", "ANALYSIS_TYPE"],
}


def document_type(xml: Column) -> Column:
    """By the root element; '' if it is none of the six."""
    root = F.regexp_extract(xml, r"^\s*(?:<\?[^>]*\?>\s*|<!--(?s:.*?)-->\s*|<![^>]*>\s*)*<([A-Za-z_]+)", 1)
    return F.regexp_extract(root, "^(STUDY|SAMPLE|EXPERIMENT|RUN|ANALYSIS|SUBMISSION)(_SET)?$", 1)


def elements(xml: Column) -> Column:
    return F.regexp_count(xml, F.lit("<[A-Za-z]"))


def issue(when: Column, severity: str, rule: str, field: str, message: str) -> Column:
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(field).alias("field"), F.lit(message).alias("message")))


def issues(df: DataFrame, record_type: Column, accession: Column, checks: list[Column]) -> DataFrame:
    return df.select(record_type.alias("record_type"), accession.alias("accession"), F.explode(F.array_compact(F.array(*checks))).alias("i")).select("record_type", "accession", "i.*")


def required_in_xml(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    kind = document_type(F.col(xml))
    checks = [issue((kind == k) & ~F.col(xml).rlike(f"<{f}[ />]"), "error", "missing_field", f, f"{f} is required") for k, fields in REQUIRED.items() for f in fields]
    return issues(docs, kind, F.col(key), checks)


def required(df: DataFrame, kind: str, key: str, fields: list[str]) -> DataFrame:
    checks = [issue(F.col(f).isNull() | (F.col(f).cast("string") == ""), "error", "missing_field", f, f"{f} is required") for f in fields]
    return issues(df, F.lit(kind), F.col(key), checks)


def not_numeric(c: Column) -> Column:
    return c.isNotNull() & ~c.cast("string").rlike(r"^\d+$")


def not_in(c: Column, values: list[str]) -> Column:
    return c.isNotNull() & (c != "") & ~c.isin(values)


def model_mismatch(df: DataFrame, platform: str, model: str) -> DataFrame:
    """Rows whose platform is known but does not have the model; compared in lower case against the fixed dimension."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(p, m.lower()) for p, ms in schemas.INSTRUMENTS.items() for m in ms], "_p string, _m string").distinct()
    return df.filter(F.col(platform).isin(schemas.PLATFORMS) & F.col(model).isNotNull()).join(F.broadcast(dim), (F.col(platform) == F.col("_p")) & (F.lower(model) == F.col("_m")), "left_anti")


def strategy_category(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, names in schemas.STRATEGY_CATEGORY.items() for s in names for x in (s, k))), c), F.lit("unknown"))


def bad_reference(c: Column, kind: str) -> Column:
    return c.isNotNull() & (c != "") & ~is_accession(c, kind)


def files_without_name(files: Column) -> Column:
    return F.exists(files, lambda f: f["filename"].isNull() | (f["filename"] == ""))


def unknown_file_types(files: Column) -> Column:
    return F.exists(files, lambda f: f["filetype"].isNotNull() & (f["filetype"] != "") & ~f["filetype"].isin(schemas.RUN_FILE_TYPES))


def status_of(found: DataFrame, records: DataFrame, key: str = "accession") -> DataFrame:
    """VALID, WARNING or INVALID for every record."""
    n = found.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = records.select(key).join(n, key, "left").na.fill(0, ["errors", "warnings"])
    return out.withColumn("status", F.when(F.col("errors") > 0, "INVALID").when(F.col("warnings") > 0, "WARNING").otherwise("VALID"))


def split_by_errors(records: DataFrame, found: DataFrame, key: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good rows, and those put aside (none unless strict)."""
    bad = found.filter("severity = 'error'").select(F.col("accession").alias(key)).distinct()
    return (records.join(bad, key, "left_anti"), records.join(bad, key, "left_semi")) if strict else (records, records.limit(0))


def any_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))
