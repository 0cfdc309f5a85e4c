"""Exports: JSON lines, CSV, TSV, XML, accession lists, conversion tables and the bundle of denormalised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT_FIELDS = ["id", "type", "title", "description", "organism", "platform", "library_strategy"]


def _chosen(df: DataFrame, fields: list[str] | None) -> DataFrame:
    return df.select(*fields) if fields else df


def write_json(df: DataFrame, path: str, fields: list[str] | None = None, compression: str | None = None) -> None:
    """A JSON object a line; also what JSON Lines asks for."""
    _chosen(df, fields).write.json(path, compression=compression)


def write_csv(df: DataFrame, path: str, fields: list[str] | None = RESULT_FIELDS, sep: str = ",", compression: str | None = None) -> None:
    _chosen(df, fields).write.option("header", True).option("sep", sep).csv(path, compression=compression)


def write_tsv(df: DataFrame, path: str, fields: list[str] | None = RESULT_FIELDS) -> None:
    write_csv(df, path, fields, sep="\t")


def write_xml(df: DataFrame, path: str, type_col: str = "type", id_col: str = "id", score_col: str = "score", rows_a_file: int = 100_000) -> None:
    """Files of up to ``rows_a_file`` records: an XML file is read by one task."""
    data = [c for c in df.columns if c not in (type_col, id_col, score_col)]
    shaped = df.select(F.col(type_col).alias("_type"), F.col(id_col).alias("_id"), F.col(score_col).alias("_score"), F.struct(*data).alias("data"))
    shaped.write.format("xml").option("rootTag", "export").option("rowTag", "result").option("maxRecordsPerFile", rows_a_file).save(path)


def write_accessions(df: DataFrame, path: str, id_col: str = "id") -> None:
    df.select(F.col(id_col).cast("string").alias("value")).write.text(path)


def conversion_table(converted: DataFrame) -> DataFrame:
    return converted.select("source", "target_type", F.array_join("targets", ";").alias("targets"), F.when(F.col("error").isNotNull(), "failed").otherwise("ok").alias("status"))


def column_descriptions(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, field_name, type, description`` from the schemas and their comments."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, f.name, f.dataType.simpleString(), f.metadata.get("comment", "")) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name string, field_name string, type string, description string")


def write_bundle(tables: dict[str, DataFrame], path: str, version: str = "1.0") -> None:
    """One Parquet table each, with ``col_desc`` and ``metaInfo`` beside them."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}", compression="zstd")
    column_descriptions(tables).write.mode("overwrite").parquet(f"{path}/col_desc")
    spark.createDataFrame([("schema version", version), ("tables", ",".join(tables))], "name string, value string").write.mode("overwrite").parquet(f"{path}/metaInfo")
