"""Nested XML records: explicit read schemas, archives, quarantine of what does not parse, and flattening to typed columns.

Attributes of elements carry the prefix ``_``, their text the name ``_VALUE``. An empty element reads as an empty
string and an absent one as null, which is how variants (platform, layout, action, analysis type) are told apart.
Numbers are read as strings and cast leniently when records are flattened: one bad number costs its own value only.
"""

from __future__ import annotations

import codecs
import re
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom import schemas
from metaloom.functions.scalars import organism, parse_time
from metaloom.sources.xml_records import cut_records

ATTR = "ARRAY<STRUCT<TAG: STRING, VALUE: STRING, UNITS: STRING>>"
LINK = "ARRAY<STRUCT<URL_LINK: STRUCT<LABEL: STRING, URL: STRING>, XREF_LINK: STRUCT<DB: STRING, ID: STRING, LABEL: STRING>>>"
NAMED = "ARRAY<STRUCT<_VALUE: STRING, _namespace: STRING, _label: STRING>>"
IDS = f"STRUCT<PRIMARY_ID: STRING, SECONDARY_ID: ARRAY<STRING>, EXTERNAL_ID: {NAMED}, SUBMITTER_ID: {NAMED}, UUID: ARRAY<STRING>>"
HEAD = f"_accession STRING, _alias STRING, _center_name STRING, _broker_name STRING, IDENTIFIERS {IDS}"
REF = "STRUCT<_accession: STRING, _refname: STRING>"
FILE = "STRUCT<_filename: STRING, _filetype: STRING, _checksum: STRING, _checksum_method: STRING>"
MEMBER = "STRUCT<_accession: STRING, _member_name: STRING, _proportion: STRING, READ_LABEL: ARRAY<STRING>>"
#: Variants of a platform in the order in which they are tried.
PLATFORM_ORDER = ["ILLUMINA", "ION_TORRENT", "PACBIO_SMRT", "OXFORD_NANOPORE", "LS454", "ABI_SOLID", "HELICOS", "COMPLETE_GENOMICS", "CAPILLARY"]
PLATFORM_ORDER += [p for p in schemas.PLATFORMS if p not in PLATFORM_ORDER]
MODEL = ", ".join(f"{p}: STRUCT<INSTRUMENT_MODEL: STRING>" for p in PLATFORM_ORDER)

READ_SCHEMAS = {
    "STUDY": f"{HEAD}, DESCRIPTOR STRUCT<STUDY_TITLE: STRING, STUDY_ABSTRACT: STRING, STUDY_DESCRIPTION: STRING, CENTER_PROJECT_NAME: STRING, STUDY_TYPE: STRUCT<_existing_study_type: STRING, _new_study_type: STRING>, RELATED_STUDIES: STRUCT<RELATED_STUDY: ARRAY<STRUCT<RELATED_LINK: STRUCT<DB: STRING, ID: STRING>, IS_PRIMARY: STRING>>>>, STUDY_LINKS STRUCT<STUDY_LINK: {LINK}>, STUDY_ATTRIBUTES STRUCT<STUDY_ATTRIBUTE: {ATTR}>",
    "EXPERIMENT": f"{HEAD}, TITLE STRING, STUDY_REF {REF}, DESIGN STRUCT<DESIGN_DESCRIPTION: STRING, SAMPLE_DESCRIPTOR: STRUCT<_accession: STRING, POOL: STRUCT<DEFAULT_MEMBER: {MEMBER}, MEMBER: ARRAY<{MEMBER}>>>, LIBRARY_DESCRIPTOR: STRUCT<LIBRARY_NAME: STRING, LIBRARY_STRATEGY: STRING, LIBRARY_SOURCE: STRING, LIBRARY_SELECTION: STRING, LIBRARY_LAYOUT: STRUCT<SINGLE: STRING, PAIRED: STRUCT<_NOMINAL_LENGTH: STRING, _NOMINAL_SDEV: STRING>>, LIBRARY_CONSTRUCTION_PROTOCOL: STRING, TARGETED_LOCI: STRUCT<LOCUS: ARRAY<STRUCT<_locus_name: STRING, _description: STRING>>>>, SPOT_DESCRIPTOR: STRUCT<SPOT_DECODE_SPEC: STRUCT<SPOT_LENGTH: STRING, READ_SPEC: ARRAY<STRUCT<READ_INDEX: STRING, READ_CLASS: STRING, READ_TYPE: STRING, BASE_COORD: STRING, READ_LENGTH: STRING>>>>>, PLATFORM STRUCT<{MODEL}>, EXPERIMENT_LINKS STRUCT<EXPERIMENT_LINK: {LINK}>, EXPERIMENT_ATTRIBUTES STRUCT<EXPERIMENT_ATTRIBUTE: {ATTR}>",
    "SAMPLE": f"{HEAD}, TITLE STRING, DESCRIPTION STRING, SAMPLE_NAME STRUCT<TAXON_ID: STRING, SCIENTIFIC_NAME: STRING, COMMON_NAME: STRING>, SAMPLE_LINKS STRUCT<SAMPLE_LINK: {LINK}>, SAMPLE_ATTRIBUTES STRUCT<SAMPLE_ATTRIBUTE: {ATTR}>",
    "RUN": f"{HEAD}, _run_center STRING, _run_date STRING, _published STRING, _spots STRING, _bases STRING, _total_spots STRING, _total_bases STRING, _size STRING, _load_done STRING, TITLE STRING, EXPERIMENT_REF {REF}, Statistics STRUCT<_total_spots: STRING, _total_bases: STRING, _total_size: STRING>, DATA_BLOCK STRUCT<FILES: STRUCT<FILE: ARRAY<{FILE}>>>, RUN_LINKS STRUCT<RUN_LINK: {LINK}>, RUN_ATTRIBUTES STRUCT<RUN_ATTRIBUTE: {ATTR}>",
    "ANALYSIS": f"{HEAD}, _analysis_center STRING, _analysis_date STRING, TITLE STRING, STUDY_REF {REF}, DESCRIPTION STRING, ANALYSIS_TYPE STRUCT<DE_NOVO_ASSEMBLY: STRUCT<PROCESSING: STRING>, REFERENCE_ALIGNMENT: STRUCT<ASSEMBLY: STRUCT<STANDARD: STRUCT<_short_name: STRING>, CUSTOM: STRUCT<DESCRIPTION: STRING>>, RUN_LABELS: STRUCT<RUN: ARRAY<STRUCT<_accession: STRING, _read_group_label: STRING>>>, SEQ_LABELS: STRUCT<SEQUENCE: ARRAY<STRUCT<_accession: STRING, _seq_label: STRING>>>, PROCESSING: STRUCT<PIPELINE: STRUCT<PIPE_SECTION: ARRAY<STRUCT<PROGRAM: STRING, VERSION: STRING>>>>>, SEQUENCE_ANNOTATION: STRUCT<PROCESSING: STRING>, ABUNDANCE_MEASUREMENT: STRUCT<PROCESSING: STRING>>, TARGETS STRUCT<TARGET: ARRAY<STRUCT<_sra_object_type: STRING, _accession: STRING, _refname: STRING, _refcenter: STRING>>>, DATA_BLOCK ARRAY<STRUCT<_name: STRING, _serial: STRING, _member: STRING, FILES: STRUCT<FILE: ARRAY<{FILE}>>>>, ANALYSIS_LINKS STRUCT<ANALYSIS_LINK: {LINK}>, ANALYSIS_ATTRIBUTES STRUCT<ANALYSIS_ATTRIBUTE: {ATTR}>",
    "SUBMISSION": f"{HEAD}, _lab_name STRING, _submission_date STRING, _submission_comment STRING, TITLE STRING, CONTACTS STRUCT<CONTACT: ARRAY<STRUCT<_name: STRING, _inform_on_status: STRING, _inform_on_error: STRING>>>, ACTIONS STRUCT<ACTION: ARRAY<STRUCT<ADD: STRUCT<_source: STRING, _schema: STRING>, MODIFY: STRUCT<_source: STRING, _schema: STRING>, SUPPRESS: STRUCT<_target: STRING>, HOLD: STRUCT<_target: STRING, _HoldUntilDate: STRING>, RELEASE: STRUCT<_target: STRING>, PROTECT: STRING, VALIDATE: STRING>>>, SUBMISSION_LINKS STRUCT<SUBMISSION_LINK: {LINK}>, SUBMISSION_ATTRIBUTES STRUCT<SUBMISSION_ATTRIBUTE: {ATTR}>",
}


def scan(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Records of one kind, in sets or alone; what does not parse stays as a row with ``_corrupt_record``."""
    return spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").schema(READ_SCHEMAS[tag] + ", _corrupt_record STRING").load(path)


#: Words in a member's name and the records that it holds, in the order in which they are tried.
ROUTES = {"experiment": "EXPERIMENT", "study": "STUDY", "sample": "SAMPLE", "run": "RUN"}


def route(name: Column) -> Column:
    """The kind of record in a member, by its name; null if it is skipped."""
    n = F.lower(name)
    kind = F.lit(None).cast("string")
    for word, tag in reversed(ROUTES.items()):
        kind = F.when(n.contains(word), tag).otherwise(kind)
    return F.when(n.endswith(".xml"), kind)


PIECE = 16 << 20
LARGEST = 64 << 20
BATCH = 1000  # members that leave a task together at most
_DECLARED = re.compile(rb"\s*<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._-]+)")


def _utf8(stream, size: int) -> Iterator[bytes]:
    """A member's bytes in UTF-8: as they are, or translated if a byte order mark or the declaration names another encoding."""
    chunk = stream.read(max(size, 1 << 10))  # the declaration stands in the first of them
    declared = _DECLARED.match(chunk)
    name = "utf-16" if chunk[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) else declared[1].decode() if declared else "utf-8"
    decoder = None if codecs.lookup(name).name in ("utf-8", "ascii") else codecs.getincrementaldecoder(name)()
    if decoder is None and chunk.startswith(codecs.BOM_UTF8):
        chunk = chunk[3:]
    while chunk:
        yield decoder.decode(chunk).encode() if decoder else chunk
        chunk = stream.read(size)
    if decoder:
        yield decoder.decode(b"", True).encode()


def _pieces(stream, size: int, largest: int) -> Iterator[bytes]:
    """A member in pieces of about ``size`` bytes that end behind a ``>``; what is behind the last one is a piece too."""
    held: list[bytes] = []
    for chunk in _utf8(stream, size):
        at = chunk.rfind(b">")
        if at >= 0:
            yield b"".join([*held, chunk[: at + 1]])
            held = []
        held.append(chunk[at + 1 :])
        if sum(map(len, held)) > largest:
            raise ValueError(f"no tag ends in {largest} bytes")
    if rest := b"".join(held).strip():
        yield rest


def archive_members(spark: SparkSession, path: str, piece: int = PIECE, largest: int = LARGEST) -> DataFrame:
    """``archive, member, piece, xml, error`` of tar.gz archives of any size; ``xml`` is bytes in UTF-8.

    A task an archive (gzip can't be split): it reads the archive as a stream and gives out each member in pieces of about
    ``piece`` bytes that end behind a ``>``, so it holds no whole archive and no whole member; small ones leave it together. A member that is not in the
    encoding that it names, or that has ``largest`` bytes without the end of a tag, gives a row with its error after the
    pieces before it, and the next member is read. An archive that breaks off keeps the pieces before that; one that does
    not open gives one row with its error. Spark lists the files; they are opened through Arrow.
    """

    def read(name: str) -> Iterator[tuple]:
        try:
            fs, at = pa.fs.FileSystem.from_uri(name)
            with fs.open_input_stream(at, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|gz") as tar:
                for m in tar:
                    tar.members = []  # else all headers of the archive are kept
                    if m.isfile() and m.name.lower().endswith(".xml"):
                        i = 0
                        try:
                            for data in _pieces(tar.extractfile(m), piece, largest):
                                yield name, m.name, i, data, None
                                i += 1
                        except (ValueError, LookupError) as e:  # its encoding or its size; the stream goes on
                            yield name, m.name, i, None, str(e)
        except (tarfile.TarError, OSError, EOFError, zlib.error) as e:
            yield name, None, 0, None, str(e)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for row in (r for b in batches for name in b["path"] for r in read(name)):
            held.append(row)
            size += len(row[3] or b"")
            if size >= piece or len(held) == BATCH:
                yield pd.DataFrame(held, columns=columns)
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns)

    columns = ["archive", "member", "piece", "xml", "error"]
    files = spark.read.format("binaryFile").load(path).select("path")
    # By number: tasks given by a key would be put together again, as paths are small.
    tasks = max(1, min(files.count(), 10_000))
    return files.repartition(tasks).mapInPandas(members, "archive string, member string, piece int, xml binary, error string")


def parsed(members: DataFrame, tag: str) -> DataFrame:
    """``archive, member, r, record, error``: each record of one kind, cut out and parsed by the built-in function, or its text with what is wrong with it."""
    cut_out = cut_records(members.filter(route(F.col("member")) == tag), tag)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreNamespace": "true"}
    r = F.from_xml("record", READ_SCHEMAS[tag] + ", _corrupt_record STRING", options)
    found = cut_out.withColumn("r", F.when(F.col("error").isNull(), r))
    return found.withColumn("error", F.coalesce("error", F.when(F.col("r._corrupt_record").isNotNull(), "does not parse")))


def records(members: DataFrame, tag: str) -> DataFrame:
    """Records of one kind out of members' pieces."""
    return parsed(members, tag).filter("error is null").select("archive", "member", "r.*").drop("_corrupt_record")


def quarantine(members: DataFrame, tag: str) -> DataFrame:
    """``archive, member, record, error``: texts of one kind that give no record."""
    return parsed(members, tag).filter("error is not null").select("archive", "member", "record", "error")


def good_and_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("_corrupt_record is null").drop("_corrupt_record"), df.filter("_corrupt_record is not null").select("_corrupt_record")


def attributes(c: Column) -> Column:
    return F.transform(c, lambda a: F.struct(a["TAG"].alias("tag"), a["VALUE"].alias("value"), F.nullif(a["UNITS"], F.lit("")).alias("units")))


def links(c: Column) -> Column:
    """URL and XREF links in one shape; a link that is neither is left out."""
    url, ref = lambda x: x["URL_LINK"], lambda x: x["XREF_LINK"]
    some = F.filter(c, lambda x: url(x).isNotNull() | ref(x).isNotNull())
    none = F.lit(None).cast("string")
    as_url = lambda x: F.struct(F.lit("url").alias("type"), url(x)["LABEL"].alias("label"), url(x)["URL"].alias("url"), none.alias("db"), none.alias("id"))
    as_ref = lambda x: F.struct(F.lit("xref").alias("type"), ref(x)["LABEL"].alias("label"), none.alias("url"), ref(x)["DB"].alias("db"), ref(x)["ID"].alias("id"))
    return F.transform(some, lambda x: F.when(url(x).isNotNull(), as_url(x)).otherwise(as_ref(x)))


def identifiers(c: Column) -> Column:
    named = lambda a: F.transform(a, lambda x: F.struct(x["_namespace"].alias("namespace"), x["_label"].alias("label"), x["_VALUE"].alias("value")))
    return F.struct(c["PRIMARY_ID"].alias("primary_id"), c["SECONDARY_ID"].alias("secondary_ids"), named(c["EXTERNAL_ID"]).alias("external_ids"), named(c["SUBMITTER_ID"]).alias("submitter_ids"))


def identifier_rows(df: DataFrame, record_type: str) -> DataFrame:
    """A row an identifier: primary, secondary, external, submitter, uuid."""
    i, none = F.col("IDENTIFIERS"), F.lit(None).cast("string")
    plain = lambda kind: lambda v: F.struct(F.lit(kind).alias("id_type"), none.alias("id_namespace"), v.alias("id_value"), none.alias("id_label"))
    named = lambda kind: lambda v: F.struct(F.lit(kind).alias("id_type"), v["_namespace"].alias("id_namespace"), v["_VALUE"].alias("id_value"), v["_label"].alias("id_label"))
    empty = F.array().cast("array<struct<id_type:string,id_namespace:string,id_value:string,id_label:string>>")
    parts = [F.transform(F.array_compact(F.array(i["PRIMARY_ID"])), plain("primary")), F.transform(i["SECONDARY_ID"], plain("secondary")), F.transform(i["EXTERNAL_ID"], named("external")), F.transform(i["SUBMITTER_ID"], named("submitter")), F.transform(i["UUID"], plain("uuid"))]
    return df.select(F.lit(record_type).alias("record_type"), F.col("_accession").alias("record_accession"), F.explode(F.concat(*(F.coalesce(p, empty) for p in parts))).alias("x")).select("record_type", "record_accession", "x.*").filter("id_value is not null and id_value <> ''")


def link_rows(df: DataFrame, record_type: str, c: str) -> DataFrame:
    return df.select(F.lit(record_type).alias("record_type"), F.col("_accession").alias("record_accession"), F.explode(links(F.col(c))).alias("x")).select("record_type", "record_accession", F.col("x.type").alias("link_type"), "x.db", "x.id", "x.label", "x.url")


def first_value(attrs: Column, tag: str) -> Column:
    """The first attribute of exactly this tag; '' if there is none."""
    return F.coalesce(F.try_element_at(F.filter(attrs, lambda a: a["tag"] == tag), F.lit(1))["value"], F.lit(""))


def last_value(attrs: Column, *tags: str) -> Column:
    """The last attribute of one of these tags, in any case; null if there is none."""
    return F.try_element_at(F.filter(attrs, lambda a: F.lower(a["tag"]).isin(*tags)), F.lit(-1))["value"]


def head(key: str) -> list[Column]:
    i = identifiers(F.col("IDENTIFIERS"))
    return [F.col("_accession").alias(key), F.col("_alias").alias("alias"), F.col("_center_name").alias("center_name"), F.col("_broker_name").alias("broker_name"), i["primary_id"].alias("primary_id"), i["secondary_ids"].alias("secondary_ids"), i["external_ids"].alias("external_ids"), i["submitter_ids"].alias("submitter_ids")]


def study_type(existing: Column, new: Column) -> Column:
    """The existing type; where that is blank or ``Other``, the new one if there is one."""
    other = existing.isNull() | (existing == "") | (existing == "Other")
    return F.when(other & new.isNotNull() & (new != ""), new).otherwise(existing)


def studies(df: DataFrame) -> DataFrame:
    d, attrs = F.col("DESCRIPTOR"), attributes(F.col("STUDY_ATTRIBUTES.STUDY_ATTRIBUTE"))
    related = F.transform(d["RELATED_STUDIES"]["RELATED_STUDY"], lambda r: F.struct(r["RELATED_LINK"]["DB"].alias("db"), r["RELATED_LINK"]["ID"].alias("id"), r["IS_PRIMARY"].try_cast("boolean").alias("is_primary")))
    return df.select(
        *head("study_accession"), d["STUDY_TITLE"].alias("study_title"), d["STUDY_ABSTRACT"].alias("study_abstract"), d["STUDY_DESCRIPTION"].alias("study_description"), d["CENTER_PROJECT_NAME"].alias("center_project_name"),
        study_type(d["STUDY_TYPE"]["_existing_study_type"], d["STUDY_TYPE"]["_new_study_type"]).alias("study_type"), parse_time(last_value(attrs, "submission_date")).alias("submission_date"), parse_time(last_value(attrs, "ena-first-public")).alias("first_public"), parse_time(last_value(attrs, "ena-last-update")).alias("last_update"),
        links(F.col("STUDY_LINKS.STUDY_LINK")).alias("study_links"), attrs.alias("study_attributes"), related.alias("related_studies"), organism(last_value(attrs, "organism", "scientific_name")).alias("organism"), F.to_json(F.struct(d["STUDY_TITLE"].alias("title"), attrs.alias("attributes"))).alias("metadata"),
    )


def platform(c: Column) -> tuple[Column, Column]:
    """Name of the variant that is there (else UNKNOWN) and its instrument model."""
    name = F.coalesce(*(F.when(c[p].isNotNull(), F.lit(p)) for p in PLATFORM_ORDER), F.lit("UNKNOWN"))
    return name, F.coalesce(*(F.when(c[p].isNotNull(), F.coalesce(c[p]["INSTRUMENT_MODEL"], F.lit(""))) for p in PLATFORM_ORDER), F.lit(""))


def layout(c: Column) -> Column:
    return F.when(c["SINGLE"].isNotNull(), "SINGLE").when(c["PAIRED"].isNotNull(), "PAIRED").otherwise("")


def pool_info(c: Column) -> Column:
    members = F.concat(F.array_compact(F.array(c["DEFAULT_MEMBER"])), F.coalesce(c["MEMBER"], F.array().cast(f"array<{MEMBER}>")))
    listed = F.transform(members, lambda m: F.struct(m["_accession"].alias("accession"), m["_member_name"].alias("name"), m["_proportion"].try_cast("double").alias("proportion")))
    return F.when(c.isNotNull(), F.struct(listed.alias("members"), F.size(listed).alias("member_count")))


def experiments(df: DataFrame) -> DataFrame:
    d, lib = F.col("DESIGN"), F.col("DESIGN.LIBRARY_DESCRIPTOR")
    name, model = platform(F.col("PLATFORM"))
    pool = pool_info(d["SAMPLE_DESCRIPTOR"]["POOL"])
    spec = d["SPOT_DESCRIPTOR"]["SPOT_DECODE_SPEC"]
    reads = F.transform(spec["READ_SPEC"], lambda r: F.struct(r["READ_INDEX"].try_cast("int").alias("read_index"), r["READ_CLASS"].alias("read_class"), r["READ_TYPE"].alias("read_type"), r["BASE_COORD"].try_cast("int").alias("base_coord"), F.nullif(r["READ_LENGTH"].try_cast("int"), F.lit(0)).alias("read_length")))
    attrs = attributes(F.col("EXPERIMENT_ATTRIBUTES.EXPERIMENT_ATTRIBUTE"))
    return df.select(
        *head("experiment_accession"), F.col("STUDY_REF._accession").alias("study_accession"), d["SAMPLE_DESCRIPTOR"]["_accession"].alias("sample_accession"), F.col("TITLE").alias("title"), d["DESIGN_DESCRIPTION"].alias("design_description"),
        *(lib[c].alias(c.lower()) for c in ("LIBRARY_NAME", "LIBRARY_STRATEGY", "LIBRARY_SOURCE", "LIBRARY_SELECTION", "LIBRARY_CONSTRUCTION_PROTOCOL")), layout(lib["LIBRARY_LAYOUT"]).alias("library_layout"),
        lib["LIBRARY_LAYOUT"]["PAIRED"]["_NOMINAL_LENGTH"].try_cast("int").alias("nominal_length"), lib["LIBRARY_LAYOUT"]["PAIRED"]["_NOMINAL_SDEV"].try_cast("double").alias("nominal_sdev"), name.alias("platform"), model.alias("instrument_model"),
        F.transform(lib["TARGETED_LOCI"]["LOCUS"], lambda x: F.struct(x["_locus_name"].alias("name"), x["_description"].alias("description"))).alias("targeted_loci"), F.coalesce(pool["member_count"], F.lit(0)).alias("pool_member_count"), pool.alias("pool_info"),
        links(F.col("EXPERIMENT_LINKS.EXPERIMENT_LINK")).alias("experiment_links"), attrs.alias("experiment_attributes"), spec["SPOT_LENGTH"].try_cast("int").alias("spot_length"), F.when(spec.isNotNull(), F.struct(spec["SPOT_LENGTH"].try_cast("int").alias("spot_length"), reads.alias("read_specs"))).alias("spot_decode_spec"),
    )


def pool_rows(df: DataFrame) -> DataFrame:
    d = F.col("DESIGN.SAMPLE_DESCRIPTOR")
    members = F.concat(F.array_compact(F.array(d["POOL"]["DEFAULT_MEMBER"])), F.coalesce(d["POOL"]["MEMBER"], F.array().cast(f"array<{MEMBER}>")))
    return df.select(d["_accession"].alias("parent_sample"), F.explode(members).alias("m")).select("parent_sample", F.col("m._accession").alias("member_sample"), F.col("m._member_name").alias("member_name"), F.col("m._proportion").try_cast("double").alias("proportion"), F.get("m.READ_LABEL", F.lit(0)).alias("read_label"))


def junction_rows(df: DataFrame) -> DataFrame:
    """Experiment and sample, by the descriptor and by pool members."""
    d = F.col("DESIGN.SAMPLE_DESCRIPTOR")
    all_ = F.array_distinct(F.concat(F.array(d["_accession"]), F.coalesce(F.transform(d["POOL"]["MEMBER"], lambda m: m["_accession"]), F.array().cast("array<string>"))))
    return df.select(F.col("_accession").alias("experiment_accession"), F.explode(all_).alias("sample_accession")).filter("sample_accession is not null and sample_accession <> ''").distinct()


#: Sample columns and the tags that fill them.
SAMPLE_TAGS = {
    "tissue": ("tissue",), "cell_type": ("cell_type", "cell type"), "cell_line": ("cell_line",), "strain": ("strain",), "sex": ("sex", "gender"), "disease": ("disease", "disease_state"), "treatment": ("treatment",),
    "geo_loc_name": ("geo_loc_name", "geographic_location"), "lat_lon": ("lat_lon",), "collection_date": ("collection_date",), "env_biome": ("env_biome",), "env_feature": ("env_feature",), "env_material": ("env_material",), "biosample_accession": ("biosample",), "bioproject_accession": ("bioproject",),
}


def samples(df: DataFrame) -> DataFrame:
    attrs = attributes(F.col("SAMPLE_ATTRIBUTES.SAMPLE_ATTRIBUTE"))
    age = F.try_element_at(F.filter(attrs, lambda a: F.lower(a["tag"]) == "age"), F.lit(-1))
    name = F.col("SAMPLE_NAME")
    return df.select(
        *head("sample_accession"), F.col("TITLE").alias("title"), F.col("DESCRIPTION").alias("description"), name["TAXON_ID"].try_cast("int").alias("taxon_id"), name["SCIENTIFIC_NAME"].alias("scientific_name"), name["COMMON_NAME"].alias("common_name"), organism(F.coalesce(last_value(attrs, "organism"), name["SCIENTIFIC_NAME"])).alias("organism"),
        *(last_value(attrs, *tags).alias(c) for c, tags in SAMPLE_TAGS.items()), F.concat_ws(" ", age["value"], age["units"]).alias("age"), links(F.col("SAMPLE_LINKS.SAMPLE_LINK")).alias("sample_links"), attrs.alias("sample_attributes"),
    )


def files(c: Column) -> Column:
    return F.transform(c, lambda f: F.struct(f["_filename"].alias("filename"), f["_filetype"].alias("filetype"), f["_checksum"].alias("checksum"), f["_checksum_method"].alias("checksum_method")))


def runs(df: DataFrame) -> DataFrame:
    attrs, s = attributes(F.col("RUN_ATTRIBUTES.RUN_ATTRIBUTE")), F.col("Statistics")
    whole = lambda *c: F.coalesce(*(x.try_cast("bigint") for x in c), F.lit(0).cast("long"))
    number = lambda tag, kind: last_value(attrs, tag).try_cast(kind)
    return df.select(
        *head("run_accession"), F.col("_run_center").alias("run_center"), F.col("EXPERIMENT_REF._accession").alias("experiment_accession"), F.col("TITLE").alias("title"), parse_time(F.col("_run_date")).alias("run_date"),
        whole(s["_total_spots"], F.col("_total_spots"), F.col("_spots")).alias("total_spots"), whole(s["_total_bases"], F.col("_total_bases"), F.col("_bases")).alias("total_bases"), whole(s["_total_size"], F.col("_size")).alias("total_size"), F.col("_load_done").try_cast("boolean").alias("load_done"), F.col("_published").alias("published"),
        files(F.col("DATA_BLOCK.FILES.FILE")).alias("data_files"), links(F.col("RUN_LINKS.RUN_LINK")).alias("run_links"), attrs.alias("run_attributes"),
        number("quality_score_mean", "double").alias("quality_score_mean"), number("quality_score_std", "double").alias("quality_score_std"), number("read_count_r1", "bigint").alias("read_count_r1"), number("read_count_r2", "bigint").alias("read_count_r2"),
    )


def analyses(df: DataFrame) -> DataFrame:
    t = F.col("ANALYSIS_TYPE")
    kind = F.coalesce(*(F.when(t[k].isNotNull(), F.lit(k)) for k in schemas.ANALYSIS_TYPES), F.lit("UNKNOWN"))
    a = t["REFERENCE_ALIGNMENT"]
    programs = F.transform(a["PROCESSING"]["PIPELINE"]["PIPE_SECTION"], lambda p: F.struct(p["PROGRAM"].alias("name"), p["VERSION"].alias("version")))
    targets = F.transform(F.col("TARGETS.TARGET"), lambda x: F.struct(x["_sra_object_type"].alias("sra_object_type"), x["_accession"].alias("accession"), x["_refname"].alias("refname"), x["_refcenter"].alias("refcenter")))
    blocks = F.transform(F.col("DATA_BLOCK"), lambda b: F.struct(b["_name"].alias("name"), b["_serial"].try_cast("int").alias("serial"), b["_member"].alias("member"), files(b["FILES"]["FILE"]).alias("files")))
    std, own = a["ASSEMBLY"]["STANDARD"], a["ASSEMBLY"]["CUSTOM"]
    return df.select(
        *head("analysis_accession"), F.col("_analysis_center").alias("analysis_center"), parse_time(F.col("_analysis_date")).alias("analysis_date"), F.col("STUDY_REF._accession").alias("study_accession"), F.col("TITLE").alias("title"), F.col("DESCRIPTION").alias("description"), kind.alias("analysis_type"),
        targets.alias("targets"), F.filter(F.transform(F.col("TARGETS.TARGET"), lambda x: x["_accession"]), lambda x: x.isNotNull() & (x != "")).alias("target_accessions"), blocks.alias("data_blocks"),
        F.when(std.isNotNull() | own.isNotNull(), F.struct(F.when(std.isNotNull(), "standard").otherwise("custom").alias("type"), std["_short_name"].alias("ref_name"), own["DESCRIPTION"].alias("description"))).alias("assembly_ref"),
        F.transform(a["RUN_LABELS"]["RUN"], lambda x: F.struct(x["_accession"].alias("accession"), x["_read_group_label"].alias("read_group_label"))).alias("run_labels"), F.transform(a["SEQ_LABELS"]["SEQUENCE"], lambda x: F.struct(x["_accession"].alias("accession"), x["_seq_label"].alias("seq_label"))).alias("seq_labels"),
        F.struct(F.get(programs, F.lit(0))["name"].alias("pipeline_name"), programs.alias("programs")).alias("processing"), links(F.col("ANALYSIS_LINKS.ANALYSIS_LINK")).alias("analysis_links"), attributes(F.col("ANALYSIS_ATTRIBUTES.ANALYSIS_ATTRIBUTE")).alias("analysis_attributes"),
    )


def submissions(df: DataFrame) -> DataFrame:
    kinds = ("ADD", "MODIFY", "SUPPRESS", "HOLD", "RELEASE", "PROTECT", "VALIDATE")
    action = lambda x: F.struct(
        F.coalesce(*(F.when(x[k].isNotNull(), F.lit(k)) for k in kinds)).alias("action_type"), F.coalesce(x["ADD"]["_source"], x["MODIFY"]["_source"]).alias("source"), F.coalesce(x["ADD"]["_schema"], x["MODIFY"]["_schema"]).alias("schema"),
        F.coalesce(x["SUPPRESS"]["_target"], x["HOLD"]["_target"], x["RELEASE"]["_target"]).alias("target"), x["HOLD"]["_HoldUntilDate"].alias("hold_until_date"),
    )
    contacts = F.transform(F.col("CONTACTS.CONTACT"), lambda c: F.struct(c["_name"].alias("name"), c["_inform_on_status"].alias("inform_on_status"), c["_inform_on_error"].alias("inform_on_error")))
    return df.select(
        *head("submission_accession"), F.col("_lab_name").alias("lab_name"), F.col("TITLE").alias("title"), parse_time(F.col("_submission_date")).alias("submission_date"), F.col("_submission_comment").alias("submission_comment"), contacts.alias("contacts"), F.transform(F.col("ACTIONS.ACTION"), action).alias("actions"),
        links(F.col("SUBMISSION_LINKS.SUBMISSION_LINK")).alias("submission_links"), attributes(F.col("SUBMISSION_ATTRIBUTES.SUBMISSION_ATTRIBUTE")).alias("submission_attributes"),
    )


def barcodes(attrs: Column) -> Column:
    any_of = lambda *t: last_value(attrs, *t)
    return F.struct(any_of("barcode", "index", "adapter").alias("barcode"), any_of("barcode_read", "index_read").alias("barcode_read"), any_of("dual_barcode", "dual_index").alias("dual_barcode"), any_of("umi").alias("umi"))


FLATTEN = {"STUDY": studies, "EXPERIMENT": experiments, "SAMPLE": samples, "RUN": runs, "ANALYSIS": analyses, "SUBMISSION": submissions}
