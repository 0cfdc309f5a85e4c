"""Nested records read from files, in archives, from streams; extraction rules; exports."""

from __future__ import annotations

import io
import random
import tarfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from metaloom.sources import lists, sinks, xml
from metaloom.sources.xml_records import TEXT, cut_records, lex, transitions

EXPERIMENTS = """<?xml version="1.0"?>
<EXPERIMENT_SET>
<EXPERIMENT accession="SRX000001" alias="a"><TITLE>One</TITLE><STUDY_REF accession="SRP000001"/><DESIGN><SAMPLE_DESCRIPTOR accession="SRS000001"><POOL><DEFAULT_MEMBER accession="SRS000009" member_name="rest" proportion="0.4"/><MEMBER accession="SRS000002" member_name="m" proportion="0.6"><READ_LABEL>x</READ_LABEL><READ_LABEL>y</READ_LABEL></MEMBER></POOL></SAMPLE_DESCRIPTOR>
<LIBRARY_DESCRIPTOR><LIBRARY_STRATEGY>RNA-Seq</LIBRARY_STRATEGY><LIBRARY_LAYOUT><PAIRED NOMINAL_LENGTH="300" NOMINAL_SDEV="1.5"/></LIBRARY_LAYOUT></LIBRARY_DESCRIPTOR><SPOT_DESCRIPTOR><SPOT_DECODE_SPEC><SPOT_LENGTH>100</SPOT_LENGTH><READ_SPEC><READ_INDEX>0</READ_INDEX><READ_LENGTH>0</READ_LENGTH></READ_SPEC><READ_SPEC><READ_INDEX>1</READ_INDEX><READ_LENGTH>50</READ_LENGTH></READ_SPEC></SPOT_DECODE_SPEC></SPOT_DESCRIPTOR></DESIGN>
<PLATFORM><ILLUMINA><INSTRUMENT_MODEL>Illumina NovaSeq 6000</INSTRUMENT_MODEL></ILLUMINA></PLATFORM></EXPERIMENT>
<EXPERIMENT accession="SRX000002"><STUDY_REF accession="SRP000001"/><DESIGN><LIBRARY_DESCRIPTOR><LIBRARY_LAYOUT><SINGLE/></LIBRARY_LAYOUT></LIBRARY_DESCRIPTOR></DESIGN><PLATFORM><LS454><INSTRUMENT_MODEL>454 GS</INSTRUMENT_MODEL></LS454></PLATFORM></EXPERIMENT>
</EXPERIMENT_SET>"""
STUDY = """<STUDY accession="SRP000001" center_name="C"><IDENTIFIERS><PRIMARY_ID>SRP000001</PRIMARY_ID><SECONDARY_ID>S2</SECONDARY_ID><EXTERNAL_ID namespace="GEO">GSE1</EXTERNAL_ID><SUBMITTER_ID namespace="N">sub</SUBMITTER_ID><UUID>u</UUID></IDENTIFIERS>
<DESCRIPTOR><STUDY_TITLE>T</STUDY_TITLE><STUDY_TYPE existing_study_type="Other" new_study_type="Novel"/><RELATED_STUDIES><RELATED_STUDY><RELATED_LINK><DB>SRA</DB><ID>SRP000002</ID></RELATED_LINK><IS_PRIMARY>true</IS_PRIMARY></RELATED_STUDY></RELATED_STUDIES></DESCRIPTOR>
<STUDY_LINKS><STUDY_LINK><URL_LINK><LABEL>l</LABEL><URL>http://x</URL></URL_LINK></STUDY_LINK><STUDY_LINK><XREF_LINK><DB>pubmed</DB><ID>1</ID></XREF_LINK></STUDY_LINK><STUDY_LINK/></STUDY_LINKS>
<STUDY_ATTRIBUTES><STUDY_ATTRIBUTE><TAG>organism</TAG><VALUE>human</VALUE></STUDY_ATTRIBUTE><STUDY_ATTRIBUTE><TAG>ENA-FIRST-PUBLIC</TAG><VALUE>2024-01-15</VALUE><UNITS></UNITS></STUDY_ATTRIBUTE></STUDY_ATTRIBUTES></STUDY>"""
SAMPLES = """<SAMPLE_SET><SAMPLE accession="SRS000001"><SAMPLE_NAME><TAXON_ID>9606</TAXON_ID><SCIENTIFIC_NAME>homo  SAPIENS</SCIENTIFIC_NAME></SAMPLE_NAME><SAMPLE_ATTRIBUTES>
<SAMPLE_ATTRIBUTE><TAG>Tissue</TAG><VALUE>lung</VALUE></SAMPLE_ATTRIBUTE><SAMPLE_ATTRIBUTE><TAG>tissue</TAG><VALUE>liver</VALUE></SAMPLE_ATTRIBUTE><SAMPLE_ATTRIBUTE><TAG>gender</TAG><VALUE>female</VALUE></SAMPLE_ATTRIBUTE><SAMPLE_ATTRIBUTE><TAG>age</TAG><VALUE>45</VALUE><UNITS>years</UNITS></SAMPLE_ATTRIBUTE><SAMPLE_ATTRIBUTE><TAG>barcode</TAG><VALUE>ACGT</VALUE></SAMPLE_ATTRIBUTE></SAMPLE_ATTRIBUTES></SAMPLE></SAMPLE_SET>"""
RUNS = """<RUN_SET><RUN accession="SRR000001" run_date="2024-01-15T10:30:00Z" spots="7"><EXPERIMENT_REF accession="SRX000001"/><DATA_BLOCK><FILES><FILE filename="f.bam" filetype="bam"/></FILES></DATA_BLOCK><RUN_ATTRIBUTES><RUN_ATTRIBUTE><TAG>quality_score_mean</TAG><VALUE>35.5</VALUE></RUN_ATTRIBUTE><RUN_ATTRIBUTE><TAG>read_count_r1</TAG><VALUE>many</VALUE></RUN_ATTRIBUTE></RUN_ATTRIBUTES></RUN>
<RUN accession="SRR000002"><EXPERIMENT_REF accession="SRX000002"/><Statistics total_spots="5" total_bases="50" total_size="3"/></RUN></RUN_SET>"""
ANALYSIS = """<ANALYSIS accession="SRZ000001" analysis_date="invalid_date"><TITLE>A</TITLE><ANALYSIS_TYPE><REFERENCE_ALIGNMENT><ASSEMBLY><STANDARD short_name="GRCh38"/></ASSEMBLY><PROCESSING><PIPELINE><PIPE_SECTION><PROGRAM>bwa</PROGRAM><VERSION>1</VERSION></PIPE_SECTION><PIPE_SECTION><PROGRAM>b</PROGRAM></PIPE_SECTION></PIPELINE></PROCESSING></REFERENCE_ALIGNMENT></ANALYSIS_TYPE><TARGETS><TARGET accession="SRR000001"/><TARGET accession=""/></TARGETS></ANALYSIS>"""
SUBMISSION = """<SUBMISSION accession="SRA000001" submission_date="2024-01-15 10:30:00"><CONTACTS><CONTACT name="N" inform_on_status="s"/></CONTACTS><ACTIONS><ACTION><ADD source="s.xml" schema="study"/></ACTION><ACTION><HOLD target="SRP000001" HoldUntilDate="2025-01-01"/></ACTION><ACTION><VALIDATE/></ACTION></ACTIONS></SUBMISSION>"""
FILES = {"test_experiment.xml": EXPERIMENTS, "test_study.xml": STUDY, "test_sample.xml": SAMPLES, "test_run.xml": RUNS, "analysis.xml": ANALYSIS, "submission.xml": SUBMISSION}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("xml")
    for name, text in FILES.items():
        (d / name).write_text(text)
    return d


def read(spark, folder, tag, name):
    return xml.FLATTEN[tag](xml.good_and_corrupt(xml.scan(spark, str(folder / name), tag))[0]).collect()


def test_experiments(spark, folder):
    a, b = sorted(read(spark, folder, "EXPERIMENT", "test_experiment.xml"), key=lambda r: r.experiment_accession)
    assert (a.platform, a.instrument_model, a.library_layout, a.nominal_length, a.nominal_sdev) == ("ILLUMINA", "Illumina NovaSeq 6000", "PAIRED", 300, 1.5)
    assert a.pool_member_count == 2 and [m.accession for m in a.pool_info.members] == ["SRS000009", "SRS000002"]
    assert [r.read_length for r in a.spot_decode_spec.read_specs] == [None, 50]
    assert (b.platform, b.library_layout, b.pool_member_count, b.pool_info) == ("LS454", "SINGLE", 0, None)


def test_unpivots(spark, folder):
    e = xml.scan(spark, str(folder / "test_experiment.xml"), "EXPERIMENT")
    assert [(r.member_sample, r.read_label) for r in xml.pool_rows(e).collect()] == [("SRS000009", None), ("SRS000002", "x")]
    assert {r.sample_accession for r in xml.junction_rows(e).collect()} == {"SRS000001", "SRS000002"}
    s = xml.scan(spark, str(folder / "test_study.xml"), "STUDY")
    assert [(r.id_type, r.id_namespace, r.id_value) for r in xml.identifier_rows(s, "study").collect()] == [("primary", None, "SRP000001"), ("secondary", None, "S2"), ("external", "GEO", "GSE1"), ("submitter", "N", "sub"), ("uuid", None, "u")]
    assert [(r.link_type, r.url, r.db) for r in xml.link_rows(s, "study", "STUDY_LINKS.STUDY_LINK").collect()] == [("url", "http://x", None), ("xref", None, "pubmed")]


def test_study(spark, folder):
    (s,) = read(spark, folder, "STUDY", "test_study.xml")
    assert (s.study_type, s.organism, s.first_public.year, len(s.study_links), s.study_attributes[1].units) == ("Novel", "Homo sapiens", 2024, 2, None)
    assert s.related_studies[0].id == "SRP000002" and s.external_ids[0].value == "GSE1"


def test_sample(spark, folder):
    (s,) = read(spark, folder, "SAMPLE", "test_sample.xml")
    assert (s.tissue, s.sex, s.age, s.taxon_id, s.organism) == ("liver", "female", "45 years", 9606, "Homo sapiens")
    d = xml.scan(spark, str(folder / "test_sample.xml"), "SAMPLE").select(xml.attributes(F.col("SAMPLE_ATTRIBUTES.SAMPLE_ATTRIBUTE")).alias("a"))
    r = d.select(xml.barcodes(F.col("a")).alias("b"), xml.first_value(F.col("a"), "tissue").alias("t"), xml.first_value(F.col("a"), "none").alias("n")).first()
    assert (r.b.barcode, r.t, r.n) == ("ACGT", "liver", "")


def test_runs(spark, folder):
    a, b = sorted(read(spark, folder, "RUN", "test_run.xml"), key=lambda r: r.run_accession)
    assert (a.total_spots, a.total_bases, a.run_date.hour, a.quality_score_mean, a.read_count_r1, a.data_files[0].filetype) == (7, 0, 10, 35.5, None, "bam")
    assert (b.total_spots, b.total_bases, b.total_size) == (5, 50, 3)


def test_analysis_and_submission(spark, folder):
    (a,) = read(spark, folder, "ANALYSIS", "analysis.xml")
    assert (a.analysis_type, a.assembly_ref.ref_name, a.processing.pipeline_name, a.target_accessions, a.analysis_date) == ("REFERENCE_ALIGNMENT", "GRCh38", "bwa", ["SRR000001"], None)
    (s,) = read(spark, folder, "SUBMISSION", "submission.xml")
    assert [(x.action_type, x.target) for x in s.actions] == [("ADD", None), ("HOLD", "SRP000001"), ("VALIDATE", None)]


def test_archives(spark, folder, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for n in FILES:
            t.add(folder / n, n)
        (tmp_path / "test.txt").write_text("no")
        t.add(tmp_path / "test.txt", "test.txt")
    (tmp_path / "b.tar.gz").write_text("not gzip data")
    m = xml.archive_members(spark, str(tmp_path / "*.tar.gz")).cache()
    assert m.filter("error is not null").count() == 1 and m.filter("member is not null").count() == len(FILES)
    assert {r._accession for r in xml.records(m, "EXPERIMENT").collect()} == {"SRX000001", "SRX000002"}
    assert xml.records(m, "STUDY").count() == 1
    # A member larger than a piece: its records come whole from several pieces, and an archive that breaks off keeps what was read.
    big = "<RUN_SET>" + "".join(f'<RUN accession="SRR{i}"><TITLE>{"t" * (i % 50)}</TITLE></RUN>' for i in range(500)) + "</RUN_SET>"
    (tmp_path / "big.run.xml").write_text(big)
    with tarfile.open(tmp_path / "c.tgz", "w:gz") as t:
        t.add(tmp_path / "big.run.xml", "big.run.xml")
        t.add(tmp_path / "big.run.xml", "again.run.xml")
    pieces = xml.archive_members(spark, str(tmp_path / "c.tgz"), piece=1000).cache()
    assert pieces.count() > 20 and xml.records(pieces, "RUN").select("_accession").distinct().count() == 500 and xml.records(pieces, "RUN").count() == 1000
    raw = (tmp_path / "c.tgz").read_bytes()
    (tmp_path / "cut.tgz").write_bytes(raw[: len(raw) * 2 // 3])
    part = xml.archive_members(spark, str(tmp_path / "cut.tgz"), piece=1000).cache()
    assert part.filter("error is not null").count() == 1 and 0 < part.filter("error is null").count() < pieces.count()


def archive(path, **members: bytes):
    with tarfile.open(path, "w:gz") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(f"{name}.xml")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


@pytest.mark.parametrize("piece", [7, 60, 1 << 20])
def test_records_with_comments_sections_and_prefixes(spark, tmp_path, piece):
    good = b"""<?xml version="1.0"?><!DOCTYPE s [ <!ENTITY x "<STUDY>"> ]><!-- <STUDY accession="no"> --><STUDY_SET>
<STUDY accession="1" alias="/STUDY> > x"><!-- </STUDY> --><DESCRIPTOR><STUDY_TITLE><![CDATA[a </STUDY> ]] > b]]></STUDY_TITLE></DESCRIPTOR></STUDY>
<STUDY accession='2'/><s:STUDY accession="3"><?p </STUDY> ?><s:DESCRIPTOR><s:STUDY_TITLE>t</s:STUDY_TITLE></s:DESCRIPTOR></s:STUDY><STUDYX accession="no"></STUDYX>
<STUDY accession="4"><DESCRIPTOR><STUDY_TITLE>\xc3\xa9\xf0\x9f\x99\x82 &lt;</STUDY_TITLE></DESCRIPTOR></STUDY></STUDY_SET>"""
    broken = b'<STUDY accession="5"><DESCRIPTOR>never closed <STUDY accession="6"/><STUDY accession="7"><DESCRIPTOR></STUDY><STUDY accession="8"><DESCRIPTOR>\xff\xfe</DESCRIPTOR></STUDY><STUDY accession="9">the end'
    latin = '<?xml version="1.0" encoding="ISO-8859-1"?><STUDY accession="10"><DESCRIPTOR><STUDY_TITLE>é</STUDY_TITLE></DESCRIPTOR></STUDY>'.encode("latin-1")
    wide = '<?xml version="1.0" encoding="UTF-16"?><STUDY accession="11"/>'.encode("utf-16")
    archive(tmp_path / "a.tgz", study1=good, study2=broken, study3=latin, study4=wide, study5=b"<?xml version='1.0' encoding='nothing'?><STUDY accession='no'/>", study6=b"", study7=b"\xef\xbb\xbf<STUDY accession='12'></STUDY>")
    m = xml.archive_members(spark, str(tmp_path / "a.tgz"), piece=piece)
    got = {r._accession: r.DESCRIPTOR.STUDY_TITLE if r.DESCRIPTOR else None for r in xml.records(m, "STUDY").collect()}
    assert got == {"1": "a </STUDY> ]] > b", "2": None, "3": "t", "4": "é🙂 <", "6": None, "10": "é", "11": None, "12": None}
    bad = sorted((r.error, r.record.split('"')[1]) for r in xml.quarantine(m, "STUDY").collect())
    assert bad == [("does not parse", "7"), ("not UTF-8", "8"), ("not closed", "5"), ("not closed", "9")]
    assert [r.member for r in m.filter("error is not null").collect()] == ["study5.xml"]


def some_xml(rng: random.Random) -> str:
    """A set of records, well formed, with all that may hide a tag."""
    hidden = ["<!-- </RUN> <RUN> -->", "<![CDATA[<RUN></RUN>]]>", "<?x <RUN> ?>", "text > more", "<TITLE q='/RUN>' p=\">\">t</TITLE>", "<RUNS/>", "<a><b/></a>", "&amp;"]
    def record(i: int) -> str:
        if rng.random() < 0.2:
            return f"<RUN accession='{i}' />"
        more = rng.choice(["", " x='>'"])
        return f'<RUN accession="{i}"{more}>' + "".join(rng.choice(hidden) for _ in range(rng.randrange(5))) + "</RUN >"

    return "<RUN_SET>" + "".join(record(i) + rng.choice(["", "\n", "<!-- > -->", "<OTHER><RUN_X/></OTHER>"]) for i in range(rng.randrange(1, 12))) + "</RUN_SET>"


def test_records_equal_those_of_a_parser(spark):
    """Generated files in pieces of any length against the standard library's parser."""
    rng = random.Random(11)
    rows, want = [], []
    for f in range(60):
        text = some_xml(rng)
        want += [(str(f), e.get("accession"), "".join(e.itertext())) for e in ElementTree.fromstring(text).iter("RUN")]
        places = [i + 1 for i, c in enumerate(text) if c == ">" and rng.random() < 0.4]
        rows += [("a", str(f), i, text[a:b].encode()) for i, (a, b) in enumerate(zip([0, *places], [*places, len(text)], strict=True)) if a < b]
    pieces = spark.createDataFrame(rows, "archive string, member string, piece int, xml binary").repartition(5)
    got = cut_records(pieces, "RUN").collect()
    assert all(r.error is None for r in got)
    parsed = [(r.member, ElementTree.fromstring(r.record)) for r in got]
    assert sorted((m, e.get("accession"), "".join(e.itertext())) for m, e in parsed) == sorted(want) and len(want) > 200


def test_transitions_compose():
    """A run over a whole text and one over its pieces, from whatever state each is entered in."""
    rng = random.Random(2)
    bits = "<R>|</R>|<R a=\"x>y\">|<R b='</R>'/>|<!-- </R> <R> -->|<![CDATA[ <R>]] > </R>]]>|<?p <R> ?>|text|<n:R x='1'>|</n:R>|<R_SET>|<O q='a>\"b'>|<X/>|<!DOCTYPE a [ <!E x '>'> ]>|]]>|<R c='|<!--|<![CDATA[".split("|")
    for _ in range(2000):
        data = ("".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) + ">").encode()
        places = [i + 1 for i, c in enumerate(data) if c == 62 and rng.random() < 0.5]
        end, events = lex(data, TEXT, "R")
        state, got, at = TEXT, [], 0
        for b in [*places, len(data)]:
            step, own = transitions(data[at:b], "R")[state], lex(data[at:b], state, "R")
            assert step == (own[0], -2 if not own[1] else own[1][-1][1] if own[1][-1][0] == "S" else -1)
            got += [(k, p + at) for k, p in own[1]]
            state, at = own[0], b
        assert (state, got) == (end, events)


def test_long_texts_without_end_stay_in_parts(spark):
    pieces = spark.createDataFrame([("a", "m", i, b"<RUN>" if i == 0 else b"x" * 99 + b"<b/>") for i in range(20)] + [("a", "m", 20, b"<RUN/>")], "archive string, member string, piece int, xml binary")
    got = cut_records(pieces, "RUN", largest=500).collect()
    assert [r.record for r in got if r.error is None] == ["<RUN/>"] and sum(r.error == "not closed" for r in got) == 21


def test_corrupt_rows(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<RUN_SET>\n<RUN accession="SRR1"><TITLE>a</OTHER></RUN>\n</RUN_SET>')
    (tmp_path / "y.xml").write_text('<RUN_SET>\n<RUN accession="SRR2" spots="abc"><TITLE>b</TITLE></RUN>\n</RUN_SET>')
    good, bad = xml.good_and_corrupt(xml.scan(spark, str(tmp_path), "RUN").cache())
    assert [(r.run_accession, r.total_spots) for r in xml.runs(good).collect()] == [("SRR2", 0)] and bad.count() == 1


def test_listing(spark):
    html = '<a href="Meta_20240105.tar.gz">Meta_20240105.tar.gz</a>  2024-01-05 10:00  1.5G\n<a href="Meta_Full_20240101.tar.gz">x</a> 2024-01-01 10:00 20M\n<a href="other.txt">o</a> 1K'
    rows = lists.listing(spark.createDataFrame([(html,)], "html string")).collect()
    assert [(r.name, str(r.date), r.kind, r["size"]) for r in rows] == [("Meta_20240105.tar.gz", "2024-01-05", "daily", int(1.5 * 2**30)), ("Meta_Full_20240101.tar.gz", "2024-01-01", "monthly", 20 * 2**20)]


def test_accession_list(spark, tmp_path):
    (tmp_path / "l.txt").write_text("SRR1\n\n # no\n  SRR2  \n")
    assert [r.accession for r in lists.read_accessions(spark, str(tmp_path / "l.txt")).collect()] == ["SRR1", "SRR2"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("SRP1", "study", "a,b", "d", "o", "p", "l", 1.5)], "id string, type string, title string, description string, organism string, platform string, library_strategy string, score double")
    sinks.write_json(df, str(tmp_path / "j"), ["id", "title"], "gzip")
    assert spark.read.json(str(tmp_path / "j")).first().title == "a,b"
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_tsv(df, str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().title == "a,b"
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).columns == sinks.RESULT_FIELDS
    sinks.write_xml(df, str(tmp_path / "x"))
    r = spark.read.format("xml").option("rowTag", "result").load(str(tmp_path / "x")).first()
    assert (r._id, r._type, r.data.title) == ("SRP1", "study", "a,b")
    sinks.write_accessions(df, str(tmp_path / "a"))
    assert spark.read.text(str(tmp_path / "a")).first().value == "SRP1"
    sinks.write_bundle({"study": df}, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b/col_desc")).count() == 8 and spark.read.parquet(str(tmp_path / "b/study")).count() == 1


def test_archives_are_read_by_a_task_each(spark, tmp_path):
    for n in range(6):
        with tarfile.open(tmp_path / f"a{n}.tar.gz", "w:gz") as tar:
            for i in range(1200):
                info = tarfile.TarInfo(f"{i}.study.xml")
                info.size = 8
                tar.addfile(info, io.BytesIO(b"<STUDY/>"))
    found = xml.archive_members(spark, f"{tmp_path}/*.tar.gz")
    assert found.rdd.getNumPartitions() == 6
    assert found.count() == found.select("archive", "member").distinct().count() == 7200
    assert found.filter("error is not null or xml <> cast('<STUDY/>' as binary)").count() == 0
