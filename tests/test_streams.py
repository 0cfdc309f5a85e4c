"""Streams with state, and the listing as a source: the same rows however they come in, and after restarts."""

from __future__ import annotations

import random
import shutil

import pytest
from pyspark.sql import functions as F

from metaloom.sources import listing_source
from metaloom.streaming import changes as ch

VERSIONS = "key long, seq long, hash string, gone boolean"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_do_not_depend_on_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    versions = [(rng.randrange(12), i, rng.choice(["a", "b", None]), rng.random() < 0.2) for i in range(150)]
    want = rows(ch.change_log(spark.createDataFrame(versions, VERSIONS)))
    assert {r[2] for r in want} == {"new", "changed", "deleted"}
    cuts = sorted(rng.sample(range(1, 150), 2))
    for a, b in zip([0, *cuts], [*cuts, 150], strict=True):
        again = versions[max(0, a - 5) : b]  # the last rows of the batch before are delivered once more
        spark.createDataFrame(again, VERSIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(VERSIONS).parquet(str(tmp_path / "in"))
        ch.write_changes(ch.changed_rows(stream), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    assert rows(ch.read_changes(spark, str(tmp_path / "out"))) == want
    # The last batch is lost and comes again: the state is that of the batch before it.
    last = max(int(p.name) for p in (tmp_path / "at" / "commits").iterdir() if p.name.isdigit())
    (tmp_path / "at" / "commits" / str(last)).unlink()
    (tmp_path / "at" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "out" / f"batch={last}")
    stream = spark.readStream.schema(VERSIONS).parquet(str(tmp_path / "in"))
    ch.write_changes(ch.changed_rows(stream), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    assert rows(ch.read_changes(spark, str(tmp_path / "out"))) == want


def test_keys_without_versions_expire(spark, tmp_path):
    schema = VERSIONS + ", at timestamp"
    for k, part in enumerate(["(1, 1, 'a', false, '2024-01-01 00:00:00'), (2, 2, 'a', false, '2024-01-01 00:00:00'), (3, 3, 'a', false, '2024-01-01 00:00:00')", "(1, 4, 'b', false, '2024-01-01 00:50:00'), (3, 5, 'a', true, '2024-01-01 00:10:00')", "(9, 6, 'z', false, '2024-01-01 01:30:00')", "(9, 7, 'z', false, '2024-01-01 01:31:00')"]):
        spark.sql(f"select * from values {part} t(key, seq, hash, gone, at)").select("key", F.col("seq").cast("long"), "hash", "gone", F.col("at").cast("timestamp")).withColumn("key", F.col("key").cast("long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("at", "0 seconds")
        ch.write_changes(ch.changed_rows(stream, keep_seconds=3600), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
        assert k >= 0
    got = rows(ch.read_changes(spark, str(tmp_path / "out")))
    assert (2, 2, "expired") in got and not any(r[0] in (1, 3, 9) and r[2] == "expired" for r in got)  # 1 is younger, 3 was deleted


def page(names):
    return "<pre>\n" + "\n".join(f'<a href="{n}">{n}</a>  2024-01-05 10:00  {i + 1}.5K' for i, n in enumerate(names)) + '\n<a href="other.txt">o</a> 1K\n<a href="Meta_20249999.tar.gz">x</a> 1K\n</pre>'


def test_listing_gives_each_file_once(spark, tmp_path):
    listing_source.register(spark)
    at = tmp_path / "page.html"
    first = ["Meta_20240105.tar.gz", "Meta_Full_20240101.tar.gz"]
    at.write_text(page(first))
    batch = rows(spark.read.format("archive_listing").option("page", str(at)).load())
    assert [(r[0], str(r[1]), r[2], r[3]) for r in batch] == [("Meta_20240105.tar.gz", "2024-01-05", "daily", 1536), ("Meta_Full_20240101.tar.gz", "2024-01-01", "monthly", 2560)]

    def run():
        stream = spark.readStream.format("archive_listing").option("page", str(at)).option("log", str(tmp_path / "log")).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(once=True).start().awaitTermination()
        return [r[0] for r in rows(spark.read.schema(stream.schema).parquet(str(tmp_path / "out")))]

    assert run() == first
    assert run() == first  # nothing new
    more = ["Meta_20231231.tar.gz", *first, "Meta_20240106.tar.gz"]  # an older one appears late
    at.write_text(page(more))
    assert run() == sorted(more)
    # A batch was planned, its offset logged, and then lost: it comes again, with the same files, although the page has changed.
    commits = tmp_path / "at" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    (commits / str(last)).unlink()
    (commits / f".{last}.crc").unlink(missing_ok=True)
    at.write_text(page([*more, "Meta_20240107.tar.gz"]))
    run()
    assert run() == sorted([*more, "Meta_20240107.tar.gz"])


def test_parts_between_offsets_are_fixed(tmp_path):
    at = tmp_path / "page.html"
    at.write_text(page(["Meta_20240105.tar.gz"]))
    reader = listing_source._Stream(str(at), str(tmp_path / "log"))
    assert reader.latestOffset() == {"entry": 1} == reader.latestOffset()
    at.write_text(page(["Meta_20240106.tar.gz"]))  # the first is gone from the page
    again = listing_source._Stream(str(at), str(tmp_path / "log"))
    assert again.latestOffset() == {"entry": 2}
    names = lambda a, b: [r[0] for p in again.partitions({"entry": a}, {"entry": b}) for r in again.read(p)]
    assert names(0, 1) == ["Meta_20240105.tar.gz"] and names(1, 2) == ["Meta_20240106.tar.gz"] and names(2, 2) == []
