"""States of days against counting anew."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from metaloom.operators import states
from metaloom.session import new_folder


def test_states_merge_and_one_day_changes_alone(spark):
    rng = random.Random(4)
    some = lambda days: [(d, rng.choice(["a", "b", None, "c"]), rng.randrange(70_000)) for d in days for _ in range(rng.randrange(1, 60))]
    frame = lambda rows: spark.createDataFrame(rows, "day string, platform string, study long")
    rows = some([f"2024-01-{i:02}" for i in range(1, 10)] + ["2024-02-01", "2024-02-02"])
    folder = new_folder(spark, "states")
    states.write_days(frame(rows), "day", ["platform", "study"], folder)

    def check():
        for period, days, of in ((None, None, lambda d: "all"), (F.substring("day", 1, 7), None, lambda d: d[:7]), (None, F.col("day") > "2024-01-05", lambda d: "all" if d > "2024-01-05" else None)):
            kept = [(of(d), d, p, s) for d, p, s in rows if of(d)]
            want = {(w, f): len({x for v, _, *two in kept if v == w for x in two[k : k + 1] if x is not None}) for w in {r[0] for r in kept} for k, f in enumerate(("platform", "study"))}
            got = {(r.period, r.field): r.distinct_values for r in states.merged_distinct(spark, folder, period, days).collect()}
            assert got == want
            assert {r.period: r.rows for r in states.merged_totals(spark, folder, period, days).collect()} == Counter(r[0] for r in kept)
            facets = {(r.period, r.value): r["count"] for r in states.merged_facets(spark, folder, period, days).filter("field = 'platform'").collect()}
            assert facets == Counter((r[0], r[2]) for r in kept if r[2] is not None)

    check()
    files = lambda: {r.path: r.modificationTime for r in spark.read.format("binaryFile").load(f"{folder}/distinct").select("path", "modificationTime").collect()}
    before = files()
    rows = [r for r in rows if r[0] != "2024-01-03"] + [("2024-01-03", "new", 70_001), ("2024-01-03", "a", 5)]
    states.write_days(frame([r for r in rows if r[0] == "2024-01-03"]), "day", ["platform", "study"], folder)
    check()
    after = files()
    assert {p for p in after if before.get(p) != after[p]} == {p for p in after if "day=2024-01-03" in p}


def test_days_are_read_by_themselves(spark):
    folder = new_folder(spark, "states")
    states.write_days(spark.createDataFrame([("2024-01-01", "a"), ("2024-01-02", "b")], "day string, platform string"), "day", ["platform"], folder)
    one = states.merged_distinct(spark, folder, None, F.col("day") == "2024-01-02")
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().toString() and one.first().distinct_values == 1
