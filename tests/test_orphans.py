import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strataloom.operators import orphans, skew

T0 = datetime(2025, 1, 1, tzinfo=UTC)


@pytest.mark.parametrize("least", [1, 1000])
def test_orphans_against_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "LEAST_HEAVY", least)
    monkeypatch.setattr(skew, "HEAVY_SHARE", 0.05)
    rng = random.Random(2)
    day = lambda: T0 + timedelta(days=rng.randrange(5))
    rows = [(f"r{i}", "hot" if i % 3 == 0 else "lost" if i % 7 < 3 else rng.choice([None, "", *"abcdefgh"]), day(), day()) for i in range(120)]
    rows += rows[:20]
    targets = [(k, day()) for k in ["hot", "a", "b", "c", "", "a", None]]
    deleted = [("d",), ("a",), (None,), ("d",)]
    refs = spark.createDataFrame(rows, "id string, ref string, created_at timestamp, computed_at timestamp")
    recs = orphans.references(refs, "t", "ref", "id", F.col("ref"), F.lit("k"), F.date_format("created_at", "yyyy-MM"), F.col("computed_at"))
    known = orphans.arrivals(spark.createDataFrame(targets, "key string, computed_at timestamp"), "key", ["k"], F.col("computed_at"))
    found = orphans.orphans(recs, known, spark.createDataFrame(deleted, "target string"), ["kind", "target"])
    got = sorted((r.record_key, r.status) for r in found.collect())
    first = {}
    for k, at in targets:
        if k is not None:
            first[k] = min(at, first.get(k, at))
    want = set()
    for i, ref, _, at in rows:
        if ref is None:
            continue
        if ref not in first:
            want.add((i, "deleted" if ref == "d" else "missing"))
        elif first[ref] > at:
            want.add((i, "late"))
    assert got == sorted(want)
    counts = {(r.status, r.n_records) for r in orphans.orphan_report(recs, known, spark.createDataFrame(deleted, "target string"), ["kind", "target"]).groupBy("status").agg(F.sum("n_records").alias("n_records")).collect()}
    assert counts == {(s, sum(x == s for _, x in want)) for _, s in want}


def test_empty_tables(spark):
    refs = spark.createDataFrame([], "id string, ref string, created_at timestamp, computed_at timestamp")
    recs = orphans.references(refs, "t", "ref", "id", F.col("ref"), F.lit("k"), F.lit("p"), F.col("computed_at"))
    known = orphans.arrivals(spark.createDataFrame([], "key string"), "key", ["k"], None)
    assert orphans.orphans(recs, known, spark.createDataFrame([], "target string"), ["kind", "target"]).collect() == []


def test_running_sums_and_ranks_cover_groups_of_any_size(spark):
    rows = [("a" if i % 3 else None, i, float(i % 5)) for i in range(200)] + [("b", 1000, 2.0)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    out = skew.running_sums(df, ["g"], "id", F.col("v"), "before", buckets=7).collect()
    assert len(out) == len(rows)
    for g in ("a", None, "b"):
        mine = sorted((r.before, r.v) for r in out if r.g == g)
        total = 0.0
        for before, v in sorted(mine, key=lambda x: (x[0], x[1] != 0)):
            assert before == pytest.approx(total)
            total += v
    named = df.filter("g IS NOT NULL")
    ranked = {(r.g, r.id): r.n for r in skew.ranked(named, "g", [F.col("v").desc(), F.col("id").asc()], "n").collect()}
    for g in ("a", "b"):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        assert [ranked[g, r[1]] for r in order] == list(range(len(order)))
