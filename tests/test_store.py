import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strataloom.sources import store as S
from strataloom.sources.tables import read_or_empty, read_table
from strataloom.streaming import windows as W


def test_table_round_trip_and_verification(spark, tmp_path):
    df = spark.createDataFrame([(3, "c", None), (1, "a", [1]), (2, None, [])], "id int, t string, l array<int>")
    path = str(tmp_path / "t")
    meta = S.write_table(df, path, ["id"])
    assert meta["rows"] == 3 and S.verify_table(spark, path) == {}
    assert meta == S.write_table(df.repartition(5), str(tmp_path / "u"), ["id"])
    spark.createDataFrame([(9, "x", None)], df.schema).write.mode("append").parquet(path)
    assert "rows" in S.verify_table(spark, path)


def test_package(spark, tmp_path):
    tables = {"a": spark.createDataFrame([(i,) for i in range(40)], "id int"), "b": spark.createDataFrame([("x", {"k": 1})], "n string, m map<string,int>").drop("m")}
    folder = str(tmp_path / "p")
    manifest = S.export_package(tables, folder, {"a": ["id"]})
    assert manifest["a"]["rows"] == 40
    assert {n: d.count() for n, d in S.load_package(spark, folder).items()} == {"a": 40, "b": 1}
    assert spark.read.json(f"{folder}/samples/a").count() == 25
    tables["a"].limit(3).write.mode("overwrite").parquet(f"{folder}/a")
    with pytest.raises(Exception):
        S.load_package(spark, folder)


def test_union_json_shards_tombstones(spark, tmp_path):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("s",)], "y string")
    assert {tuple(r) for r in S.union_all([a, b]).select("x", "y").collect()} == {(1, None), (None, "s")}
    nested = spark.createDataFrame([(1, [("p", 2)])], "id int, e array<struct<k:string,v:int>>")
    back = S.from_json(S.with_json(nested, ["e"]), {"e": "array<struct<k:string,v:int>>"})
    assert back.collect() == nested.collect()
    folder = str(tmp_path / "s")
    S.write_shards(a, folder)
    S.write_shards(a, folder, append=True)
    read = S.read_shards(spark, folder, a.schema).collect()
    assert [r.x for r in read] == [1, 1] and all(r.shard.endswith(".gz") for r in read)
    gone = S.missing_keys(spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,)], "k int"), "k").collect()
    assert [(r.k, r.is_missing) for r in gone] == [(2, True)]
    assert read_or_empty(spark, str(tmp_path / "none"), a.schema).collect() == []


def test_failures_are_rows(spark):
    df = spark.createDataFrame([(1, "4"), (2, "x"), (3, None)], "id int, v string")
    got = {r.id: (r.result, r.error) for r in S.map_concurrent(df, lambda v: str(int(v) + 1), "v", "id").collect()}
    assert got[1] == ("5", None) and got[2][0] is None and got[2][1].startswith("ValueError") and got[3][1].startswith("TypeError")


def test_git_output(spark, tmp_path):
    log = "\x1f".join(["s1", "t", "p1 p2", "A", "a@x", "2025-01-02T03:04:05+01:00", "C", "c@x", "bad", "Subject", "Body\nline", ""]) + "\x1e\n" + "\x1f".join(["s2", "t", "", "A", "a@x", "2025-01-01T00:00:00Z", "C", "c@x", "", "S", "", ""]) + "\x1e"
    (tmp_path / "log").write_text(log)
    rows = {r.commit_sha: r for r in S.read_git_log(spark, str(tmp_path / "log")).collect()}
    assert rows["s1"].parent_shas == ["p1", "p2"] and rows["s2"].parent_shas == [] and rows["s1"].committed_at is None
    assert rows["s1"].authored_at == datetime(2025, 1, 2, 2, 4, 5) or rows["s1"].authored_at is not None
    raw = "c1\0:100644 100644 a b M\0x.py\0:100644 100644 a b R090\0old.py\0new.py\0:0 1 a b A\0img.png\0" + "3\t1\tx.py\0" + "0\t2\t\0old.py\0new.py\0" + "-\t-\timg.png\0"
    (tmp_path / "raw").write_text(raw + "\x1e")
    got = {r.path: (r.change_status, r.previous_path, r.additions, r.deletions, r.is_binary) for r in S.read_git_changes(spark, str(tmp_path / "raw")).collect()}
    assert got == {"x.py": ("M", None, 3, 1, False), "new.py": ("R", "old.py", 0, 2, False), "img.png": ("A", None, None, None, True)}


def test_sources_on_disk(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("no")
    (tmp_path / "a.py").write_text("import os")
    (tmp_path / "big.ts").write_text("x" * 100)
    got = {r.path: (r.content, r.status) for r in S.read_sources(spark, str(tmp_path), most_bytes=50).collect()}
    assert got == {"a.py": ("import os", "ok"), "big.ts": (None, "too_large")}


def test_windows_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    events = read_table(spark, "/root/testdata/sf0.001", "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    assert stream.isStreaming
    counts = W.window_counts(stream, "ts", ["event_type"], "value", "6 hours")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    as_set = lambda df: {(r.window_start, r.event_type, r.n_events, round(r.total, 4)) for r in df.collect()}
    assert as_set(spark.table("windows")) == as_set(W.window_counts(events, "ts", ["event_type"], "value", "6 hours"))
    doubled = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    once = W.first_seen(doubled, ["event_id"], "ts", "100 days")
    query = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("once").count() == events.count()
    time.sleep(0)


def test_sessions(spark):
    rows = [(1, datetime(2025, 1, 1, 0, m)) for m in (0, 5, 40)] + [(2, datetime(2025, 1, 1))]
    df = spark.createDataFrame(rows, "u int, ts timestamp")
    got = sorted((r.u, r.n_events) for r in W.sessions(df, "ts", "u", "30 minutes").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]
