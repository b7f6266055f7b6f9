import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strataloom.llm import conversations as C

T0 = datetime(2025, 1, 1, tzinfo=UTC)
SCHEMA = "thread_id string, message_id string, reply_to string, position long, author string, body string, created_at timestamp, fetched_at timestamp, turn_note string"


def rows_of(seed, n_threads=40, longest=9):
    rng = random.Random(seed)
    rows = []
    for t in range(n_threads):
        n = rng.randint(1, longest)
        ids = [f"{t}.{i}" for i in range(n)]
        for i in range(n):
            reply = None if i == 0 else ids[rng.randrange(i)]
            if rng.random() < 0.1:
                reply = rng.choice([None, rng.choice(ids), "elsewhere", "0.0", ids[i]])
            position = i if rng.random() > 0.05 else rng.choice([None, i + 1, -1, 0])
            author = rng.choice(["Ann", "ann", "bob", "ci[bot]", None]) if t % 4 else "Solo"
            body = rng.choice(["hi", "", None, " ​﻿", "ok"]) if t % 5 else rng.choice([None, "­ \t"])
            at = None if rng.random() < 0.03 else T0 + timedelta(minutes=rng.randrange(30))
            rows.append((f"t{t}" if t else None, ids[i] if rng.random() > 0.02 else None, reply, position, author, body, at, T0 + timedelta(days=rng.randrange(2)), "x"))
    later = [(*r[:5], "edited", r[6], T0 + timedelta(days=9), "x") for r in rows[:7] if r[1]]
    return rows + rows[10:30] + later


def brute(rows):
    best = {}
    for r in rows:
        if r[0] is None:
            continue
        key = r[1] if r[1] is not None else (r[0], *r[2:])
        if key not in best or r[7] > best[key][7]:
            best[key] = r
    threads = {}
    for r in best.values():
        threads.setdefault(r[0], []).append(r)
    drop = set()
    for t, ms in threads.items():
        at = {m[1]: m[3] for m in ms if m[1] is not None}
        bad = sorted(-1 if m[3] is None else m[3] for m in ms) != list(range(len(ms)))
        bad |= not any(m[5] and m[5].strip(" \t​﻿­") for m in ms)
        bad |= len({m[4].lower() for m in ms if m[4]}) < 2
        for m in ms:
            if m[3] == 0:
                bad |= m[2] is not None
            elif m[3] is not None:
                bad |= m[2] is None or at.get(m[2]) is None or at[m[2]] >= m[3]
        if bad:
            drop.add(t)
    return drop, threads


@pytest.mark.parametrize("in_task", [50_000, 4])
@pytest.mark.parametrize("seed", [1, 2])
def test_dropped_threads_against_brute_force(spark, seed, in_task):
    rows = rows_of(seed)
    clashing = spark.createDataFrame(rows, SCHEMA).withColumn("turn", F.lit("x")).withColumn("micros", F.lit(1))
    judged = C.reassemble(clashing, in_task)
    drop, threads = brute(rows)
    found = C.verdicts(judged).collect()
    assert {r.thread_id: r.n_messages for r in found} == {t: len(m) for t, m in threads.items()}
    assert {r.thread_id for r in found if r.defects} == drop
    assert "turn_note" in judged.columns


def test_large_threads_get_the_same_turns_and_defects(spark):
    df = spark.createDataFrame(rows_of(7, 60, 14), SCHEMA)
    as_set = lambda d: sorted(map(str, d.select("thread_id", "message_id", "position", "reply_to", "author", "turn", "defects").collect()))
    assert as_set(C.reassemble(df)) == as_set(C.reassemble(df, 3))


def test_long_chain_and_cycle_by_joins(spark):
    chain = [("t", f"m{i:04d}", f"m{i - 1:04d}" if i else None, i, "ab"[i % 2], "x", T0 + timedelta(seconds=i), T0, "") for i in range(300)]
    ring = [("r", f"c{i}", f"c{(i + 1) % 5}", i, "ab"[i % 2], "x", T0, T0, "") for i in range(5)] + [("r", "tail", "c0", 5, "a", "x", T0, T0, "")]
    for limit in (2, 50_000):
        out = C.reassemble(spark.createDataFrame(chain + ring, SCHEMA), limit)
        assert [r.turn for r in out.filter("thread_id = 't'").orderBy("position").collect()] == list(range(300))
        assert all(r.turn is None for r in out.filter("thread_id = 'r'").collect())
        verdict = {r.thread_id: r.defects for r in C.verdicts(out).collect()}
        assert verdict["t"] == [] and "cycle" in verdict["r"]


def test_time_orders_siblings_but_never_before_the_parent(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [("t", "a", None, 0, "x", "1", at(10), T0, ""), ("t", "b", "a", 1, "y", "2", at(3), T0, ""), ("t", "c", "a", 2, "x", "3", at(12), T0, ""), ("t", "d", "b", 3, "y", "4", at(11), T0, "")]
    for limit in (50_000, 1):
        out = C.reassemble(spark.createDataFrame(rows, SCHEMA), limit).orderBy("turn").collect()
        assert [r.message_id for r in out] == ["a", "b", "d", "c"]


def test_empty_and_very_long(spark):
    assert C.reassemble(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [("t", "a", None, 0, "x", " " * 2_000_000, T0, T0, ""), ("t", "b", "a", 1, "y", None, T0, T0, "")]
    assert C.verdicts(C.reassemble(spark.createDataFrame(rows, SCHEMA))).first().defects == ["no_text"]


def test_roles(spark):
    rows = [("t", "a", None, 0, "Ann", "1", T0, T0, "p"), ("t", "b", "a", 1, "bob", "2", T0, T0, "p"), ("t", "c", "a", 2, "ci[bot]", "3", T0, T0, "p"), ("t", "d", "a", 3, None, "3", T0, T0, "q")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("author_typename", F.lit("User"))
    owners = spark.createDataFrame([("p", "ANN")], "turn_note string, owner string")
    roles = {r.message_id: r.role for r in C.with_roles(C.reassemble(df), owners, "turn_note").collect()}
    assert roles == {"a": "author", "b": "reviewer", "c": "bot", "d": None}
