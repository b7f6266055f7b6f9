import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.functions import bitmaps
from strataloom.operators import reconcile


@given(st.lists(st.booleans(), max_size=300), st.lists(st.booleans(), max_size=300))
@settings(max_examples=60, deadline=None)
def test_bitmaps_round_trip_and_algebra(a, b):
    n = max(len(a), len(b), 1)
    x, y = (np.array(v + [False] * (n - len(v)), dtype=bool) for v in (a, b))
    p, q = bitmaps.pack(x), bitmaps.pack(y)
    assert (bitmaps.unpack(p, n) == x).all()
    assert bitmaps.and_not(p, q, n).tolist() == np.flatnonzero(x & ~y).tolist()
    shared = bitmaps.both(p, q, n)
    assert shared.tolist() == np.flatnonzero(x & y).tolist()
    assert bitmaps.ranks(p, shared).tolist() == [int(x[:i].sum()) for i in shared]


def test_full_and_empty_blocks_are_small():
    assert len(bitmaps.pack(np.ones(32768, bool))) == 5
    assert len(bitmaps.pack(np.zeros(32768, bool))) == 1


@pytest.mark.parametrize(
    "text,number",
    [("216", 216), ("148.0", 148), ("1,653", 1653), ("-14", -14), (" 7 ", 7), ("1e3", 1000), ("", None), ("n/a", None), ("-", None), ("null", None), (None, None), ("1.5", None), ("12 345", 12345), ("1,2", None), ("-1.0", -1), ("+4", 4), ("0", 0)],
)
def test_whole_number(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(reconcile.whole_number(F.col("t"))).first()[0] == number


def brute(left, right):
    out = set()
    for k in left.keys() | right.keys():
        if k is None:
            continue
        if k not in left:
            out.add((k, "row_missing_left"))
        elif k not in right:
            out.add((k, "row_missing_right"))
        else:
            out |= {(k, f) for f, x, y in zip("ab", left[k], right[k], strict=True) if x != y}
    return out


@pytest.mark.parametrize("block", [3, 32768])
def test_compare_copies_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(reconcile, "BLOCK", block)
    rng = random.Random(5)
    value = lambda: rng.choice([None, 0, 1, 2])
    left = {k: (value(), value()) for k in rng.sample(range(60), 40)}
    right = {k: (value(), value()) for k in rng.sample(range(60), 40)}
    rows = lambda d: [(k, *v, "x") for k, v in d.items()] * 2
    schema = "id long, a long, b long, field string"
    found = reconcile.compare_copies(spark.createDataFrame(rows(left), schema), spark.createDataFrame(rows(right), schema), "id", ["a", "b"])
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(left, right)


def test_empty_copies_and_null_keys(spark):
    schema = "id string, a string"
    some = spark.createDataFrame([("x", None), (None, "1")], schema)
    none = spark.createDataFrame([], schema)
    assert [tuple(r) for r in reconcile.compare_copies(some, none, "id", ["a"]).collect()] == [("x", "row_missing_right")]
    assert [tuple(r) for r in reconcile.compare_copies(none, some, "id", ["a"]).collect()] == [("x", "row_missing_left")]
    assert reconcile.compare_copies(none, none, "id", ["a"]).collect() == []
    assert reconcile.compare_copies(some, some, "id", ["a"]).collect() == []


def test_latest_prefers_late_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 4), (2, None, 9), (2, 0, None), (3, 1, 7), (3, 1, 8)], "k long, at long, v long")
    assert {tuple(r) for r in reconcile.latest(df, "k", "at", ["v"]).collect()} == {(1, 4), (2, None), (3, 8)}
