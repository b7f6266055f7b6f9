import math
import random
import re
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strataloom.functions import numbers as N
from strataloom.operators import aggregates as A
from strataloom.operators import pairs as P
from strataloom.operators import rules as R

T0 = datetime(2025, 1, 1, tzinfo=UTC)


@pytest.mark.parametrize(
    "glob,path,hit",
    [
        ("a/*.py", "a/b.py", True), ("a/*.py", "a/c/b.py", False), ("**/b.py", "b.py", True), ("**/b.py", "x/y/b.py", True), ("a/**", "a", True), ("a/**", "a/b/c", True), ("a/**", "ab", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("[ab].x", "b.x", True), ("a.b", "axb", False), ("a/**/c", "a/c", True), ("a/**/c", "a/b/c", True), ("*", "a/b", False), ("a[", "a[", True),
    ],
)
def test_globs(glob, path, hit):
    assert bool(re.match(R.glob_pattern(glob), path)) is hit


def test_rules_first_last_longest_and_candidates(spark):
    paths = spark.createDataFrame([("a/b/c.py",), ("a/x.md",), (None,), ("z",), ("z",)], "path string")
    rules = spark.createDataFrame([(1, "^a/.*$", "a"), (2, r".*\.py$", "py")], "rule_order int, pattern string, rule_name string")
    pick = lambda last: sorted((r.path or "", r.rule_name) for r in R.match_rules(paths, "path", rules, last).collect())
    assert pick(False) == [("", None), ("a/b/c.py", "a"), ("a/x.md", "a"), ("z", None), ("z", None)]
    assert pick(True)[1] == ("a/b/c.py", "py")
    owners = spark.createDataFrame([("a", "A"), ("a/b", "B"), ("", "root")], "directory string, team string")
    got = {r.path: r.team for r in R.longest_prefix(paths, "path", owners, "directory").collect()}
    assert got == {"a/b/c.py": "B", "a/x.md": "A", None: None, "z": "root"}
    wanted = spark.createDataFrame([(1, ["p", "q"]), (2, ["x"]), (3, [])], "id int, names array<string>")
    known = spark.createDataFrame([("q",), ("p",), ("p",)], "name string")
    assert {r.id: r.name for r in R.first_found(wanted, "id", "names", known, "name").collect()} == {1: "p", 2: None, 3: None}
    labels = {r.path: r.l for r in paths.select("path", R.first_label(F.col("path"), {"md": ["**/*.md"], "a": ["a/**"]}, "none").alias("l")).collect()}
    assert labels == {"a/b/c.py": "a", "a/x.md": "md", None: "none", "z": "none"}


def test_shared_pairs_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abcdef") if rng.random() > 0.05 else None, rng.randrange(12)) for _ in range(60)] + [("hot", i) for i in range(30)]
    got = {(r.k, r.a, r.b) for r in P.shared_pairs(spark.createDataFrame(rows, "k string, m int"), "k", "m", 2, 9).collect()}
    groups = {}
    for k, m in rows:
        if k is not None:
            groups.setdefault(k, set()).add(m)
    assert got == {(k, a, b) for k, ms in groups.items() if 2 <= len(ms) <= 9 for a in ms for b in ms if a < b}


def test_later_within_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xyz"), i, T0 + timedelta(hours=rng.randrange(24 * 40))) for i in range(80)]
    df = spark.createDataFrame(rows, "p string, id int, at timestamp")
    got = {(r.first_key, r.then_key) for r in P.later_within(df, df, "p", "id", "at", 5).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and a[2] < b[2] <= a[2] + timedelta(days=5)}
    assert "BroadcastNestedLoop" not in P.later_within(df, df, "p", "id", "at", 5)._jdf.queryExecution().toString()


def test_state_at_is_as_of(spark):
    changes = spark.createDataFrame([("a", 1, "new"), ("a", 5, "gone"), ("b", 2, "new")], "p string, at int, s string")
    probes = spark.createDataFrame([("a", 0), ("a", 1), ("a", 4), ("a", 9), ("c", 3)], "p string, t int")
    got = {(r.p, r.t): r.s for r in P.state_at(changes, "p", "at", "s", probes, "t").collect()}
    assert got == {("a", 0): None, ("a", 1): "new", ("a", 4): "new", ("a", 9): "gone", ("c", 3): None}


def test_samples_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(f"s{i % 3}", i) for i in range(60)], "s string, id int")
    take = lambda d: sorted(map(tuple, P.stratified_sample(d, "s", "id", "x", 4).select("s", "id").collect()))
    assert take(df) == take(df.repartition(7)) and len(take(df)) == 12
    assert [r.s for r in P.round_robin_sample(df, "s", "id", 4).collect()] == ["s0", "s1", "s2", "s0"]


def test_independent_entries_and_both_missing(spark):
    df = spark.createDataFrame([("o", "g", 1.0, 1), ("o", "g", 3.0, 2), ("o", "h", 2.0, 3), ("o", "g", 3.0, 4)], "o string, g string, v double, k int")
    got = {r.g: (r.k, r.excluded) for r in P.independent_entries(df, "o", "g", "v", "k").collect()}
    assert got == {"g": (2, [1, 4]), "h": (3, [])}
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,), (3,)], "k int")
    assert {tuple(r) for r in P.both_missing(a, b, "k").collect()} == {(1, "left_only"), (3, "right_only")}


def test_filter_pairs_degrees_verdicts(spark):
    schema = "a int, b int, edge_type string, tier string, strength double, usable boolean, days double"
    rows = [(1, 2, "x", "A", 0.5, True, 1.0), (1, 2, "y", "B", 0.5, True, 1.0), (1, 3, "x", "A", 0.9, False, 1.0), (2, 3, "x", "C", 0.9, True, 1.0), (3, 4, "structural", "A", 0.9, True, 90.0), (4, 5, "x", "A", 0.2, True, 1.0)]
    edges = spark.createDataFrame(rows, schema)
    got = {(r.a, r.b): (r.weight, r.reason) for r in P.filter_pairs(edges, 0.5, 45).collect()}
    assert got == {(1, 2): (0.75, None), (1, 3): (0.0, "all_guarded"), (2, 3): (0.9, "tier_c_only"), (3, 4): (0.9, "far_apart"), (4, 5): (0.2, "weak")}
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "n int")
    assert {r.n: r.degree for r in P.degrees(edges, nodes, "n").collect()} == {1: 3, 2: 3, 3: 3, 4: 2, 5: 1, 6: 0}
    queue = spark.createDataFrame([("q", None), ("r", None)], "id string, verdict string")
    assert {r.id: r.verdict for r in P.keep_verdicts(queue, spark.createDataFrame([("q", "ok"), ("q", None)], "id string, verdict string"), "id").collect()} == {"q": "ok", "r": None}


def test_entropy_dominant_histogram(spark):
    rng = random.Random(3)
    rows = [(rng.choice("gh"), rng.choice(["a", "b", "c", None])) for _ in range(80)] + [("one", "z")] * 3
    df = spark.createDataFrame(rows, "g string, v string")
    for r in A.entropy(df, ["g"], "v").collect():
        c = Counter(v for g, v in rows if g == r.g and v is not None)
        n = sum(c.values())
        assert r.entropy == pytest.approx(-sum(x / n * math.log2(x / n) for x in c.values()), abs=1e-9)
    for r in A.histogram(df, ["g"], "v").collect():
        assert r.histogram == dict(Counter(v for g, v in rows if g == r.g and v is not None))
    tie = spark.createDataFrame([("g", "b"), ("g", "a")], "g string, v string")
    assert A.dominant(tie, ["g"], "v").first().v == "a"


def test_numbers(spark):
    def value(c):
        return spark.range(1).select(c.alias("x")).first().x

    at = lambda s: F.lit(s).cast("timestamp")
    assert value(N.days_between(at("2025-01-01"), at("2025-01-02 12:00:00"))) == 1.5
    assert value(N.within(at("2025-01-02"), at("2025-01-01"), at("2025-01-02"))) is False
    assert value(N.within(F.lit(None).cast("timestamp"), at("2025-01-01"), at("2025-01-02"))) is False
    assert value(N.decay(F.lit(180.0), 180.0)) == 0.5 and value(N.decay(F.lit(-1.0), 180.0)) == 1.0
    assert value(N.hub_damping(F.lit(1))) == 0.5
    assert value(N.concordance(F.lit(1.0), F.lit(1.5), 0, 1)) == 0.5 and value(N.discordance(F.lit(0.0), F.lit(2.0), 1, 3)) == 0.5
    assert value(N.differs(F.lit(100), F.lit(120), 5, 0.1)) is True and value(N.differs(F.lit(1), F.lit(5), 5, 0.1)) is False
    assert [(str(s.slice_start), str(s.slice_end)) for s in value(N.date_slices(F.lit("2025-01-01"), F.lit("2025-01-05"), 2))] == [("2025-01-01", "2025-01-02"), ("2025-01-03", "2025-01-04"), ("2025-01-05", "2025-01-05")]
    assert value(N.sorted_distinct(F.array(F.lit(3), F.lit(None), F.lit(1), F.lit(3)), 5)) == [1, 3]
    df = spark.createDataFrame([(0.5,), (0.5,), (None,), (2.0,)], "s double")
    assert df.filter("s < 1").agg(N.noisy_or(F.col("s"))).first()[0] == 0.75 and df.agg(N.noisy_or(F.col("s"))).first()[0] == 1.0


def test_ordered_weights_and_medians(spark):
    df = spark.createDataFrame([("o", 3.0, "a"), ("o", 2.0, "b"), ("o", 4.0, "c"), ("p", 1.0, "d"), ("p", None, "e")], "o string, v double, k string")
    got = {r.o: r.value for r in A.ordered_weights(df, "o", "v", "k", [1, 0.5, 0.25], 1.0, 9.0).collect()}
    assert got == {"o": 5.0, "p": 1.0}
    assert df.groupBy("o").agg(A.upper_median(F.col("v")).alias("m")).filter("o = 'o'").first().m == 3.0
    table = spark.createDataFrame([("x", 1, 5), ("x", 2, 4), ("x", 9, 1)], "a string, pos int, n long")
    r = A.frequency_summary(table, "a", "pos", "n", 2).first()
    assert (r.mean, r.median, r.p05, r.p95, r.mode, r.mode_share, r.top_share) == (2.2, 1, 1, 9, 1, 0.5, 0.9)
    assert sorted(r.scaled for r in A.rescale(df.dropna(), ["o"], "v", 3.0).collect()) == pytest.approx([2 / 3, 1.0, 1.0, 4 / 3])
    empty = df.limit(0)
    assert A.entropy(empty, ["o"], "k").collect() == A.ordered_weights(empty, "o", "v", "k", [1], 1, 1).collect() == []
