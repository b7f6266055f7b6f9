import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import communities as C
from strataloom.operators import graph as G
from strataloom.operators import similarity as S
from strataloom.operators.identity import mail_clusters

T0 = datetime(2025, 1, 1, tzinfo=UTC)


def plain_components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)] + [(200, 200)]
    rows = edges + [(None, 3), (5, None)]
    got = {r.node: r.component for r in G.connected_components(spark.createDataFrame(rows, "src int, dst int")).collect()}
    assert got == plain_components(edges)


def test_components_of_a_star_and_of_nothing(spark):
    star = [(0, i) for i in range(1, 400)]
    got = G.connected_components(spark.createDataFrame(star, "src int, dst int")).collect()
    assert len(got) == 400 and all(r.component == 0 for r in got)
    assert G.connected_components(spark.createDataFrame([], "src int, dst int")).collect() == []


def test_reach_fan_and_hubs(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(20), rng.randrange(20)) for _ in range(50)}
    df = spark.createDataFrame(list(edges) * 2, "src int, dst int")
    want = {}
    for s in range(20):
        level, seen = {s}, {s}
        for depth in (1, 2, 3):
            level = {d for a, d in edges if a in level and a != d} - seen
            seen |= level
            want.update({(s, n): depth for n in level})
    assert {(r.source, r.node): r.depth for r in G.reachable(df, 3).collect()} == want
    fans = {r.node: (r.fan_in, r.fan_out) for r in G.fan(df).collect()}
    for n, (i, o) in fans.items():
        assert i == len({a for a, b in edges if b == n and a != n}) and o == len({b for a, b in edges if a == n and b != n})
    ordered = sorted(i for i, _ in fans.values() if i)
    assert G.hub_threshold(G.fan(df), 0.8).first().threshold == ordered[min(int(len(ordered) * 0.8), len(ordered) - 1)]


def modularity(edges, member, total):
    inner = sum(2 * w for a, b, w in edges if member[a] == member[b])
    degree = {}
    for a, b, w in edges:
        for n in (a, b):
            degree[member[n]] = degree.get(member[n], 0.0) + w
    return inner / total - sum((d / total) ** 2 for d in degree.values())


#: The friendships of a karate club (Zachary 1977), a graph whose best modularity, 0.4198, is known: fixed values.
KARATE = """1-2 1-3 2-3 1-4 2-4 3-4 1-5 1-6 1-7 5-7 6-7 1-8 2-8 3-8 4-8 1-9 3-9 3-10 1-11 5-11 6-11 1-12 1-13 4-13 1-14 2-14 3-14 4-14 6-17 7-17 1-18 2-18 1-20 2-20 1-22 2-22 24-26 25-26 3-28 24-28 25-28
    3-29 24-30 27-30 2-31 9-31 1-32 25-32 26-32 29-32 3-33 9-33 15-33 16-33 19-33 21-33 23-33 24-33 30-33 31-33 32-33 9-34 10-34 14-34 15-34 16-34 19-34 20-34 21-34 23-34 24-34 27-34 28-34 29-34 30-34 31-34 32-34 33-34"""


def test_louvain_on_a_known_graph(spark):
    edges = [(*map(int, e.split("-")), 1.0) for e in KARATE.split()]
    assert len(edges) == 78
    got = {r.node: r.community for r in C.communities(spark.createDataFrame(edges, "a int, b int, weight double")).collect()}
    assert modularity(edges, got, 2.0 * len(edges)) > 0.39
    assert all(c == min(n for n in got if got[n] == c) for c in got.values())


def test_louvain_whatever_the_order_of_rows(spark):
    rng = random.Random(5)
    edges = [(a, b, round(0.5 + rng.random(), 3)) for base in range(0, 60, 10) for a in range(base, base + 10) for b in range(base, a)] + [(rng.randrange(60), rng.randrange(60), 0.05) for _ in range(60)]
    rows = [*edges, (None, 1, 1.0), (1, None, 1.0), (3, 3, 9.0), (1, 50, None), (1, 50, -2.0)]
    df = spark.createDataFrame(rows, "a int, b int, weight double")
    one = {r.node: r.community for r in C.communities(df).collect()}
    rng.shuffle(rows)
    two = {r.node: r.community for r in C.communities(spark.createDataFrame([(b, a, w) for a, b, w in rows], df.schema).repartition(5)).collect()}
    assert one == two == {n: n // 10 * 10 for n in range(60)}
    assert C.communities(df.limit(0)).collect() == []


def test_louvain_by_arrays_is_that_by_joins(spark, monkeypatch):
    rng = random.Random(12)
    groups = [(rng.randrange(12) * 10 + rng.randrange(10), rng.randrange(12)) for _ in range(260)]
    edges = [(a, b // 10 * 10 + a % 10 if rng.random() < 0.3 else a // 10 * 10 + b % 10, rng.choice([0.2, 0.5, 1.0])) for a, _ in groups for b, _ in rng.sample(groups, 3)]
    df = spark.createDataFrame(edges, "a int, b int, weight double").selectExpr("cast(a as string) AS a", "cast(b as string) AS b", "weight")
    for name, value in (("PACKED", 7), ("ROUNDS", 4), ("LEVELS", 2)):
        monkeypatch.setattr(C, name, value)
    arrays = C.communities(df)
    monkeypatch.setattr(C, "ARRAY_NODES", 0)
    joins = C.communities(df)
    assert arrays.dtypes == joins.dtypes and set(arrays.collect()) == set(joins.collect()) and arrays.select("community").distinct().count() > 1


def test_packed_links_are_summed_apart_from_loops_and_small(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.randrange(50), rng.randrange(50), rng.choice([1, 1_000_000])) for _ in range(4_000)] + [(3, 4, 2**40), (60, 60, 5)]
    packed = C._packed(spark.createDataFrame(rows, "a int, b int, w long"), 3)
    want = {}
    for a, b, w in rows:
        want[a, b] = want.get((a, b), 0) + w
    got = C._over(packed, lambda a, b, w: (a, b, w), "a int, b int, w long").collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b): r.w for r in got} == {k: w for k, w in want.items() if k[0] != k[1]}
    loops = [(int(a), int(w)) for r in packed.collect() for a, w in zip(np.frombuffer(r.loop, "i4"), np.frombuffer(r.within, "i8"), strict=True)]
    assert sorted(loops) == sorted((a, w) for (a, b), w in want.items() if a == b) and (60, 5) in loops
    many = C._packed(spark.createDataFrame([(i // 100, 100 + i % 100, 7) for i in range(10_000)], "a int, b int, w long"), 2)
    assert sum(len(x) for r in many.collect() for x in r) <= 9 * 10_000


def test_split_and_confidence(spark):
    members = spark.createDataFrame([(i, 0) for i in range(5)] + [(9, 9)], "node int, community int")
    edges = spark.createDataFrame([(0, 1, True), (1, 2, False), (2, 3, True), (3, 4, False)], "a int, b int, strong boolean")
    from pyspark.sql import functions as F

    split = {r.node: r.community for r in C.split_large(members, edges, 3, F.col("strong")).collect()}
    assert split == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 9: 9}
    conf = {r.community: (r.n_nodes, r.n_edges, r.confidence) for r in C.confidence(members, edges, F.col("strong")).collect()}
    assert conf == {0: (5, 4, 0.575), 9: (1, 0, 0.35)}


def test_propagation_respects_time_and_counts_an_event_once(spark):
    at = lambda d: T0 + timedelta(days=d)
    sources = spark.createDataFrame([("g", "p", 1.0, at(0))], "`group` string, path string, weight double, at timestamp")
    imports = spark.createDataFrame([("q", "p"), ("r", "q"), ("s", "p")], "src string, dst string")
    touches = spark.createDataFrame([("q", 1, at(2)), ("q", 2, at(-1)), ("s", 1, at(3)), ("r", 3, at(1)), ("r", 4, at(5))], "path string, event int, at timestamp")
    got = {(r.event, r.depth, r.path): r.weight for r in C.propagate(sources, imports, touches).collect()}
    assert got == {(1, 1, "q"): 0.5, (4, 2, "r"): 0.25}


def test_reach_over_arrays_is_what_the_walk_by_joins_counts(spark, monkeypatch):
    rng = random.Random(12)
    sources = spark.createDataFrame([(g, rng.randrange(40), rng.choice([1.0, 0.45]), rng.randrange(50)) for g in range(-3, 30) for _ in range(4)], "group long, path long, weight double, at long").withColumn("at", F.timestamp_seconds("at"))
    imports = spark.createDataFrame([(rng.randrange(40), rng.randrange(40)) for _ in range(90)], "src long, dst long")
    touches = spark.createDataFrame([(rng.randrange(38), rng.choice([1, -1, 2**40]) * rng.randrange(60), rng.randrange(60)) for _ in range(500)], "path long, event long, at long").withColumn("at", F.timestamp_seconds("at"))
    for most in (150, 3):
        walked = C.propagate(sources, imports, touches, most=most).groupBy("group", "depth").agg(F.count("event").alias("n_events"), F.sum("weight").alias("weight"))
        want = sorted((r.group, r.depth, r.n_events, round(r.weight, 9)) for r in walked.collect())
        for hits, rows in ((400_000, 2_000), (40, 7)):
            monkeypatch.setattr(C, "WALK_HITS", hits)
            monkeypatch.setattr(C, "WALK_SOURCES", rows)
            got = C.reach_by_depth(sources, imports, touches, most=most)
            assert sorted((r.group, r.depth, r.n_events, round(r.weight, 9)) for r in got.collect()) == want
    assert {d for _, d, _, _ in want} == {1, 2, 3}
    monkeypatch.setattr(C, "ARRAY_BYTES", 10)
    assert C.reach_by_depth(sources, imports, touches) is None


def test_cosine_pairs_against_brute_force(spark):
    rng = random.Random(7)
    docs = {i: [rng.choice("abcdefghij") for _ in range(8)] for i in range(30)}
    docs[30] = docs[0]
    tokens = spark.createDataFrame([(i, t) for i, ts in docs.items() for t in ts], "id int, token string")
    w = S.tfidf(tokens, "id", max_share=0.9)
    vec = {}
    for r in w.collect():
        vec.setdefault(r.id, {})[r.token] = r.weight
    assert all(sum(x * x for x in v.values()) == pytest.approx(1) for v in vec.values())
    cos = lambda a, b: sum(x * vec[b].get(t, 0) for t, x in vec[a].items())
    want = {(a, b) for a in vec for b in vec if a < b and cos(a, b) >= 0.8}
    assert {(r.a, r.b) for r in S.cosine_pairs(w, "id", 0.8).collect()} == want and (0, 30) in want


def test_cosine_pairs_of_families_that_share_only_common_words(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(13)]
    docs = {i: rng.sample(words, 10) for i in range(620)} | {1000 + i: rng.sample(words, 2) + [f"own{i % 90}", f"more{i % 70}"] for i in range(180)}
    w = S.tfidf(spark.createDataFrame([(i, t) for i, ts in docs.items() for t in ts], "id int, token string"), "id", max_share=0.9)
    rows = w.collect()
    assert min(r.df for r in rows if r.token in words) > 400
    ids, names = sorted(docs), sorted({r.token for r in rows})
    m = np.zeros((len(ids), len(names)))
    for r in rows:
        m[ids.index(r.id), names.index(r.token)] = r.weight
    cos = np.triu(np.round(m @ m.T, 6), 1)
    want = {(ids[i], ids[j]): cos[i, j] for i, j in zip(*np.nonzero(cos >= 0.8), strict=True)}
    assert len(want) > 10_000
    for block in (64, 2_000):
        got = {(r.a, r.b): r.similarity for r in S.cosine_pairs(w, "id", 0.8, block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 2e-6 for p in want)


def test_cosine_pairs_by_slices_are_the_same_and_none_twice(spark, monkeypatch):
    rng = random.Random(13)
    tokens = spark.createDataFrame([(i, rng.choice("abcdefghij")) for i in range(40) for _ in range(8)], "id int, token string")
    w = S.tfidf(tokens, "id", max_share=0.9).localCheckpoint()
    want = {(r.a, r.b, r.similarity) for r in S.cosine_pairs(w, "id", 0.7).collect()}
    monkeypatch.setattr(S, "SLICE_WEIGHTS", 700)
    got = [(r.a, r.b, r.similarity) for r in S.cosine_pairs(w, "id", 0.7, block=8).collect()]
    assert len(got) == len(want) > 20 and {x[:2] for x in got} == {x[:2] for x in want}


def test_alike_documents_are_the_cosine_pairs(spark, monkeypatch):
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    docs = [(7 * i % 4_001 - 50, rng.choices(words[:13], k=12) if i % 3 else rng.sample(words, 4) * 2 + words[:1]) for i in range(400)]
    docs += [(10_000 + i, [*docs[i][1], rng.choice(words)]) for i in range(0, 150)] + [(-100, []), (-101, None), (-102, ["once"])]
    rows = lambda df: sorted((r.a, r.b, round(r.similarity, 5)) for r in df.collect())
    df = spark.createDataFrame(docs, "id int, tokens array<string>").repartition(3)
    for least in (0.6, 0.8):
        want = rows(S.cosine_pairs(S.tfidf(df.select("id", F.explode("tokens").alias("token")), "id", max_share=0.9), "id", least))
        for axes, unit in ((256, 16_384), (3, 32)):
            for name, value in {"AXES": axes, "UNIT_DOCUMENTS": unit, "COMPARED": unit // 2, "AXES_TOKENS": axes * 2}.items():
                monkeypatch.setattr(S, name, value)
            got = S.alike_documents(df, "id", "tokens", least, max_share=0.9)
            assert got.dtypes == [("a", "int"), ("b", "int"), ("similarity", "double")] and rows(got) == want
    assert len(want) > 500
    text = df.select(F.col("id").cast("string").alias("id"), "tokens")
    assert len(rows(S.alike_documents(text, "id", "tokens", 0.8, max_share=0.9))) == len(want)
    # keys that are not distinct are one document, by joins
    monkeypatch.setattr(S, "_axes", None)
    twice = df.select((F.col("id") % 300).alias("id"), "tokens")
    assert rows(S.alike_documents(twice, "id", "tokens", 0.8, max_share=0.9)) == rows(S.cosine_pairs(S.tfidf(twice.select("id", F.explode("tokens").alias("token")), "id", max_share=0.9), "id", 0.8))
    monkeypatch.undo()
    assert S.alike_documents(df.limit(0), "id", "tokens", 0.8).collect() == []


def test_nearest_and_identity(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id int, e array<double>")
    got = [(r.rank, r.id) for r in S.nearest(v, v.filter("id = 0"), "id", "e", 2).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]
    rows = [("a", "A", ["x@y"]), ("b", None, ["X@Y ", "z@y"]), ("c", None, ["z@y"]), ("d", "D", ["team@y"]), ("e", "E", ["team@y"]), ("f", None, None)]
    df = spark.createDataFrame(rows, "id string, login string, mails array<string>")
    from pyspark.sql import functions as F

    assert {r.id: r.cluster for r in mail_clusters(df, "id", F.col("mails"), "login").collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f"}
