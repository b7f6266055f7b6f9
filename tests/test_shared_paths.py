import random
from datetime import UTC, datetime, timedelta
from itertools import combinations

import pytest

from strataloom.operators import graph as G
from strataloom.operators import pairs as P
from strataloom.plans import files, graphs


def put(spark, folder, orders, lines, n_parts=100):
    """orders: {key: (priority, day)}; lines: [(order, part, status, quantity)]."""
    at = lambda d: datetime(2025, 1, 1, tzinfo=UTC) + timedelta(days=d)
    tables = {
        "lineitem": spark.createDataFrame([(o, p, 1, s, float(q)) for o, p, s, q in lines], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_quantity double"),
        "part": spark.createDataFrame([(i, "Brand#1", "SMALL") for i in range(1, n_parts + 1)], "p_partkey bigint, p_brand string, p_type string"),
        "orders": spark.createDataFrame([(k, 1, at(d), p) for k, (p, d) in orders.items()], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_cooccurrence_has_the_guard_of_40(spark, tmp_path):
    lines = [(o, 1, "N", 1) for o in range(40)] + [(o, 2, "N", 1) for o in range(100, 141)] + [(o, 3, "R", 50) for o in range(5)]
    got = {(r.a, r.b): r for r in files.cooccurrence_guarded(spark, put(spark, tmp_path, {}, lines)).collect()}
    assert set(got) == set(combinations(range(40), 2))
    assert got[0, 1].n_edges == 2 and got[0, 1].strength == pytest.approx(1 - (1 - 1 / 40) * (1 - 1 / 5), abs=1e-6) and got[0, 39].strength == pytest.approx(1 / 40)


def test_graphs_take_every_status_and_size_of_change(spark, tmp_path):
    lines = [(o, 1, "N", 1) for o in range(30)] + [(o, 2, "A", 2) for o in (40, 41)] + [(o, 3, "R", 50) for o in range(100, 141)]
    d = put(spark, tmp_path, {}, lines)
    assert {(r.node, r.component) for r in graphs.components(spark, d).collect()} == {(o, 0) for o in range(30)} | {(40, 40), (41, 40)}
    assert {(r.component, r.n_changes, r.last_change) for r in graphs.episodes(spark, d).collect()} == {(0, 30, 29), (40, 2, 41)}
    assert {(r.node, r.community) for r in graphs.louvain_communities(spark, d).collect()} == {(o, 0) for o in range(30)} | {(40, 40), (41, 40)}
    sizes = {r.community: (r.n_nodes, r.n_edges) for r in graphs.community_confidence(spark, d).collect()}
    assert sizes == {o: (1, 0) for o in range(30)} | {40: (2, 1)}


def test_inner_pairs_are_those_of_one_group(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(rng.randrange(25), rng.randrange(40)) for _ in range(160)], "k int, m int")
    groups = spark.createDataFrame([(m, m % 5) for m in range(40)], "m int, g int")
    got = [(r.k, r.a, r.b, r.fan_out) for r in P.inner_pairs(rows, "k", "m", groups, "g", 2, 6).collect()]
    want = {(r.k, r.a, r.b, r.fan_out) for r in P.shared_pairs(rows, "k", "m", 2, 6).collect() if r.a % 5 == r.b % 5}
    assert len(got) == len(want) and set(got) == want


def test_stars_connect_what_pairs_connect(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(rng.randrange(60), rng.randrange(80)) for _ in range(200)], "k int, m int")
    connected = lambda links: {(r.node, r.component) for r in G.connected_components(links, "a", "b").collect()}
    assert connected(P.shared_stars(rows, "k", "m", 2, 4)) == connected(P.shared_pairs(rows, "k", "m", 2, 4))


def test_propagation_walks_three_steps_from_all_paths_of_a_fix(spark, tmp_path):
    orders = {1: ("1-URGENT", 0), 2: ("5-LOW", 1), 3: ("5-LOW", 2), 4: ("5-LOW", 3), 5: ("1-URGENT", 0), 6: ("5-LOW", 1)}
    lines = [(1, 5, "A", 1), (2, 10, "N", 1), (3, 20, "N", 1), (4, 40, "N", 1), (5, 7, "N", 1), (6, 14, "N", 1)]
    got = {(r.group, r.depth): (r.n_events, r.weight) for r in graphs.propagation(spark, put(spark, tmp_path, orders, lines)).collect()}
    assert got == {(1, 1): (1, 0.5), (1, 2): (1, 0.25), (1, 3): (1, 0.125), (5, 1): (1, 0.225)}


def test_propagation_by_slices_is_the_same(spark, tmp_path, monkeypatch):
    orders = {1: ("1-URGENT", 0), 2: ("5-LOW", 1), 5: ("1-URGENT", 0), 6: ("5-LOW", 1)}
    d = put(spark, tmp_path, orders, [(1, 5, "A", 1), (2, 10, "N", 1), (5, 7, "N", 1), (6, 14, "N", 1)])
    monkeypatch.setattr(graphs, "SLICE_STEPS", 2)
    assert {(r.group, r.depth, r.n_events, r.weight) for r in graphs.propagation(spark, d).collect()} == {(1, 1, 1, 0.5), (5, 1, 1, 0.225)}


def test_propagation_over_arrays_and_joins_is_the_same(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    orders = {k: (rng.choice(["1-URGENT", "5-LOW"]), rng.randrange(90)) for k in range(60)}
    d = put(spark, tmp_path, orders, [(k, rng.randrange(1, 45), rng.choice("AN"), 1) for k in orders for _ in range(3)], 40)
    rows = lambda: sorted((r.group, r.depth, r.n_events, round(r.weight, 9)) for r in graphs.propagation(spark, d).collect())
    arrays = rows()
    monkeypatch.setattr(graphs.C, "ARRAY_BYTES", 0)
    monkeypatch.setattr(graphs, "SLICE_STEPS", 500)
    assert arrays == rows() and {d for _, d, _, _ in arrays} == {1, 2, 3}
