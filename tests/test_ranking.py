import itertools
import random

import numpy as np
import pytest

from strataloom.operators import ranking as K

CRITERIA = {"x": 0.5, "y": 0.3, "z": 0.2}


def values(seed, n=6, unknown=0.2):
    rng = random.Random(seed)
    return [(f"a{i}", c, None if rng.random() < unknown else round(rng.random() * 4, 2)) for i in range(n) for c in CRITERIA]


def frame(spark, rows):
    return spark.createDataFrame(rows, "alternative string, criterion string, value double")


def weights(spark):
    return spark.createDataFrame(list(CRITERIA.items()), "criterion string, weight double")


def plain_electre(rows, q=0.0, p=1.0, v=3.0):
    known = {}
    for a, c, x in rows:
        known.setdefault(a, {})[c] = x
    out = {}
    for a, b in itertools.permutations(known, 2):
        cs, ds, ws = [], [], []
        for c, w in CRITERIA.items():
            ga, gb = known[a][c], known[b][c]
            if ga is None or gb is None:
                continue
            gap = gb - ga
            cs.append(w * (1 if gap <= q else 0 if gap >= p else round((p - gap) / (p - q), 6)))
            ds.append(0 if gap <= p else 1 if gap >= v else round((gap - p) / (v - p), 6))
            ws.append(w)
        if not ws:
            out[a, b] = None
            continue
        big = sum(cs) / sum(ws)
        cred = big
        for d in ds:
            if d > big and big < 1:
                cred *= (1 - d) / (1 - big)
            elif d >= 1:
                cred = 0.0
        out[a, b] = max(0.0, min(1.0, cred))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_electre_against_plain(spark, seed):
    rows = values(seed)
    got = {(r.a, r.b): r.credibility for r in K.electre(frame(spark, rows), weights(spark)).collect()}
    want = plain_electre(rows)
    assert {p for p in got if got[p] is None} == {p for p in want if want[p] is None}
    assert {p: x for p, x in got.items() if x is not None} == pytest.approx({p: x for p, x in want.items() if x is not None}, abs=2e-6)


def test_distillation(spark):
    cred = {("a", "b"): 1.0, ("a", "c"): 1.0, ("b", "c"): 1.0, ("b", "a"): 0.1, ("c", "a"): 0.1, ("c", "b"): 0.1}
    matrix = np.array([[cred.get((a, b), 0.0) for b in "cab"] for a in "cab"])
    assert [x.tolist() for x in K.distillations(matrix, 0.3, 0.15)] == [[2, 0, 1], [2, 0, 1]]
    assert [x.tolist() for x in K.distillations(np.zeros((2, 2)), 0.3, 0.15)] == [[0, 0], [0, 0]]
    assert [x.tolist() for x in K.distillations(np.zeros((0, 0)), 0.3, 0.15)] == [[], []]
    pairs = spark.createDataFrame([(a, b, v) for (a, b), v in cred.items()], "a string, b string, credibility double")
    got = {r.alternative: (r.down, r.up, r.tier) for r in K.electre_ranking(pairs).collect()}
    assert got == {"a": (0, 0, 1), "b": (1, 1, 2), "c": (2, 2, 3)}


@pytest.mark.parametrize("seed", [3, 4])
def test_promethee_flows(spark, seed):
    rows = values(seed)
    flows = {r.alternative: r for r in K.promethee(frame(spark, rows), weights(spark)).collect()}
    assert sum(r.phi for r in flows.values()) == pytest.approx(0, abs=1e-5)
    assert all(r.phi == pytest.approx(r.phi_plus - r.phi_minus, abs=2e-6) for r in flows.values())
    known = {}
    for a, c, x in rows:
        known.setdefault(a, {})[c] = x
    for a in known:
        plus = []
        for b in known:
            if a != b:
                both = [c for c in CRITERIA if known[a][c] is not None and known[b][c] is not None]
                plus.append(sum(CRITERIA[c] * max(0, min(1, known[a][c] - known[b][c])) for c in both) / sum(CRITERIA[c] for c in both) if both else 0.0)
        assert flows[a].phi_plus == pytest.approx(sum(plus) / len(plus), abs=1e-6)
    df = K.promethee(frame(spark, rows), weights(spark))
    flat = {r.alternative: r.position for r in K.promethee_intervals(df, 0.0).collect()}
    for a, b in itertools.permutations(flows, 2):
        assert (flat[a] < flat[b]) == (flows[a].phi > flows[b].phi)
    wide = {r.alternative: r.position for r in K.promethee_intervals(df, 50.0).collect()}
    assert max(wide.values()) <= max(flat.values())


def test_trials_in_one_job_equal_single_runs(spark):
    rows = values(5, unknown=0)
    drawn = K.dirichlet_weights(weights(spark), 3)
    w = drawn.collect()
    assert all(sum(r.weight for r in w if r.trial == t) == pytest.approx(1) for t in range(3))
    trials = spark.createDataFrame([(t, *r) for t in range(3) for r in rows], "trial long, alternative string, criterion string, value double")
    together = {(r.trial, r.alternative): r.phi for r in K.promethee(trials, drawn, by=["trial"]).collect()}
    for t in range(3):
        alone = K.promethee(frame(spark, rows), drawn.filter(f"trial = {t}").drop("trial")).collect()
        assert all(together[t, r.alternative] == pytest.approx(r.phi, abs=1e-6) for r in alone)


def test_bootstrap_draws_as_many_as_there_are(spark):
    df = spark.createDataFrame([("o", i) for i in range(20)] + [("p", 99)], "o string, k int")
    rows = K.bootstrap(df, "o", "k", 5).collect()
    for t in range(5):
        assert sum(r.copies for r in rows if r.trial == t and r.o == "o") == 20
        assert [r.copies for r in rows if r.trial == t and r.o == "p"] == [1]
    assert sorted(map(tuple, K.bootstrap(df.repartition(3), "o", "k", 5).collect())) == sorted(map(tuple, rows))


def test_agreement(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(4), rng.randrange(4)) for i in range(50)] + [(99, None, 1)]
    df = spark.createDataFrame(rows, "subject int, a int, b int")
    pairs = [(a, b) for _, a, b in rows if a is not None]
    n, d = len(pairs), 3
    w = lambda a, b: 1 - ((a - b) / d) ** 2
    o = sum(w(a, b) for a, b in pairs) / n
    e = sum(w(a, b) for a, _ in pairs for _, b in pairs) / n / n
    r = K.cohen_kappa(df).first()
    assert (r.n, r.kappa) == (n, pytest.approx((o - e) / (1 - e), abs=1e-6))
    assert K.cohen_kappa(spark.createDataFrame([(1, 2, 2), (2, 2, 2)], "subject int, a int, b int")).first().kappa is None
    long = [(i % 15, rng.randrange(5)) for i in range(40)] + [(77, 3)]
    groups = {}
    for s, v in long:
        groups.setdefault(s, []).append(v)
    usable = [v for v in groups.values() if len(v) > 1]
    inner = [(x - y) ** 2 for v in usable for x, y in itertools.combinations(v, 2)]
    outer = [(x - y) ** 2 for x, y in itertools.combinations([x for v in usable for x in v], 2)]
    alpha = 1 - (sum(inner) / len(inner)) / (sum(outer) / len(outer))
    assert K.krippendorff_alpha(spark.createDataFrame(long, "subject int, value int")).first().alpha == pytest.approx(alpha, abs=1e-6)
    two = spark.createDataFrame([("a", 1, 2), ("b", 2, 1), ("c", 3, 3)], "item string, x int, y int")
    assert K.kendall_tau(two).first().tau == pytest.approx(1 / 3, abs=1e-6)
    assert K.top_overlap(two, 2).first().overlap == 1.0


def test_pool_and_stability(spark):
    df = frame(spark, [(f"a{i}", "x", float(i)) for i in range(5)])
    assert {r.alternative for r in K.candidate_pool(df, weights(spark), 2).collect()} == {"a4", "a3"}
    parts = {n: spark.createDataFrame(rows, "alternative string, top_share double") for n, rows in {"u": [("a", 0.5), ("b", 1.0)], "v": [("a", 0.1)]}.items()}
    assert {tuple(r) for r in K.combine_stability(parts).collect()} == {("a", 0.1, 0.3, 2), ("b", 1.0, 1.0, 1)}
