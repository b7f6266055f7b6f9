import random
from datetime import UTC, datetime


from strataloom.operators import claims as L
from strataloom.operators import imports as M
from strataloom.operators import quality as Q


def test_contracts(spark):
    a = spark.createDataFrame([(1, "x", 5, "A"), (1, None, -1, "B"), (None, "z", None, None), (2, "gone", 50, "C")], "id int, ref string, n int, v string")
    b = spark.createDataFrame([("x",), ("z",), (None,)], "key string")
    rules = {"a": Q.Contract(required=["id"], unique=[["id"]], references={"ref": ("b", "key"), "v": ("nowhere", "k")}, not_negative=["n"], ranges={"n": (0, 10)}, values={"v": ["A", "B"]})}
    got = {(r.rule, r.subject): r.n_failed for r in Q.check({"a": a, "b": b}, rules).collect()}
    assert got == {("required", "id"): 1, ("unique", "id"): 1, ("references", "ref"): 1, ("references", "v"): 3, ("not_negative", "n"): 1, ("range", "n"): 2, ("values", "v"): 1}
    empty = {"a": a.limit(0), "b": b.limit(0)}
    assert all(r.n_failed == 0 for r in Q.check(empty, rules).collect())


def test_hashes_do_not_depend_on_order_and_tell_null_from_empty(spark):
    rows = [(i, random.Random(i).random(), None if i % 3 else "") for i in range(40)]
    df = spark.createDataFrame(rows, "a int, b double, c string")
    assert Q.content_hash(df).collect() == Q.content_hash(df.repartition(7).select("c", "b", "a")).collect()
    assert Q.exact_hash(df).first() == Q.exact_hash(df.repartition(3)).first()
    other = df.fillna("", ["c"])
    assert Q.content_hash(df).first() != Q.content_hash(other).first()
    assert Q.content_hash(df, ["c"]).first() == Q.content_hash(other, ["c"]).first()
    assert Q.content_hash(df.limit(0)).first().n_rows == 0


def test_completeness_missingness_reconciliation_secrets(spark):
    df = spark.createDataFrame([(datetime(2025, 1, 5, tzinfo=UTC), 1), (datetime(2025, 1, 9, tzinfo=UTC), None), (None, 2)], "at timestamp, v int")
    assert {(r.month, r.n_rows, r.has_v) for r in Q.completeness(df, "at", ["v"]).collect()} == {("2025-01", 2, 1), (None, 1, 1)}
    assert {(r.field, r.n_missing, r.share) for r in Q.missingness(df, ["at", "v"]).collect()} == {("at", 1, 0.333333), ("v", 1, 0.333333)}
    counts = spark.createDataFrame([("a", 100, 99), ("b", 100, 90), ("c", 1, None), ("d", 0, 0)], "name string, own int, independent int")
    assert {r.name: r.agrees for r in Q.reconcile_counts(counts, 0.02).collect()} == {"a": True, "b": False, "c": None, "d": None}
    stamped = spark.createDataFrame([("1",), ("1",)], "v string")
    assert Q.uniform({"t": stamped}, {"t": "v"}).first().is_uniform
    texts = spark.createDataFrame([(1, "key AKIA" + "A" * 16), (2, "none"), (3, None)], "id int, t string")
    assert [r.id for r in Q.search_secrets(texts, "id", "t", {"aws": r"AKIA[A-Z0-9]{16}"}).collect()] == [1]


def test_claims(spark):
    rows = [("k", "1", "A  b\n c.", ["x", None, "x"]), ("k", "1", "A b c.", ["x"]), ("k", "2", "none", []), ("k", "3", " ", ["x"]), ("k", "4", "d", ["y"])]
    made = L.register(spark.createDataFrame(rows, "claim_type string, subject string, sentence string, evidence array<string>"))
    got = {r.subject: (r.sentence, r.evidence, r.claim_id) for r in made.collect()}
    assert set(got) == {"1", "4"} and got["1"][:2] == ("A b c.", ["x"])
    used = spark.createDataFrame([(got["1"][2],), ("claim/none",), (None,)], "claim_id string")
    artifacts = spark.createDataFrame([("x",)], "artifact_id string")
    assert {tuple(r) for r in L.audit(made, used, artifacts).collect()} == {("dangling", "claim/none"), ("unreferenced", got["4"][2]), ("orphan_evidence", "y")}


def test_imports(spark):
    files = [
        ("pkg/__init__.py", ""), ("pkg/a.py", "from . import b\nfrom .sub.c import D as E\nimport os, pkg.b\nif TYPE_CHECKING:\n    from pkg import b\nimportlib.import_module('pkg.a')"), ("pkg/b.py", "def ("), ("pkg/sub/c.py", "from ..b import x\nfrom pkg.sub import c"),
        ("web/m.ts", "import {x} from './n'; // import 'no'\nexport * from '../web/lib'\nimport type T from \"./t\";\nconst a = require('./n'), b = import('./lib/index')\n/* import 'never' */"), ("web/n.tsx", ""), ("web/lib/index.ts", None), ("web/t.ts", ""),
    ]
    df = spark.createDataFrame(files, "path string, content string")
    found = M.extract_imports(df)
    rows = {(r.path, r.module, r.name): r for r in found.collect()}
    assert rows["pkg/b.py", None, None].error == "SyntaxError"
    assert any(r.type_only for r in rows.values() if r.path == "pkg/a.py") and rows["pkg/a.py", "pkg.a", None].dynamic
    target = {(r.path, r.module, r.name): r.target for r in M.resolve_imports(found, df).collect()}
    assert target["pkg/a.py", "", "b"] == "pkg/b.py" and target["pkg/a.py", "sub.c", "D"] == "pkg/sub/c.py" and target["pkg/a.py", "os", None] is None
    assert target["pkg/sub/c.py", "b", "x"] == "pkg/b.py" and target["pkg/sub/c.py", "pkg.sub", "c"] == "pkg/sub/c.py"
    assert target["web/m.ts", "./n", None] == "web/n.tsx" and target["web/m.ts", "../web/lib", None] == "web/lib/index.ts" and target["web/m.ts", "./t", None] == "web/t.ts"
    assert not any("no" == r.module or "never" == r.module for r in rows.values())
    assert M.jsonc('{"a": 1, // x\n "b": ["//",],}').replace(" ", "").replace("\n", "") == '{"a":1,"b":["//"]}'
    assert M.extract_imports(df.limit(0)).collect() == []
