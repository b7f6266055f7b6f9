import random

import pytest

from strataloom.llm import residue as R

RESIDUE = {
    "slot": ["{{title}}", "${pageTitle} - Acme", "%PAGE_TITLE%", "Acme - %s", "Welcome to [Company Name]", "undefined | Acme", "null - Docs", "NaN results for undefined", "i18n.pages.home.title", "{{ t('home.title') }}", "Page {0} of {1}", "&lt;Untitled&gt;", "[object Object]"],
    "filler": ["Lorem ipsum dolor sit", "xxx xxx xxx", "TODO: add description", "Coming soon coming soon", "Just another Acme site", "Blindtext Blindtext Blindtext", "Your description goes here.", "Untitled document", "Texto de relleno (Acme)"],
    "error": ["404 Not Found", "» Page not found - Acme docs", "Hm, nothing here – Acme", "ACCESS DENIED...", "Seite nicht gefunden", "Traceback (most recent call last): KeyError 'abc'", "Fatal error: call to undefined function f()", "Something went wrong. Please try again later.", "Request blocked. Reference #0c7d4f5ee1"],
    "script": ["Just a moment...", "Please enable JavaScript to continue", "Checking your browser before you go on to Acme", "Activa JavaScript para ver esta página", "Verify you are human - Acme"],
}
ORDINARY = [
    "Handling 404 errors in billing - Acme", "How to enable JavaScript source maps", "Use ${variable} or {{ variable }} to put the name into a message.", "Template syntax: using {{ name }} in messages", 'Why do I see "Access denied"? - Acme help', "500 cohorts and more", "Undefined properties in events", "Untitled dashboards: renaming the key",
    "Acme", "Acme docs", "", "  ", "Something went wrong with the import? This checklist helps you find out what.", "Maintenance mode for the queue", "JavaScript SDK - Docs - Acme", "Placeholders in messages", "What's new in exports 1.2.3", "docs.acme.example",
]
HOST = "docs.acme.example"


def direct(text, host=HOST):
    b = R.bare(text, host)
    return ("slot" if R.unresolved_slot(b) else R.message(b)) if b else None


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in RESIDUE.items() for t in ts])
def test_residue(kind, text):
    assert direct(text) == kind


@pytest.mark.parametrize("text", ORDINARY)
def test_ordinary(text):
    assert direct(text) is None


def test_operator_equals_judging_each_text(spark):
    rng = random.Random(3)
    texts = [t for ts in RESIDUE.values() for t in ts] + ORDINARY + [None] + [f"Guide to the {rng.choice('abcdefg')}{i % 7} page" for i in range(60)] + [f"Page {w} found" for w in ("not", "was", "is", "never")]
    rows = [(f"u{i}", rng.choice(texts), rng.choice(texts), rng.choice([HOST, None]), "x") for i in range(300)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "url string, title string, description string, host string, residue string")
    got = {(r.url, r.field, r.residue) for r in R.find_residue(df, "url", "host", ["title", "description"]).collect()}
    want = {(u, f, direct(x, h)) for u, t, d, h, _ in rows for f, x in (("title", t), ("description", d)) if x and direct(x, h)}
    assert got == want
    kept = R.without_residue(df, "url", "host", ["title", "description"])
    assert kept.columns == df.columns
    assert sorted(r.url for r in kept.collect()) == sorted(r[0] for r in rows if r[0] not in {u for u, _, _ in want})


def test_empty_null_key_and_very_long(spark):
    schema = "url string, title string, host string"
    assert R.find_residue(spark.createDataFrame([], schema), "url", "host", ["title"]).collect() == []
    rows = [(None, "404 Not Found", None), ("a", " ".join(f"w{chr(97 + i % 26)}x page not" for i in range(50_000)), None), ("c", "page " + "the site " * 60_000 + "is", None), ("b", "lorem ipsum " * 20_000, "x.example")]
    got = {(r.url, r.residue) for r in R.find_residue(spark.createDataFrame(rows, schema), "url", "host", ["title"]).collect()}
    assert got == {(None, "error"), ("b", "filler")}
    assert R.without_residue(spark.createDataFrame(rows, schema), "url", "host", ["title"]).count() == 3


def test_templates_cover_their_texts_and_depend_on_no_order(spark):
    rng = random.Random(5)
    texts = sorted({f"fatal error in module {rng.choice('abcdefgh')}{i}" for i in range(60)} | {f"guide to {rng.choice(['queues', 'alerts'])} part {rng.choice('xyz')}" for _ in range(60)} | {"own words only here", "w " * 300})
    plain = {}
    for t in texts:
        parts = R.tokens(t)
        alike = [R.tokens(o) for o in texts if R.leaf(R.tokens(o)) == R.leaf(parts)]
        plain[t] = parts if len(parts) > R.MINED else [p if sum(o[i] == p for o in alike) >= R.SHARED else R.HOLE for i, p in enumerate(parts)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for part in (1, 7):
        assert {r.text: r.template for r in R.mine_templates(df.repartition(part)).collect()} == plain
    assert plain[next(t for t in texts if t.startswith("fatal"))] == ["fatal", "error", "in", "module", R.HOLE]


def test_a_leaf_with_all_the_texts(spark):
    """Different titles of one leaf are counted, not compared with each other."""
    df = spark.range(60_000).selectExpr("concat('u', id) AS url", "concat('the page w', conv(id, 10, 26), 'x') AS title", "'h.example' AS host")
    rows = R.template_table(df, "url", "host", ["title"]).collect()
    assert [(r.template, r.n_texts, r.n_hosts, r.n_keys) for r in rows] == [(f"the page {R.HOLE}", 60_000, 1, 60_000)]
