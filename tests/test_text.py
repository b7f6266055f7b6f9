import pytest
from pyspark.sql import functions as F

from strataloom.functions import ids as I
from strataloom.functions import text as X


def one(spark, expr, *values, schema="t string, u string"):
    row = (*values, *[None] * (2 - len(values)))
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "title,status,prefix,scope,subject,confidence,breaking,squash",
    [
        ("feat(api): add x (#12)", "strict", "feat", "api", "add x", 0.98, False, 12),
        ("Fix: y", "loose", "fix", None, "y", 0.9, False, None),
        ("bugfix!: z", "alias", "fix", None, "z", 0.8, True, None),
        ("[wip] docs: a", "strict", "docs", None, "a", 0.98, False, None),
        ("what: b", "unknown_type", None, None, "b", 0.35, False, None),
        ("fix(a%b): c", "strict", "fix", "a%b", "c", 0.88, False, None),
        ("fix:", "strict", "fix", None, None, 0.68, False, None),
        ("plain words", "not_conventional", None, None, "plain words", 0.0, False, None),
        ("trunk-merge/pr-1/x", "not_a_human_title", None, None, "trunk-merge/pr-1/x", 0.0, False, None),
        ("", "not_conventional", None, None, None, 0.0, False, None),
        (None, "not_conventional", None, None, None, 0.0, False, None),
    ],
)
def test_titles(spark, title, status, prefix, scope, subject, confidence, breaking, squash):
    t = one(spark, X.parse_title(F.col("t")), title)
    assert (t.parser_status, t.prefix_normalized, t.scope, t.subject, t.breaking, t.squash_number) == (status, prefix, scope, subject, breaking, squash)
    assert t.confidence == pytest.approx(confidence)


def test_title_classes_and_footer(spark):
    assert one(spark, X.parse_title(F.col("t")), "Bump a from 1 to 2").title_class == "dependency_bump"
    assert one(spark, X.parse_title(F.col("t")), 'Revert "x"').title_class == "revert"
    assert one(spark, X.parse_title(F.col("t"), F.col("u")), "feat: x", "a\nBREAKING CHANGE: b").breaking


def test_references(spark):
    got = one(spark, X.references(F.col("t")), "fixes #12, see #345 and a#9 path/#77 GH-88; closes: GH-12 #345 #7")
    assert {(r.value, r.subtype) for r in got} == {(12, "closing"), (345, "mention"), (88, "mention")}
    assert one(spark, X.references(F.col("t")), None) == []


def test_urls_phrases_flags(spark):
    got = one(spark, X.urls(F.col("t"), "own.example"), "see https://a.example/docs/x. and https://own.example/b https://a.example/docs/x https://b.example/q")
    assert [(u.url, u.kind) for u in got] == [("https://a.example/docs/x", "docs"), ("https://b.example/q", "external")]
    assert one(spark, X.edge_phrases(F.col("t")), "A follow-up that replaces the revert") == ["follow_up", "reverts", "supersedes"]
    flags = one(spark, X.feature_flags(F.col("t")), "if FEATURE_FLAGS.NEW_NAV and isFeatureEnabled('old-nav')")
    assert [(f.key, f.detection) for f in flags] == [("NEW_NAV", "constant"), ("old-nav", "call")]
    registry = one(spark, X.flag_registry(F.col("t")), "  NEW_NAV: 'new-nav', // owner: #team-x\n OLD: 'old'")
    assert [(r.constant, r.key, r.owner) for r in registry] == [("NEW_NAV", "new-nav", "#team-x"), ("OLD", "old", None)]
    assert one(spark, X.diff_lines(F.col("t"), "+"), "+++ b/x\n+new\n-old\n same") == "new"


def test_comments(spark):
    def kind(body, bot=False):
        return one(spark, X.comment_substance(F.col("t"), F.lit(bot)), body)

    assert kind("```\ncode\n```") == "empty" and kind(None) == "empty" and kind("x", True) == "bot"
    assert kind("LGTM!") == "acknowledgement" and kind("nit: a very long remark about the naming of things here") == "nit"
    assert kind("why?") == "short" and kind("I think this order of calls loses the lock when it fails.") == "substantive"
    assert one(spark, X.vocabulary_terms(F.col("t"), X.SAFETY_TERMS), "This is SLOW and leaks a secret") == {"performance": ["slow"], "security": ["secret"]}


def test_tokens_sentences_redaction(spark):
    assert one(spark, X.tokenize(F.col("t"), ["the"]), "The funnel_breakdown at https://x.example `code` is ok ```x```") == ["funnel", "breakdown"]
    assert one(spark, X.named_entities(F.col("t")), "use page_cursor, PageCursor or dark-mode; ab_c") == ["page_cursor", "pagecursor", "dark-mode"]
    assert one(spark, X.sentences(F.col("t")), "# Head\nOne. Two [x](y)? `c`") == ["Head One.", "Two x?", "c"]
    assert one(spark, X.redact(F.col("t")), "a@b.example gh" + "p_" + "a" * 24) == "[redacted-email] [redacted-token]"
    assert one(spark, X.html_title(F.col("t")), "<html><TITLE lang='x'>\n a  b </TITLE>") == "a b"
    assert one(spark, X.trailers(F.col("t")), "x\n\nSigned-off-by: A B\nCo-authored-by: C <c@d>")[1].value == "C <c@d>"
    assert one(spark, X.span(F.col("t"), "#12"), "a\nb #12 c") == "a b #12 c" and one(spark, X.span(F.col("t"), "#13"), "a") is None
    assert one(spark, X.looks_generated(F.col("t"), ["@generated"]), "// @Generated") is True
    p = one(spark, X.bounded_patch(F.col("t"), F.lit(3), 10, 2), "abc")
    assert (p.patch, p.skipped, p.truncated) == ("ab", None, True)
    assert one(spark, X.first_mode(F.array(*[F.lit(x) for x in "bbaac"]), 4)) == "a"


def test_paths(spark):
    assert one(spark, X.normalize_path(F.col("t")), "././/a/b.py") == "a/b.py"
    assert one(spark, X.module_name(F.col("t")), "a/b/__init__.py") == "a.b"
    assert one(spark, X.test_stem(F.col("t")), "a/test_b.py") == "b" and one(spark, X.production_stem(F.col("t")), "a/b.py") == "b"
    assert one(spark, X.production_stem(F.col("t")), "a/b.test.ts") is None


def test_ids(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert one(spark, I.actor_id(F.col("t"), F.col("u"), F.lit(None).cast("string")), " Bob ") == "github/user/bob"
    assert one(spark, I.actor_id(F.lit(None).cast("string"), F.col("t"), F.col("u")), " A@B ", "x") == "git/email/" + sha("a@b")[:16]
    assert one(spark, I.actor_id(F.lit(None).cast("string"), F.col("t"), F.col("u"))) == "unknown/actor"
    assert one(spark, I.edge_id(F.lit("k"), F.col("t"), F.col("u")), "a", "b") == "edge/k/" + sha("k|a|b")[:20]
    assert one(spark, I.group_id("r", F.array(F.lit(9), F.lit(3), F.lit(9)))) == "r#episode/3-" + sha("3,9")[:12]
    assert one(spark, I.iso(I.instant(F.col("t"))), "2025-01-02T03:04:05Z") == "2025-01-02T03:04:05Z" and one(spark, I.instant(F.col("t")), "nonsense") is None
    assert one(spark, I.slug(F.col("t")), "  Ä Bc--D ") == "bc-d" and one(spark, I.slug(F.col("t"))) == "item"
    df = spark.createDataFrame([(1, "A b"), (2, "a-b"), (3, "c")], "id int, t string")
    assert {r.id: r.slug for r in I.unique_slugs(df, "t", "id").collect()} == {1: "a-b", 2: "a-b-2", 3: "c"}
    assert one(spark, I.host_allowed(F.col("t"), ["a.example"]), "https://x.a.example/p") is True
    assert one(spark, I.host_allowed(F.col("t"), ["a.example"]), "http://a.example") is False and one(spark, I.host_allowed(F.col("t"), ["a.example"])) is False
