"""Text functions as column expressions: titles, references, review comments, tokens, redaction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The type words of conventional titles, and what near misses stand for.
TITLE_TYPES = ["feat", "fix", "chore", "docs", "refactor", "test", "perf", "build", "ci", "style", "revert"]
TITLE_ALIASES = {"feature": "feat", "bugfix": "fix", "hotfix": "fix", "tests": "test", "doc": "docs", "chores": "chore", "deps": "build", "dep": "build", "release": "chore"}
# Titles that no person wrote, the first that matches holds.
TITLE_CLASSES = [
    ("merge_queue_artifact", r"^trunk-merge/pr-[0-9]+/"),
    ("dependency_bump", r"^(Bump|bump) .+ from .+ to .+$"),
    ("dependency_bump", r"(?i)^chore\(deps(-dev)?\):"),
    ("revert", r"(?i)^Revert \""),
    ("automation", r"(?i)^\[?auto(mated)?\]?[: ]"),
]
# Words around a mention of another change.
EDGE_PHRASES = {
    "follow_up": r"(?i)\bfollow[\s-]?up\b",
    "part_of": r"(?i)\b(part\s+(of|[0-9]+)|first\s+of|series)\b",
    "stacked_on": r"(?i)\b(stacked\s+(on|upon)|builds?\s+on|depends?\s+on|blocked\s+by|requires)\b",
    "reverts": r"(?i)\brevert(s|ing|ed)?\b",
    "reapplies": r"(?i)\b(re-?land|re-?apply|redo\s+of)\b",
    "supersedes": r"(?i)\b(supersede[sd]?|replaces?|obsoletes?)\b",
}
# Kinds of documents by their address.
DOCUMENT_KINDS = [("changelog", r"(?i)/changelog"), ("docs", r"(?i)/docs/"), ("handbook", r"(?i)/handbook"), ("tutorial", r"(?i)/tutorials?/"), ("blog", r"(?i)/blog/"), ("roadmap", r"(?i)/roadmap")]
# Review comments that say little, and words of risk.
ACKNOWLEDGEMENTS = [r"(?im)^(lgtm|looks good|nice|thanks|thank you|ty|ship it|approved?|\+1)\b", r"(?im)^(done|fixed|good catch|makes sense|agreed|will do|sounds good)\b", r"(?im)^[\s]*[👍🚀✅💯🎉🙌❤️➕]+[\s]*$"]
NITS = [r"(?im)^\s*(nit|nitpick|style|typo|super minor|tiny)\b", r"(?im)^\s*\[?(nit|nitpick)\]?\s*[:.-]"]
SHORT_COMMENT = 40
SAFETY_TERMS = {
    "data_loss": ["data loss", "lose data", "drop table", "truncate", "delete all", "irreversible", "destructive"],
    "migration": ["migration", "backfill", "schema change", "alter table", "downtime"],
    "security": ["security", "vulnerab", "injection", "xss", "csrf", "exploit", "sanitiz", "escape", "auth bypass", "secret", "credential"],
    "privacy": ["pii", "gdpr", "personal data", "privacy", "anonymi"],
    "performance": ["performance", "slow", "n+1", "latency", "timeout", "index", "query plan", "memory leak", "o(n"],
    "scaling": ["scale", "scaling", "throughput", "backpressure", "rate limit", "shard", "partition"],
    "breaking_change": ["breaking change", "backwards incompat", "backward incompat", "will break", "deprecat"],
    "correctness": ["this is wrong", "bug", "incorrect", "race condition", "off by one", "edge case", "null", "undefined behaviour"],
    "ux": ["ux", "confusing", "accessib", "a11y", "user will", "copy is"],
    "test_gap": ["add a test", "needs a test", "test coverage", "untested", "no test"],
}

_TITLE = r"^([A-Za-z][A-Za-z0-9_-]{1,20})(\([^()]{0,80}\))?(!)?:\s*(.*)$"


def first_match(value: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first rule (name, pattern) that is found in ``value``."""
    out = F.lit(default).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(value.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def strip(value: Column) -> Column:
    """``value`` without white space of any script at its ends."""
    return F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _group(value: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def parse_title(title: Column, body: Column | None = None) -> Column:
    """A conventional title as a struct: title_class, squash_number, tag, prefix, prefix_normalized, scope, breaking, subject, parser_status, confidence.

    NULL titles parse like empty ones.
    """
    raw = F.coalesce(title, F.lit(""))
    kind = first_match(raw, TITLE_CLASSES)
    squash = r"\s*\(#([0-9]{1,7})\)\s*$"
    number = _group(raw, squash, 1).cast("bigint")
    bare = F.trim(F.regexp_replace(F.trim(raw), squash, ""))
    tag = _group(bare, r"^\s*\[([^\]]{1,30})\]\s*.*$", 1)
    working = F.when(tag.isNotNull(), F.trim(F.regexp_extract(bare, r"^\s*\[[^\]]{1,30}\]\s*(.*)$", 1))).otherwise(bare)
    matched = working.rlike(_TITLE)
    prefix = F.when(matched, _group(working, _TITLE, 1))
    lower = F.lower(prefix)
    aliases = F.create_map(*[F.lit(x) for pair in TITLE_ALIASES.items() for x in pair])
    known, alias = lower.isin(TITLE_TYPES), aliases[lower]
    scope = F.nullif(F.trim(F.translate(F.regexp_extract(working, _TITLE, 2), "()", "")), F.lit(""))
    subject = F.nullif(F.trim(F.when(matched, F.regexp_extract(working, _TITLE, 4)).otherwise(working)), F.lit(""))
    footer = F.coalesce(body.rlike(r"(?m)^BREAKING[ -]CHANGE\s*:"), F.lit(False)) if body is not None else F.lit(False)
    breaking = footer | (matched & (F.regexp_extract(working, _TITLE, 3) == "!"))
    queue = F.coalesce(kind == "merge_queue_artifact", F.lit(False))
    status = (
        F.when(queue, "not_a_human_title").when(~matched, "not_conventional").when(known & (prefix == lower), "strict").when(known, "loose").when(alias.isNotNull(), "alias").otherwise("unknown_type")
    )
    points = F.when(known, 0.98).when(alias.isNotNull(), 0.8).otherwise(0.35) - F.when(prefix != lower, 0.08).otherwise(0.0)
    points = points - F.when(scope.isNotNull() & ~scope.rlike(r"^[A-Za-z0-9 _./,+-]{1,80}$"), 0.1).otherwise(0.0) - F.when(subject.isNull(), 0.3).otherwise(0.0)
    confidence = F.when(queue | ~matched, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), points)), 3))
    return F.struct(
        kind.alias("title_class"), number.alias("squash_number"), tag.alias("tag"), prefix.alias("prefix"), F.when(known, lower).otherwise(alias).alias("prefix_normalized"), F.when(matched, scope).alias("scope"),
        breaking.alias("breaking"), subject.alias("subject"), status.alias("parser_status"), confidence.alias("confidence"),
    )


#: Closing verbs with their number; mentions of two to seven digits that no word, slash or # precedes; GH-numbers.
CLOSING = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\b[:\s]+(?:https?://[\w.-]+/[\w.-]+/[\w.-]+/issues/|#|GH-)([0-9]{1,7})"
MENTION = r"(?:^|[^\w/#])#([0-9]{2,7})\b"
GH_MENTION = r"(?i)\bGH-([0-9]{2,7})\b"


def references(text: Column) -> Column:
    """References in a text as an array of (value, subtype, strength): closing ones strong, mentions medium; one a value, the strongest."""
    body = F.coalesce(text, F.lit(""))
    numbers = lambda pattern: F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), lambda x: x.cast("bigint"))
    closing = F.array_distinct(numbers(CLOSING))
    mentions = F.array_except(F.array_distinct(F.concat(numbers(MENTION), numbers(GH_MENTION))), closing)
    shape = lambda subtype, strength: lambda x: F.struct(x.alias("value"), F.lit(subtype).alias("subtype"), F.lit(strength).alias("strength"))
    return F.concat(F.transform(closing, shape("closing", "strong")), F.transform(mentions, shape("mention", "medium")))


URL = r"https?://[^\s<>()\[\]\"']{6,300}"


def urls(text: Column, own_host: str = "") -> Column:
    """Addresses in a text as an array of (url, kind, strength), each once and in order; those of ``own_host`` are left out."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))
    kept = F.filter(found, lambda u: ~u.contains(own_host)) if own_host else found
    strength = lambda k: F.when(k.isin("changelog", "docs"), "strong").when(k == "handbook", "strong").otherwise("weak")
    kind = lambda u: first_match(u, DOCUMENT_KINDS, "external")
    return F.transform(kept, lambda u: F.struct(u.alias("url"), kind(u).alias("kind"), strength(kind(u)).alias("strength")))


def edge_phrases(text: Column) -> Column:
    """The kinds of ``EDGE_PHRASES`` in a text, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(k)) for k, p in EDGE_PHRASES.items()]))


def feature_flags(text: Column) -> Column:
    """Flags in a text as (key, detection): constants of the registry and literals of calls."""
    body = F.coalesce(text, F.lit(""))
    constants = F.array_distinct(F.regexp_extract_all(body, F.lit(r"\bFEATURE_FLAGS\.([A-Z0-9_]{3,60})\b"), F.lit(1)))
    calls = F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?i)(?:isFeatureEnabled|useFeatureFlag|getFeatureFlag|feature_enabled|featureFlags\s*\[)\s*\(?\s*['\"]([a-z0-9][\w-]{2,60})['\"]"), F.lit(1)))
    return F.concat(F.transform(constants, lambda k: F.struct(k.alias("key"), F.lit("constant").alias("detection"))), F.transform(calls, lambda k: F.struct(k.alias("key"), F.lit("call").alias("detection"))))


def flag_registry(text: Column) -> Column:
    """The registry's entries (constant, key, owner)."""
    pattern = r"(?m)^\s*([A-Z0-9_]{3,60})\s*:\s*['\"]([^'\"]{2,80})['\"]\s*,?(?:\s*//\s*owner:\s*([#@][\w./-]+))?"
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("constant", "key", "owner"), strict=True)]), lambda x: F.struct(x["constant"].alias("constant"), x["key"].alias("key"), F.nullif(x["owner"], F.lit("")).alias("owner")))


def diff_lines(patch: Column, sign: str) -> Column:
    """The lines that a patch adds (``+``) or removes (``-``), without file headers, as one text."""
    lines = F.filter(F.split(F.coalesce(patch, F.lit("")), "\n"), lambda x: x.startswith(sign) & ~x.startswith(sign * 3))
    return F.array_join(F.transform(lines, lambda x: F.substr(x, F.lit(2))), "\n")


def trailers(message: Column) -> Column:
    """(key, value) of the trailers in a message's last 15 lines."""
    lines = F.split(F.coalesce(message, F.lit("")), "\n")
    last = F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 14), F.lit(15))
    pattern = r"^([A-Z][A-Za-z-]+-by|Reverts|Fixes|Change-Id): (.+)$"
    return F.transform(F.filter(last, lambda x: x.rlike(pattern)), lambda x: F.struct(F.lower(F.regexp_extract(x, pattern, 1)).alias("key"), F.trim(F.regexp_extract(x, pattern, 2)).alias("value")))


def normalize_path(path: Column) -> Column:
    """A repository path without leading ``./`` and ``/``."""
    return F.regexp_replace(F.regexp_replace(path, r"^(\./)+", ""), r"^/+", "")


def module_name(path: Column) -> Column:
    """The module of a Python file: dots for slashes, a package's file stands for the package."""
    return F.translate(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"/__init__$", ""), "/", ".")


def test_stem(path: Column) -> Column:
    """The name of a test file without what marks it as a test; NULL for other files."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    test = stem.rlike(r"^test_|_test$|\.test$|\.spec$")
    return F.when(test, F.regexp_replace(F.regexp_replace(stem, r"^test_", ""), r"(_test|\.test|\.spec)$", ""))


def production_stem(path: Column) -> Column:
    """The name of a file without extension; NULL for test files."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[A-Za-z0-9]+$", "")
    return F.when(test_stem(path).isNull(), stem)


def bare_comment(body: Column) -> Column:
    """A comment without fenced code and HTML comments."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), r"(?s)```.*?```", " "), r"(?s)<!--.*?-->", " "))


def comment_substance(body: Column, is_bot: Column) -> Column:
    """``bot``, ``empty``, ``acknowledgement``, ``nit``, ``short`` or ``substantive``, the first that holds."""
    text = bare_comment(body)
    any_of = lambda patterns: F.coalesce(*[F.when(text.rlike(p), F.lit(True)) for p in patterns], F.lit(False))
    short = F.length(text) <= SHORT_COMMENT
    return (
        F.when(F.coalesce(is_bot, F.lit(False)), "bot").when(text == "", "empty").when(any_of(ACKNOWLEDGEMENTS) & short, "acknowledgement").when(any_of(NITS), "nit").when(short, "short").otherwise("substantive")
    )


def vocabulary_terms(text: Column, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    """MAP category to the terms found in a text, in lower case and as substrings; categories without any are left out."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: low.contains(t)).alias("value")) for k, terms in vocabulary.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: F.size(p["value"]) > 0))


def tokenize(text: Column, stopwords: Sequence[str] = (), least: int = 3) -> Column:
    """The words of a text in lower case, names in code parted at underscores, without code, addresses and stop words."""
    clean = F.coalesce(text, F.lit(""))
    for noise in (r"(?s)```.*?```", r"(?s)<!--.*?-->", r"https?://\S+", r"`[^`]*`"):
        clean = F.regexp_replace(clean, noise, " ")
    raw = F.regexp_extract_all(F.lower(clean), F.lit(r"[a-z][a-z0-9_]+"), F.lit(0))
    parts = F.flatten(F.transform(raw, lambda w: F.regexp_extract_all(w, F.lit(r"[a-z]+|[0-9]+"), F.lit(0))))
    return F.filter(parts, lambda w: (F.length(w) >= least) & ~w.isin(list(stopwords)) if stopwords else F.length(w) >= least)


def named_entities(text: Column, least: int = 6) -> Column:
    """Names of code in a text (snake, kebab or camel case) of at least ``least`` letters, each once, in lower case."""
    pattern = r"\b([A-Za-z][a-z0-9]+(?:[_-][A-Za-z0-9]+)+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b"
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), F.lower), lambda w: F.length(w) >= least))


def clean_markdown(text: Column) -> Column:
    """A text without fenced code, HTML comments, images, link targets, headings' and lists' marks; blanks taken together."""
    out = F.coalesce(text, F.lit(""))
    for pattern, to in ((r"(?s)```.*?```", " "), (r"(?s)<!--.*?-->", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s*(#{1,6}|[-*>])\s+", " "), (r"[*`]+", ""), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def sentences(text: Column) -> Column:
    """The sentences of a cleaned text."""
    return F.filter(F.split(clean_markdown(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def redact(text: Column) -> Column:
    """A text with mail addresses and tokens of services replaced."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[redacted-email]")
    return F.regexp_replace(out, r"\b(gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|AKIA[A-Z0-9]{16})\b", "[redacted-token]")


def html_title(html: Column) -> Column:
    """The title of an HTML page, blanks taken together, at most 400 characters; NULL without one. Entities stay."""
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(F.substring(F.trim(F.regexp_replace(found, r"\s+", " ")), 1, 400), F.lit(""))


def span(text: Column, pattern: str, pad: int = 60, most: int = 280) -> Column:
    """The first place of a pattern with ``pad`` characters on both sides, line breaks as blanks; NULL if it isn't there."""
    flat = F.regexp_replace(text, r"[\r\n]+", " ")
    return F.nullif(F.substring(F.trim(F.regexp_extract(flat, f".{{0,{pad}}}(?:{pattern}).{{0,{pad}}}", 0)), 1, most), F.lit(""))


def looks_generated(content: Column, markers: Sequence[str]) -> Column:
    """Whether a marker stands in the first 4,000 characters, case aside; the rest of a generated file says no more."""
    head = F.lower(F.substring(content, 1, 4000))
    return F.coalesce(*[F.when(head.contains(m.lower()), F.lit(True)) for m in markers], F.lit(False))


def bounded_patch(patch: Column, n_lines: Column, most_lines: int, most_chars: int) -> Column:
    """(patch, skipped, truncated): a patch of at most ``most_lines`` lines, cut at ``most_chars``; the reason if it is left out."""
    reason = F.when(patch.isNull(), "no_patch").when(n_lines > most_lines, "too_many_lines")
    kept = F.when(reason.isNull(), F.substring(patch, 1, most_chars))
    return F.struct(kept.alias("patch"), reason.alias("skipped"), (reason.isNull() & (F.length(patch) > most_chars)).alias("truncated"))


def first_mode(values: Column, k: int) -> Column:
    """The most frequent of the first ``k`` values of an array, ties to the least."""
    head = F.slice(values, 1, k)
    counted = F.transform(F.array_distinct(head), lambda v: F.struct((-F.size(F.filter(head, lambda x: x == v))).alias("n"), v.alias("v")))
    return F.get(F.array_sort(counted), 0)["v"]
