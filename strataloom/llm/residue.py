"""Template residue and error-page text: templates mined by a fixed-depth prefix tree and judged once."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm import residue_terms as W
from strataloom.operators.skew import lookup_join
from strataloom.session import cut_lineage

#: Tokens that the tree branches on, after the number of tokens.
DEPTH = 2
#: A token belongs to the template if so many different texts of its leaf have it at its place.
SHARED = 3
#: Texts of more tokens are templates of their own; the verdict is the same, as templates only save judging.
MINED = 200
#: One word in so many may be no plain one.
STRANGE = 8
HOLE = "<*>"

_EDGE = re.compile(r"^[\s»*•·>#|:\-–—]+|[\s|:·\-–—…]+$|(?<=\w)\s*\.{2,}$")
_PARTS = re.compile(r"\s+[-–—|/·»]\s+|(?<=\w):\s+|\s+\((?=[^()]*\)$)")


def fold(text: str) -> str:
    """Lower case without accents, curly quotes straight."""
    text = unicodedata.normalize("NFKD", text.lower().replace("’", "'").replace("‘", "'").replace("“", '"').replace("”", '"').replace("ß", "ss"))
    return "".join(c for c in text if not unicodedata.combining(c))


@cache
def _words(name: str) -> frozenset[str]:
    return frozenset(getattr(W, name).split())


@cache
def _cues(kind: str) -> list[tuple[str, re.Pattern]]:
    return [(c, re.compile(p)) for c, patterns in getattr(W, kind).items() for p in patterns]


_SLOT = re.compile("|".join(f"(?:{p})" for p in W.SLOTS), re.IGNORECASE)
#: Numbers but for the codes of HTTP errors, and hexadecimal ids.
_NUMBER = re.compile(r"#?\b(?=[a-f]*\d)[0-9a-f]{6,}\b|#?\b(?![45]\d\d\b)\d+\b")
_KEY = re.compile(r"^[a-z0-9_-]+(\.[a-z0-9_-]+){2,}$")
_KEY_ENDS = re.compile(r"^(i18n|t|translations?|messages?|locales?|strings?|labels?|lang)\.|\.(title|description|desc|heading|headline|name|label|text|subtitle|meta|body|summary|caption)$")
_TRANSLATE = re.compile(r"^\{?\{?\s*\$?(t|__|_|gettext|trans|i18n)\(.*\)\s*\}?\}?$")


def brands(host: str | None) -> frozenset[str]:
    """The words that a host calls itself by: its labels but for the last."""
    labels = (host or "").lower().split(":")[0].split(".")
    return frozenset(p for label in labels[:-1] for p in [label, *label.split("-")] if len(p) > 2)


def bare(text: str, host: str | None) -> str:
    """A title or description without bullets and the site's own name at its ends; the name within it as ``<brand>``."""
    own = brands(host)
    beside = own | _words("SECTIONS")
    text = re.sub(r"[​-‏⁠﻿­]", "", unicodedata.normalize("NFKC", html.unescape(text)))
    while True:
        before = text
        text = _EDGE.sub("", text.strip())
        parts = [(m.start(), m.end()) for m in _PARTS.finditer(text)]
        if parts:
            start, end = parts[-1]
            if (tail := re.findall(r"[\w-]+", text[end:].lower())) and set(tail) <= beside:
                text = text[:start]
            elif (head := re.findall(r"[\w-]+", text[: parts[0][0]].lower())) and set(head) <= beside and text[: parts[0][0]][:1].isalnum():
                text = text[parts[0][1] :]
        if text == before:
            break
    if own:
        text = re.sub(rf"(?i)(?<![\w.@-])({'|'.join(map(re.escape, sorted(own - _words('SECTIONS'), key=len, reverse=True))) or '(?!)'})(?![\w.@-])", "<brand>", text)
    return re.sub(r"\s+", " ", text).strip()


def tokens(text: str) -> list[str]:
    """The tokens of a bare text that templates are made of; numbers are holes from the start."""
    return [HOLE if re.fullmatch(r"\W*\d[\d.,:]*\W*", t) else t for t in fold(text).split(" ") if t]


def unresolved_slot(text: str) -> bool:
    """Whether a bare text has holes of a template that nothing was filled into, and isn't about templates."""
    folded = fold(text)
    if _TRANSLATE.match(folded) or (_KEY.match(folded) and _KEY_ENDS.search(folded)):
        return True
    words = re.findall(r"[^\s|:/()-]+", folded)
    if words and any(w.strip(".,") in _words("NOTHING") for w in words) and all(w.strip(".,") in _words("NOTHING") | _words("COUNTING") | {"<brand>"} or w.strip(".,").isdigit() for w in words):
        return True
    if not _SLOT.search(text.replace("<brand>", " ")):
        return False
    around = re.findall(r"[^\W\d_]+", _SLOT.sub(" ", folded.replace("<brand>", " ")))
    return not any(w in _words("ABOUT_SLOTS") for w in around)


def _strange(folded: str) -> tuple[int, int]:
    """(words that are no plain ones, words)."""
    words = [w.strip("'") for w in re.findall(r"<num>|<brand>|<\*>|[^\W\d_]+(?:['-][^\W\d_]+)*", folded)]
    plain = _words("PLAIN")
    odd = sum(1 for w in words if w != HOLE and w not in plain and not all(p in plain for p in w.split("-")))
    return odd, len(words)


def message(text: str) -> str | None:
    """The class of a bare text or template that is a message as a whole: ``error``, ``script`` or ``filler``."""
    folded = fold(text)
    for kind, cue in _cues("OPEN"):
        if cue.search(folded):
            return kind
    words = re.findall(r"<brand>|[^\W_]+", folded)
    mashed = [("<num>" if w.isdigit() else w) for w in words]
    if mashed and all(w in _words("MASHED") for w in mashed) and any(w != "<num>" for w in mashed):
        return "filler"
    for size in range(1, len(words) // 2 + 1):
        if len(words) % size == 0 and words == words[:size] * (len(words) // size) and (len(words) // size > 2 or size > 2):
            return "filler"
    numbered = _NUMBER.sub("<num>", folded)
    odd, n = _strange(numbered)
    if odd <= n // STRANGE:
        for kind, cue in _cues("CUES"):
            if cue.search(numbered):
                return kind
    return None


def judge_template(template: list[str]) -> str:
    """``ordinary`` or a class of ``message`` for all texts of a template, else ``open`` if its holes decide."""
    text = " ".join(template)
    kind = message(text)
    if HOLE not in template:
        return kind or "ordinary"
    if any(cue.search(text) for _, cue in _cues("OPEN")):
        return kind or "ordinary"
    # words in holes only add to those of the template: one with too many odd words stays ordinary if each hole adds few words
    odd, words = _strange(text)
    return "ordinary" if odd > (words + 3 * template.count(HOLE)) // STRANGE else "open"


def judge(text: str, template_verdict: str) -> str | None:
    """The class of a bare text, given its template's verdict: a decided verdict holds, open ones and slots are looked at."""
    if text and unresolved_slot(text):
        return "slot"
    if template_verdict == "open":
        return message(text)
    return None if template_verdict == "ordinary" else template_verdict


def leaf(parts: list[str]) -> str:
    """Where the prefix tree of fixed depth puts a text: its number of tokens and its first tokens."""
    return "\x1f".join([str(len(parts)), *parts[:DEPTH]])


def mine_templates(texts: DataFrame) -> DataFrame:
    """(text, template) of distinct bare texts: tokens that few texts of a leaf share at their place are holes.

    Tokens are counted by leaf, place and token, so a leaf or token with most of the texts is no
    task of its own, and the templates depend neither on the order of texts nor on partitions. A
    template covers every text that has it.
    """
    prepared = cut_lineage(_tokenized(texts))
    short = prepared.filter(F.size("parts") <= MINED)
    spread = short.select("id", "leaf", F.posexplode("parts").alias("place", "token"))
    counts = cut_lineage(spread.groupBy("leaf", "place", "token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SHARED))
    kept = lookup_join(spread, counts, ["leaf", "place", "token"]).select("id", "place", F.when(F.col("n").isNotNull(), F.col("token")).otherwise(HOLE).alias("token"))
    filled = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("t")).select("id", F.col("t.token").alias("template"))
    mined = short.select("id", "text").join(filled, "id").select("text", "template")
    return mined.unionByName(prepared.filter(F.size("parts") > MINED).select("text", F.col("parts").alias("template")))


def _tokenized(texts: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("leaf", T.StringType())])

    def split(text: str) -> tuple[str, list[str], str]:
        parts = tokens(text)
        return text, parts, leaf(parts)

    return _python(texts.select("text"), split, schema).withColumn("id", F.md5("text"))


def _python(df: DataFrame, fn, schema: T.StructType) -> DataFrame:
    """Rows of ``df`` through ``fn``, which takes and gives a tuple a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            rows = [fn(*r) for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in target]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(columns, target, strict=True)], schema=target)

    return df.mapInArrow(run, schema)


def _fields(rows: DataFrame, key: str, host: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """((_key, _host, field, raw) of all fields that aren't NULL; (raw, _host, text), their distinct bare texts)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("raw")) for f in fields]))
    long = rows.select(F.col(key).alias("_key"), F.col(host).alias("_host"), pairs.alias("p")).select("_key", "_host", "p.field", "p.raw").filter("raw IS NOT NULL")
    names = T.StructType([T.StructField(c, T.StringType()) for c in ("raw", "_host", "text")])
    return long, _python(long.select("raw", "_host").distinct(), lambda raw, h: (raw, h, bare(raw, h)), names).filter(F.col("text") != "")


def _judged(mined: DataFrame) -> DataFrame:
    """``mined`` with the verdict of its template, which is judged once."""
    verdict = T.StructType([T.StructField("template", T.ArrayType(T.StringType())), T.StructField("verdict", T.StringType())])
    return lookup_join(mined, cut_lineage(_python(mined.select("template").distinct(), lambda t: (t, judge_template(t)), verdict)), ["template"])


def find_residue(rows: DataFrame, key: str, host: str, fields: list[str]) -> DataFrame:
    """(``key``, field, residue) of each field that is residue as a whole: ``slot``, ``filler``, ``error`` or ``script``.

    Fields are freed of the site's name (from ``host``; NULL is no name), templates are mined from
    the distinct rest and judged once, and verdicts go back to all records. Texts of templates
    whose holes decide are looked at one by one, and unresolved slots are searched in every text.
    NULL, empty and blank fields, and fields of nothing but the site's name, are no residue.
    """
    long, bared = _fields(rows, key, host, fields)
    classes = T.StructType([T.StructField("text", T.StringType()), T.StructField("residue", T.StringType())])
    mined = cut_lineage(mine_templates(bared.select("text").distinct()))
    texts = _python(_judged(mined).select("text", "verdict"), lambda t, v: (t, judge(t, v)), classes).filter("residue IS NOT NULL")
    found = bared.join(texts, "text").select("raw", F.col("_host").alias("h"), "residue")
    return long.join(found, (long["raw"] == found["raw"]) & long["_host"].eqNullSafe(found["h"])).select(F.col("_key").alias(key), "field", "residue").distinct()


def template_table(rows: DataFrame, key: str, host: str, fields: list[str]) -> DataFrame:
    """(template, verdict, n_texts, n_hosts, n_keys) of the mined templates, weighed by the texts, hosts and records that share them."""
    long, bared = _fields(rows, key, host, fields)
    judged = _judged(cut_lineage(mine_templates(bared.select("text").distinct())))
    named = bared.join(judged, "text").select("raw", F.col("_host").alias("h"), "text", F.array_join("template", " ").alias("template"), "verdict")
    uses = long.join(named, (long["raw"] == named["raw"]) & long["_host"].eqNullSafe(named["h"]))
    # distinct keys are counted by a first aggregation, so that a template of many records is no task of its own
    slim = uses.groupBy("template", "verdict", "text", "_host", "_key").agg(F.lit(1).alias("_one"))
    count = lambda c: slim.select("template", "verdict", c).filter(F.col(c).isNotNull()).distinct().groupBy("template", "verdict").agg(F.count(F.lit(1)).alias("n"))
    out = count("text").withColumnRenamed("n", "n_texts")
    for column, name in (("_host", "n_hosts"), ("_key", "n_keys")):
        out = out.join(count(column).withColumnRenamed("n", name), ["template", "verdict"], "left")
    return out.fillna(0, ["n_hosts", "n_keys"])


def without_residue(rows: DataFrame, key: str, host: str, fields: list[str]) -> DataFrame:
    """``rows`` without those that have a field of residue; rows without key stay, as no record is named by them."""
    return rows.join(find_residue(rows, key, host, fields).select(key).distinct(), key, "left_anti")
