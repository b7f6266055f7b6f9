"""Rows of one person among accounts and identities without a shared key."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.operators.graph import connected_components
from strataloom.session import cut_lineage

#: Bands of rows of MinHash over the letter pairs of family names.
BANDS, ROWS = 16, 2
#: Larger blocks are cut into chunks of about so many rows, and each pair of chunks is compared on its own.
BLOCK = 200
#: Pairs of different given names of a family name that are compared for each given name, as examples of differences.
CONTRASTS = 3
#: Weakly labelled pairs that the classifier is fitted on, taken by a hash.
MAX_LABELLED = 50_000
#: Least confidence of a match.
THRESHOLD = 0.5
#: Components of up to so many rows are settled within one task, larger ones by rounds of joins, with the same result.
COMPONENT = 5_000
#: A kind of evidence forbids a match if it contradicts in less than this share of the pairs that share an account.
RARE_CONFLICT = 0.02

#: A given name is established if people of so many family names have it.
ESTABLISHED = 20

#: First words of mailboxes that stand for a role and not for a person.
ROLES = "team info support admin administrator dev devs ops devops hello contact noreply no build builds ci root git github office sales billing security help helpdesk service mail postmaster webmaster bot jenkins release releases".split()

_HOSTED = re.compile(r"^(?:(\d+)\+)?([^@]+)@(?:users\.)?no-?reply\.", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.lower().replace("ø", "o").replace("ß", "ss").replace("æ", "ae").replace("ł", "l"))
    return "".join(c for c in text if not unicodedata.combining(c))


def parse_name(name: str) -> tuple[str, str] | None:
    """(given name or initial, family name), folded; None for a single word."""
    if ", " in name:
        family, given = name.split(", ", 1)
        name = f"{given} {family}"
    parts = [w.strip(".,") for w in fold(_CAMEL.sub(" ", name)).split()]
    parts = [w for w in parts if w.replace("'", "").replace("-", "").isalpha()]
    if len(parts) < 2 or len(parts[-1]) < 2:
        return None
    return parts[0], parts[-1]


def splits(alias: str) -> list[tuple[str, str]]:
    """The ways (given or initial, family) in which an account's name may be made of a person's name."""
    base = re.sub(r"\d+$", "", fold(alias))
    parts = [p for p in re.split(r"[._-]+", base) if p]
    out = []
    if len(parts) >= 2 and all(p.isalpha() for p in parts[:2]):
        out += [(parts[0], parts[1]), (parts[1], parts[0])]
    elif len(parts) == 1 and base.isalpha() and len(base) >= 5:
        out += [(base[:k], base[k:]) for k in range(1, min(10, len(base) - 2))] + [(base[-k:], base[:-k]) for k in range(1, min(10, len(base) - 2))]
    return [(g, f) for g, f in out if len(f) >= 3]


class Profile(NamedTuple):
    """What a row says: names, mailboxes, accounts' names with the ways to read them, mail domains."""

    names: list[tuple[str, str]]
    mailboxes: list[str]
    aliases: list[str]
    domains: list[str]


def profile(login: str | None, display: str | None, emails: list | None, names: list | None) -> Profile:
    known, aliases, boxes, domains = [], [], [], []
    for n in [*(names or []), display]:
        if n and n.strip():
            if p := parse_name(n.strip()):
                known.append(p)
            elif re.fullmatch(r"[\w.-]*\d", n.strip()):
                aliases.append(fold(n.strip()))
    if login:
        base = fold(login)
        # an account's name is one account's, as a mailbox is, also where it can be read as a name
        boxes.append(f"{base}@")
        # a second account is often the first one's name with a word added
        aliases.append(re.sub(r"(?<=\d)[-_](?:work|private|priv|home|alt|dev|old|new|bot|\w{2,4})$", "", base))
    for e in emails or []:
        e = fold((e or "").strip())
        if "@" not in e:
            continue
        if m := _HOSTED.match(e):
            aliases.append(m.group(2))
            boxes.append(f"{m.group(2)}@")
            continue
        local, domain = e.split("@", 1)
        local = local.split("+", 1)[0]
        if re.split(r"[^a-z]", local, maxsplit=1)[0] in ROLES:
            continue
        boxes.append(f"{local}@{domain}")
        domains.append(re.sub(r"^(?:e?mail|smtp|mx)\.", "", domain))
        aliases.append(local)
    uniq = lambda x: sorted(set(x))
    return Profile(uniq(known), uniq(boxes), uniq(aliases), uniq(domains))


_NAME = T.ArrayType(T.StructType([T.StructField("given", T.StringType()), T.StructField("family", T.StringType())]))
_STRINGS = T.ArrayType(T.StringType())


def _rows(df: DataFrame, fn, schema: T.StructType) -> DataFrame:
    """``df`` through ``fn``: any number of tuples a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            rows = [out for r in zip(*[c.to_pylist() for c in batch.columns], strict=True) for out in fn(*r)]
            columns = [[r[k] for r in rows] for k in range(len(target))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return df.mapInArrow(run, schema)


def profiles(people: DataFrame) -> DataFrame:
    """(id, names, mailboxes, aliases, domains) a distinct id of ``people`` (id, login, display_name, emails, git_names)."""
    lists = lambda c: F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.col(c), F.array().cast(_STRINGS)))))
    one = people.filter("id IS NOT NULL").groupBy("id").agg(F.max("login").alias("login"), F.max("display_name").alias("display_name"), lists("emails").alias("emails"), lists("git_names").alias("git_names"))
    schema = T.StructType([T.StructField("id", one.schema["id"].dataType), T.StructField("names", _NAME), T.StructField("mailboxes", _STRINGS), T.StructField("aliases", _STRINGS), T.StructField("domains", _STRINGS)])

    def fn(i, login, display, emails, names):
        p = profile(login, display, emails, names)
        yield i, [{"given": g, "family": f} for g, f in p.names], p.mailboxes, p.aliases, p.domains

    return _rows(one, fn, schema)


def near(a: str, b: str) -> bool:
    """Whether two words differ by one letter, or by two neighbours that changed places."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    if len(a) == len(b):
        diff = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y]
        return len(diff) == 1 or (len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]])
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :]


def minhash_bands(word: str) -> list[str]:
    """The band keys of a word: MinHash of its letter pairs, ``ROWS`` values a band."""
    padded = f"^{word}$"
    grams = [crc32(padded[i : i + 2].encode()) for i in range(len(padded) - 1)]
    values = [min((g * (2 * k + 0x9E3779B1) ^ (g >> (k % 13 + 1)) * 0x85EBCA6B ^ k * 0xC2B2AE35) & 0xFFFFFFFF for g in grams) for k in range(BANDS * ROWS)]
    return [f"{b}:" + ",".join(str(v) for v in values[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)]


def misspellings(words: DataFrame) -> DataFrame:
    """(family, meant) of ``words`` (family, proven), the spellings of family names: one that no account proves, and a near one.

    Candidates share a MinHash band. Only distinct spellings are compared, so a frequent family name
    costs as much as a rare one, and the spellings of a band that many share are compared chunk by
    chunk.
    """
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("id", T.StringType())])
    banded = _rows(words.select("family").filter(F.length("family") >= 4), lambda f: ((b, f) for b in minhash_bands(f)), schema)
    near_words = block_pairs(banded.withColumn("side", F.lit(None).cast("int")), lambda x, y: (F.abs(F.length(x) - F.length(y)) <= 1) & (F.levenshtein(x, y, 2) >= 0))
    both = cut_lineage(near_words.select(F.col("a").alias("family"), F.col("b").alias("meant")).unionByName(near_words.select(F.col("b").alias("family"), F.col("a").alias("meant"))))
    pairs = both.join(words.filter("NOT proven").select("family"), "family", "left_semi").select("family", "meant")
    found = T.StructType([T.StructField("family", T.StringType()), T.StructField("meant", T.StringType())])
    return _rows(pairs, lambda f, m: [(f, m)] if near(f, m) else [], found)


def _given(a: str, b: str) -> float:
    """How well two given names or initials agree: 1 equal, 0.8 initial, 0.6 short form or misspelt, 0 not."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.8 if a[0] == b[0] else 0.0
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and (long.startswith(short) or long.endswith(short)):
        return 0.6
    if near(a, b):
        return 0.6
    core = max((len(short[i:j]) for i in range(len(short)) for j in range(i + 3, len(short) + 1) if short[i:j] in long), default=0)
    return 0.6 if core >= 3 and core >= len(short) - 1 else 0.0


FEATURES = ["full", "initial", "short", "misspelt", "account_reading", "rarity", "handle_conflict", "company_conflict", "given_conflict"]


def compare(a: dict, b: dict) -> tuple[list[float], bool, bool]:
    """(features of names and contradictions, whether they share an account, whether their names contradict) of two rows.

    A row: names and readings [(given, family)], misspelt {family: meant}, mailboxes, handles,
    companies, established given names. Initials say nothing where both rows spell given names of
    the family out, and two different established names are no spellings of each other: in a
    frequent family name either would tie different people together.
    """
    best, miss, reading = 0.0, 0.0, 0.0
    conflict = written = False
    views_a = [(g, f, 0) for g, f in a["names"]] + [(g, f, 1) for g, f in a["readings"]]
    views_b = [(g, f, 0) for g, f in b["names"]] + [(g, f, 1) for g, f in b["readings"]]
    for ga, fa, ra in views_a:
        for gb, fb, rb in views_b:
            same = fa == fb
            spelt = not same and (fb in a["meant"].get(fa, ()) or fa in b["meant"].get(fb, ()) or bool(set(a["meant"].get(fa, ())) & set(b["meant"].get(fb, ()))))
            if not (same or spelt):
                continue
            g = 0.0 if ga != gb and ga in a["common"] and gb in b["common"] else _given(ga, gb)
            if g == 0.0 and not (ra or rb):
                conflict = True
            if len(ga) > 1 and len(gb) > 1 and not written:
                written, best, miss, reading = True, 0.0, 0.0, 0.0
            if written and (len(ga) == 1 or len(gb) == 1):
                continue
            if g > best or (g == best and not spelt and miss):
                best, miss, reading = g, float(spelt), float(ra or rb)
    foreign = bool(views_a) and bool(views_b) and best == 0.0
    shared = bool(set(a["mailboxes"]) & set(b["mailboxes"]) or set(a["handles"]) & set(b["handles"]))
    handles = bool(a["handles"]) and bool(b["handles"]) and not set(a["handles"]) & set(b["handles"])
    companies = bool(a["companies"]) and bool(b["companies"]) and not set(a["companies"]) & set(b["companies"])
    features = [float(best == 1.0), float(best == 0.8), float(best == 0.6), miss, reading, 1.0 if best else 0.0, float(handles), float(companies), float(conflict or foreign)]
    return features, shared, foreign


def fit(rows: np.ndarray, labels: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Weights (with the constant last) of a logistic regression by Newton steps."""
    x = np.c_[rows, np.ones(len(rows))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (labels - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibrate(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (score, probability) of an isotonic fit: probabilities never fall as scores rise."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for s, y in zip(scores[order], labels[order], strict=True):
        blocks.append([y, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y2, n2, s2 = blocks.pop()
            blocks[-1][0] += y2
            blocks[-1][1] += n2
            blocks[-1][2] = s2
    return np.array([b[2] for b in blocks]), np.array([(b[0] + 0.5) / (b[1] + 1.0) for b in blocks])


class Model(NamedTuple):
    """Weights, calibration steps, precision of a shared account, and which contradictions forbid a match."""

    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray
    account: float
    forbids: tuple[bool, bool]

    def confidence(self, features: list[float], shared: bool, foreign: bool) -> float:
        if foreign:
            return 0.0
        score = float(np.dot(self.weights[:-1], features) + self.weights[-1])
        p = float(self.levels[min(int(np.searchsorted(self.steps, score)), len(self.levels) - 1)]) if len(self.levels) else 1 / (1 + math.exp(-score))
        return 1 - (1 - p) * (1 - self.account) if shared else p


#: Names agree, nothing contradicts: holds where too few rows share accounts to fit anything.
DEFAULT = Model(np.array([4.0, 2.5, 2.0, -1.0, -0.5, 1.0, -6.0, -6.0, -4.0, -2.5]), np.array([]), np.array([]), 0.97, (True, True))


def block_pairs(keys: DataFrame, keep: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(a, b), a < b, of all pairs of a block of ``keys`` (key, side, id) for which ``keep`` holds; rows with sides are paired with the other side only.

    A block of more than ``BLOCK`` rows is cut into chunks by a hash, and each pair of chunks is one
    group of the join, so that no task holds a large block; no pair is left out.
    """
    rows = keys.distinct()
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    cut = rows.join(sizes, "key").withColumn("of", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    left = cut.select("key", F.col("chunk").alias("i"), F.explode(F.sequence(F.col("chunk"), F.col("of") - 1)).alias("j"), F.col("id").alias("x"), F.col("side").alias("s"))
    right = cut.select("key", F.explode(F.sequence(F.lit(0), F.col("chunk"))).alias("i"), F.col("chunk").alias("j"), F.col("id").alias("y"), F.col("side").alias("t"))
    met = left.join(right, ["key", "i", "j"]).filter(((F.col("i") < F.col("j")) & (F.col("x") != F.col("y"))) | (F.col("x") < F.col("y")) | ((F.col("x") > F.col("y")) & F.col("s").isNotNull()))
    apart = met.filter(F.col("s").isNull() | (F.col("s") != F.col("t")))
    if keep is not None:
        apart = apart.filter(keep(F.col("x"), F.col("y")))
    return apart.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def given_keys(given: str) -> set[str]:
    """Keys of which two given names that agree (``_given``) have one in common, single initials aside: the name, its letter triples, and what is left without one letter."""
    keys = {f"={given}"} | {given[i : i + 3] for i in range(len(given) - 2)}
    if len(given) >= 3:
        keys |= {f"-{given[:i]}{given[i + 1:]}" for i in range(len(given))} | {f"-{given}"}
    return keys


def family_keys(entries: DataFrame) -> DataFrame:
    """(key, side, id) of ``entries`` (family, given, id): blocks of one family name and given names that agree.

    The given names of a family are compared once each, by keys that agreeing ones share; an initial
    meets the given names that begin with it. Rows come in only where names agree.
    """
    names = cut_lineage(entries.select("family", "given").distinct())
    keyed = T.StructType([T.StructField("family", T.StringType()), T.StructField("given", T.StringType()), T.StructField("key", T.StringType())])
    spelt = cut_lineage(_rows(names.filter(F.length("given") > 1), lambda f, g: ((f, g, k) for k in given_keys(g)), keyed))
    alike = spelt.join(spelt.withColumnRenamed("given", "other"), ["family", "key"]).filter("given < other").select("family", "given", "other").distinct()
    agreeing = T.StructType([T.StructField("family", T.StringType()), T.StructField("given", T.StringType()), T.StructField("other", T.StringType())])
    alike = _rows(alike, lambda f, g, o: [(f, g, o)] if _given(g, o) else [], agreeing)
    initials = names.filter(F.length("given") == 1).select("family", "given")
    longer = names.filter(F.length("given") > 1).select("family", F.col("given").alias("other"), F.substring("given", 1, 1).alias("given"))
    pairs = alike.unionByName(initials.join(longer, ["family", "given"]).select("family", "given", "other"))
    tag = F.concat(F.lit("f:"), "family", F.lit("|"), "given")
    same = entries.select(tag.alias("key"), F.lit(None).cast("int").alias("side"), "id")
    one = entries.join(pairs, ["family", "given"]).select(F.concat(tag, F.lit("|"), "other").alias("key"), F.lit(0).alias("side"), "id")
    two = entries.withColumnRenamed("given", "other").join(pairs, ["family", "other"]).select(F.concat(tag, F.lit("|"), "other").alias("key"), F.lit(1).alias("side"), "id")
    return same.unionByName(one).unionByName(two)


def contrasts(entries: DataFrame) -> DataFrame:
    """(a, b): rows of one family name and different given names, at most ``CONTRASTS`` for each given name: what the classifier learns differences from."""
    named = entries.groupBy("family", "given").agg(F.min("id").alias("id"))
    # a frequent family name is cut by a hash, so that no task holds all its given names
    sized = named.join(named.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / 10_000).alias("of")), "family")
    w = Window.partitionBy("family", F.pmod(F.xxhash64("given"), F.col("of"))).orderBy("given")
    after = sized.select("id", F.array(*[F.lead("id", k).over(w) for k in range(1, CONTRASTS + 1)]).alias("others"))
    beside = after.select("id", F.explode("others").alias("other")).filter("id <> other")
    return beside.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def evidence(people: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(profiles with readings, handles, companies and meant spellings; blocking keys (key, side, id); (id, member) of rows that say the same; ``contrasts``)."""
    base = cut_lineage(profiles(people))
    kind = base.schema["id"].dataType
    named = cut_lineage(base.select("id", F.explode("names").alias("n")).select("id", "n.given", "n.family"))
    families = named.select("family").distinct()
    reading = T.StructType([T.StructField("id", kind), T.StructField("alias", T.StringType()), T.StructField("given", T.StringType()), T.StructField("family", T.StringType()), T.StructField("parted", T.BooleanType())])
    read = _rows(base.select("id", "aliases"), lambda i, aliases: ((i, a, g, f, bool(re.search("[._-]", a))) for a in aliases for g, f in splits(a)), reading)
    parted = cut_lineage(read.filter("parted").select("id", "alias", "given", "family"))
    readings = cut_lineage(read.join(families, "family", "left_semi").select("id", "alias", "given", "family").distinct())
    loose = cut_lineage(parted.join(readings.select("id", "alias").distinct(), ["id", "alias"], "left_anti"))
    proven = readings.select("family").distinct().withColumn("proven", F.lit(True))
    spelt = families.join(proven, "family", "left").select("family", F.coalesce("proven", F.lit(False)).alias("proven"))
    wrong = cut_lineage(misspellings(cut_lineage(spelt)))
    handles = cut_lineage(base.select("id", F.explode("aliases").alias("alias")).join(readings.select("id", "alias").distinct(), ["id", "alias"], "left_anti"))
    usage = cut_lineage(base.select(F.explode("domains").alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n")))
    middle = usage.agg(F.percentile_approx("n", 0.5)).scalar()
    companies = base.select("id", F.explode("domains").alias("domain")).join(usage.filter(F.col("n") <= 2 * middle), "domain", "left_semi")
    # a mailbox of people without a family name in common, whatever their spellings may mean, or with different handles belongs to none of them; those named after a role are left out above
    said = named.select("id", "family").unionByName(readings.select("id", "family")).distinct()
    spelt_right = said.select("id", F.col("family").alias("who")).unionByName(said.join(wrong, "family").select("id", F.col("meant").alias("who")))
    unread = parted.join(readings.select("id").distinct(), "id", "left_anti").join(named.select("id").distinct(), "id", "left_anti").select("id", F.concat(F.least("given", "family"), F.lit(" "), F.greatest("given", "family")).alias("who"))
    digits = handles.filter(F.col("alias").rlike(r"\d"))
    owners = base.select("id", F.explode("mailboxes").alias("mailbox"))
    who = owners.join(spelt_right.unionByName(unread).distinct(), "id")
    known = who.groupBy("mailbox").agg(F.countDistinct("id").alias("rows"))
    people_of = who.groupBy("mailbox", "who").agg(F.countDistinct("id").alias("n")).groupBy("mailbox").agg(F.max("n").alias("n")).join(known, "mailbox").filter("n < rows").select("mailbox")
    handles_of = owners.join(digits, "id").filter(F.col("alias") != F.split_part("mailbox", F.lit("@"), F.lit(1))).groupBy("mailbox").agg(F.countDistinct("alias").alias("n")).filter("n > 1").select("mailbox")
    team = cut_lineage(people_of.unionByName(handles_of).distinct())
    boxes = cut_lineage(owners.join(team, "mailbox", "left_anti"))
    own_domains = boxes.select("id", F.regexp_replace(F.split_part("mailbox", F.lit("@"), F.lit(2)), r"^(?:e?mail|smtp|mx)\.", "").alias("domain")).distinct()
    companies = companies.join(own_domains, ["id", "domain"], "left_semi")
    own_handles = digits.join(team.select(F.split_part("mailbox", F.lit("@"), F.lit(1)).alias("alias")).distinct(), "alias", "left_anti")
    misspelt = named.join(wrong, "family")
    established = named.filter(F.length("given") > 1).groupBy("given").agg(F.countDistinct("family").alias("n")).filter(F.col("n") >= ESTABLISHED).select("given")
    common = named.select("id", "given").unionByName(readings.select("id", "given")).distinct().join(F.broadcast(established), "given")
    # all evidence in one long table, brought together once a row
    fact = lambda df, what, x, y=None: df.select("id", F.lit(what).alias("what"), F.col(x).alias("x"), (F.col(y) if y else F.lit(None).cast("string")).alias("y"))
    facts = fact(named, "names", "given", "family")
    for part in (fact(readings, "readings", "given", "family"), fact(loose, "loose", "given", "family"), fact(misspelt, "meant", "family", "meant"), fact(common, "common", "given"), fact(boxes, "mailboxes", "mailbox"), fact(own_handles, "handles", "alias"), fact(companies, "companies", "domain")):
        facts = facts.unionByName(part)
    gather = lambda what, value: F.array_sort(F.collect_set(F.when(F.col("what") == what, value))).alias(what)
    name, spelling = F.struct(F.col("x").alias("given"), F.col("y").alias("family")), F.struct(F.col("x").alias("family"), F.col("y").alias("meant"))
    full = facts.groupBy("id").agg(gather("names", name), gather("readings", name), gather("loose", name), gather("meant", spelling), gather("common", F.col("x")), gather("mailboxes", F.col("x")), gather("handles", F.col("x")), gather("companies", F.col("x")))
    says = F.when(F.size("names") + F.size("readings") + F.size("loose") > 0, F.md5(F.to_json(F.struct("names", "readings", "loose", "meant", "handles", "companies"))))
    full = cut_lineage(full.withColumn("says", says))
    first = full.filter("says IS NOT NULL").groupBy("says").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut_lineage(full.select("id", "says").join(first, "says").filter("id <> first").select(F.col("first").alias("id"), F.col("id").alias("member")))
    # rows that say the same stand for each other, but for their mailboxes
    entries = named.select("family", "given", "id").unionByName(readings.select("family", "given", "id")).unionByName(misspelt.select(F.col("meant").alias("family"), "given", "id")).distinct()
    entries = cut_lineage(entries.join(members.select(F.col("member").alias("id")), "id", "left_anti"))
    alone = F.lit(None).cast("int").alias("side")
    exact = own_handles.select(F.concat(F.lit("h:"), "alias").alias("key"), alone, "id").unionByName(parted.select(F.concat(F.lit("p:"), F.least("given", "family"), F.lit(" "), F.greatest("given", "family")).alias("key"), alone, "id"))
    exact = exact.join(members.select(F.col("member").alias("id")), "id", "left_anti").unionByName(boxes.select(F.concat(F.lit("m:"), "mailbox").alias("key"), alone, "id"))
    return full.drop("says"), cut_lineage(exact.unionByName(family_keys(entries))), members, contrasts(entries)


def _row(r: dict) -> dict:
    pairs = lambda x, a, b: [(v[a], v[b]) for v in x or []]
    meant: dict[str, set[str]] = {}
    for f, m in pairs(r["meant"], "family", "meant"):
        meant.setdefault(f, set()).add(m)
    return {"names": pairs(r["names"], "given", "family"), "readings": pairs(r["readings"], "given", "family") + pairs(r["loose"], "given", "family"), "meant": meant, "common": r["common"] or [], "mailboxes": r["mailboxes"] or [], "handles": r["handles"] or [], "companies": r["companies"] or []}


def compared(full: DataFrame, keys: DataFrame, members: DataFrame, more: DataFrame) -> DataFrame:
    """(a, b, features, shared, foreign) of all candidate pairs: those of the blocks, of each row with those that say the same, and ``more``."""
    pairs = block_pairs(keys).unionByName(members.select(F.least("id", "member").alias("a"), F.greatest("id", "member").alias("b"))).unionByName(more).distinct()
    left = full.select(F.col("id").alias("a"), F.struct(*[c for c in full.columns if c != "id"]).alias("x"))
    right = full.select(F.col("id").alias("b"), F.struct(*[c for c in full.columns if c != "id"]).alias("y"))
    kind = full.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("features", T.ArrayType(T.DoubleType())), T.StructField("shared", T.BooleanType()), T.StructField("foreign", T.BooleanType())])

    def fn(b, a, x, y):
        f, s, o = compare(_row(x), _row(y))
        yield a, b, f, s, o

    joined = pairs.join(left, "a").join(right, "b").select("b", "a", "x", "y")
    return _rows(joined, fn, schema)


def train(pairs: DataFrame) -> Model:
    """The model from weak labels: pairs that share an account are one person, pairs whose names contradict are not.

    Labels come from accounts and the model sees names and contradictions only; at most
    ``MAX_LABELLED`` labelled pairs are taken by a hash. Half of them fit the weights, the other
    half calibrate; a shared account is worth the share of its pairs whose names agree.
    """
    labelled = pairs.filter("shared OR foreign OR features[8] > 0 OR features[6] + features[7] > 0").withColumn("_h", F.xxhash64("a", "b"))
    rows = labelled.orderBy("_h", "a", "b").limit(MAX_LABELLED).select("features", "shared", "foreign").collect()
    shared = [r for r in rows if r.shared]
    if len(shared) < 50:
        return DEFAULT
    agreeing = [r for r in shared if not r.foreign]
    account = (len(agreeing) + 0.5) / (len(shared) + 1)
    rate = lambda k: sum(r.features[k] for r in agreeing) / max(1, len(agreeing))
    forbids = (rate(6) < RARE_CONFLICT, rate(7) < RARE_CONFLICT)
    good = [r for r in agreeing if r.features[5] > 0]
    bad = [r for r in rows if not r.shared]
    x = np.array([r.features for r in good + bad])
    y = np.array([1.0] * len(good) + [0.0] * len(bad))
    if not len(good) or not len(bad):
        return DEFAULT._replace(account=account, forbids=forbids)
    half = np.arange(len(y)) % 2 == 0
    w = fit(x[half], y[half])
    steps, levels = calibrate(x[~half] @ w[:-1] + w[-1], y[~half])
    return Model(w, steps, levels, account, forbids)


def _contradict(a: set, b: set) -> bool:
    """Whether two sets of full names (given, family) hold people of one family whose given names do not agree."""
    return any(f == g and _given(x, y) == 0.0 for x, f in a for y, g in b)


def settle(edges: list[tuple], nodes: dict, forbids: tuple[bool, bool]) -> list[tuple]:
    """(a, b, confidence) of the clusters of one component: pairs join in order of confidence unless what they join contradicts.

    ``edges``: (a, b, confidence, shared, order), by which equal confidences are taken; ``nodes``:
    id to (handles, companies, full names). Shared accounts join whatever else is said; other pairs
    do not bring different handles, employers or given names of one family into one cluster.
    """
    parent = {n: n for n in nodes}
    held = {n: (set(h) if forbids[0] else set(), set(c) if forbids[1] else set(), {x for x in names if len(x[0]) > 1}) for n, (h, c, names) in nodes.items()}
    members = {n: [n] for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    strength: dict[tuple, float] = {}
    for a, b, p, shared, _ in sorted(edges, key=lambda e: (-e[3], -e[2], e[4], e[0], e[1])):
        strength[a, b] = p
        x, y = root(a), root(b)
        if x == y:
            continue
        differ = any(s and t and not s & t for s, t in zip(held[x][:2], held[y][:2], strict=True))
        if not shared and (differ or _contradict(held[x][2], held[y][2])):
            continue
        parent[y] = x
        members[x] += members.pop(y)
        held[x] = tuple(s | t for s, t in zip(held[x], held[y], strict=True))
    # pairs by way of others are as sure as the weakest link of their cluster
    weakest: dict = {}
    for (a, b), p in strength.items():
        if (x := root(a)) == root(b):
            weakest[x] = min(p, weakest.get(x, 1.0))
    out = []
    for x, group in members.items():
        group.sort()
        out += [(a, b, strength.get((a, b), weakest.get(x, 0.0))) for i, a in enumerate(group) for b in group[i + 1 :]]
    return out


def match(people: DataFrame) -> DataFrame:
    """(a, b, confidence), a < b, of all pairs of different ids that are one person.

    ``people``: id, login, display_name, emails, git_names; lists may be empty or NULL; repeated
    rows of an id are taken together. Rows without any name, address or account match nothing.
    Candidates share a mailbox, an account's name, or a family name (also misspelt, or read out of
    an account's name) with an agreeing given name; a classifier judges them; rows that are one
    person by way of others are pairs as well. Where a component holds rows that contradict each
    other (different handles or employers, if these never differ within accounts), it is split along
    its weakest pairs. Rows that say the same are one candidate; their links are those of its first.
    """
    full, keys, members, more = evidence(people)
    pairs = cut_lineage(compared(full, keys, members, more))
    model = train(pairs)
    kind = full.schema["id"].dataType
    scored = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("p", T.DoubleType()), T.StructField("shared", T.BooleanType())])

    def score(a, b, features, shared, foreign):
        blocked = not shared and ((model.forbids[0] and features[6] > 0) or (model.forbids[1] and features[7] > 0))
        p = 0.0 if blocked else model.confidence(features, shared, foreign)
        return [(a, b, p, shared)] if p >= THRESHOLD else []

    accepted = _expanded(cut_lineage(_rows(pairs, score, scored)), members)
    accepted = cut_lineage(accepted.withColumn("o", F.xxhash64("a", "b")))
    components = cut_lineage(connected_components(accepted, "a", "b"))
    large = cut_lineage(components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COMPONENT).select("component"))
    if large.isEmpty():
        return _settled(accepted, components, full, model.forbids)
    inside = components.join(large, "component", "left_semi").select(F.col("node").alias("a"))
    small = _settled(accepted.join(inside, "a", "left_anti"), components.join(large, "component", "left_anti"), full, model.forbids)
    return small.unionByName(settled_by_rounds(cut_lineage(accepted.join(inside, "a", "left_semi")), full, model.forbids))


def _expanded(accepted: DataFrame, members: DataFrame) -> DataFrame:
    """``accepted`` with the links of a row for those that say the same but are not linked to it."""
    linked = accepted.select("a", "b")
    pair = members.withColumns({"a": F.least("id", "member"), "b": F.greatest("id", "member")})
    alone = cut_lineage(pair.join(linked, ["a", "b"], "left_anti").select("id", "member"))
    if alone.isEmpty():
        return accepted
    for side in ("a", "b"):
        more = accepted.join(alone.withColumnRenamed("id", side), side).withColumn(side, F.col("member")).select("a", "b", "p", "shared")
        accepted = accepted.unionByName(more).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "p", "shared")
    return accepted.groupBy("a", "b").agg(F.max("p").alias("p"), F.max("shared").alias("shared"))


def settled_by_rounds(accepted: DataFrame, full: DataFrame, forbids: tuple[bool, bool]) -> DataFrame:
    """What ``settle`` gives, for components of any size: a link that comes first among those of both its clusters is decided at once.

    Nothing that is decided later can touch these two clusters before, so the order of ``settle`` is
    kept. Each round is a few joins of the links that are left; every cluster with links is decided
    about, or waits for one that is.
    """
    rank = F.struct((~F.col("shared")).alias("s"), (-F.col("p")).alias("q"), "o", "a", "b")
    links = accepted.select(F.col("a").alias("x"), F.col("b").alias("y"), rank.alias("rank"))
    nodes = accepted.select(F.col("a").alias("id")).unionByName(accepted.select(F.col("b").alias("id"))).distinct()
    none = lambda c, on: F.coalesce(F.col(c), F.array().cast(_STRINGS)) if on else F.array().cast(_STRINGS)
    held = nodes.join(full, "id").select("id", none("handles", forbids[0]).alias("handles"), none("companies", forbids[1]).alias("companies"), F.filter("names", lambda n: F.length(n["given"]) > 1).alias("names"))
    held = cut_lineage(held)
    home = cut_lineage(nodes.select(F.col("id").alias("node"), F.col("id").alias("cluster")))
    links = cut_lineage(links.groupBy("x", "y").agg(F.min("rank").alias("rank")))
    kind = full.schema["id"].dataType
    verdict = T.StructType([T.StructField("x", kind), T.StructField("y", kind), T.StructField("joins", T.BooleanType())])

    def decide(x, y, shared, h, c, n, h2, c2, n2):
        differ = any(s and t and not set(s) & set(t) for s, t in ((h, h2), (c, c2)))
        names = [{(v["given"], v["family"]) for v in m or []} for m in (n, n2)]
        yield x, y, shared or not (differ or _contradict(*names))

    while not links.isEmpty():
        both = links.select(F.col("x").alias("c"), "rank").unionByName(links.select(F.col("y").alias("c"), "rank"))
        first = both.groupBy("c").agg(F.min("rank").alias("first"))
        ready = links.join(first.select(F.col("c").alias("x"), F.col("first").alias("fx")), "x").join(first.select(F.col("c").alias("y"), F.col("first").alias("fy")), "y").filter("rank = fx AND rank = fy")
        side = lambda c: held.select(F.col("id").alias(c), F.struct("handles", "companies", "names").alias(f"_{c}"))
        known = ready.join(side("x"), "x").join(side("y"), "y").select("x", "y", (~F.col("rank.s")).alias("shared"), "_x.handles", "_x.companies", "_x.names", *[F.col(f"_y.{f}").alias(f"{f}2") for f in ("handles", "companies", "names")])
        decided = cut_lineage(_rows(known, decide, verdict))
        moves = decided.filter("joins").select(F.col("y").alias("cluster"), F.col("x").alias("to"))
        home = cut_lineage(home.join(moves, "cluster", "left").select("node", F.coalesce("to", "cluster").alias("cluster")))
        owner = held.join(moves.withColumnRenamed("cluster", "id"), "id", "left").withColumn("id", F.coalesce("to", "id"))
        union = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        held = cut_lineage(owner.groupBy("id").agg(union("handles"), union("companies"), union("names")))
        left = links.join(decided.select("x", "y"), ["x", "y"], "left_anti")
        for c in ("x", "y"):
            left = left.join(moves.select(F.col("cluster").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        links = cut_lineage(left.filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "rank").groupBy("x", "y").agg(F.min("rank").alias("rank")))
    inside = accepted.join(home.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), "a").join(home.select(F.col("node").alias("b"), F.col("cluster").alias("cb")), "b").filter("ca = cb")
    weakest = inside.groupBy(F.col("ca").alias("cluster")).agg(F.min("p").alias("weakest"))
    grouped = block_pairs(home.select(F.col("cluster").alias("key"), F.lit(None).cast("int").alias("side"), F.col("node").alias("id")))
    named = grouped.join(home.select(F.col("node").alias("a"), "cluster"), "a").join(weakest, "cluster").join(inside.select("a", "b", "p"), ["a", "b"], "left")
    return named.select("a", "b", F.coalesce("p", "weakest").alias("confidence"))


def _settled(accepted: DataFrame, components: DataFrame, full: DataFrame, forbids: tuple[bool, bool]) -> DataFrame:
    kind = full.schema["id"].dataType
    member = components.join(full.select(F.col("id").alias("node"), "handles", "companies", "names"), "node")
    nodes = member.select("component", F.col("node").alias("a"), F.lit(None).cast(kind).alias("b"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("boolean").alias("shared"), F.lit(None).cast("long").alias("o"), "handles", "companies", "names")
    edges = accepted.join(components.select(F.col("node").alias("a"), "component"), "a").select("component", "a", "b", "p", "shared", "o", F.lit(None).cast(_STRINGS).alias("handles"), F.lit(None).cast(_STRINGS).alias("companies"), F.lit(None).cast(_NAME).alias("names"))
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("confidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        current: object = None
        own: dict = {}
        links: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            rows = settle(links, own, forbids) if own else []
            for k in range(0, len(rows), 20_000):
                part = rows[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], f.type) for i, f in enumerate(target)], schema=target)

        for batch in batches:
            for component, a, b, p, shared, o, handles, companies, names in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if component != current:
                    yield from close()
                    own, links, current = {}, [], component
                if b is None:
                    own[a] = (handles or [], companies or [], [(n["given"], n["family"]) for n in names or []])
                else:
                    links.append((a, b, p, shared, o))
        yield from close()

    rows = nodes.unionByName(edges).repartition("component").sortWithinPartitions("component", F.col("b").asc_nulls_first(), "a")
    return rows.select("component", "a", "b", "p", "shared", "o", "handles", "companies", "names").mapInArrow(run, schema)
