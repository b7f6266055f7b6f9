"""Rules over paths: globs, ordered rules, longest prefixes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PIECES = re.compile(r"/\*\*$|\*\*/|\*\*|\*|\?|\[[^\]]*\]|.", re.DOTALL)
_MEANING = {"/**": "(?:/.*)?", "**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_pattern(glob: str) -> str:
    """The anchored regular expression of a path glob: ``*`` stays in a directory, ``**/`` is any directories or none, a last ``/**`` is the directory itself as well."""
    piece = lambda p: _MEANING.get(p) or (p if p[0] == "[" and len(p) > 1 else re.escape(p))
    return "^" + "".join(piece(m.group()) for m in _PIECES.finditer(glob)) + "$"


def labels(path: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """The labels of which a glob matches a path, in the order of the rules."""
    hit = lambda globs: F.coalesce(path.rlike("|".join(glob_pattern(g) for g in globs)), F.lit(False))
    return F.array_compact(F.array(*[F.when(hit(globs), F.lit(name)) for name, globs in rules.items()]))


def first_label(path: Column, rules: Mapping[str, Sequence[str]], default: str | None = None) -> Column:
    """The first label of which a glob matches."""
    return F.coalesce(F.get(labels(path, rules), 0), F.lit(default))


def match_rules(paths: DataFrame, path: str, rules: DataFrame, last: bool = False) -> DataFrame:
    """``paths`` with rule_order, rule_name of the first (or last) rule whose pattern matches; NULL without one.

    ``rules``: rule_order, pattern (a regular expression), rule_name; configuration, a few hundred
    rows. Distinct paths are matched, then joined back, so a path of many rows is matched once.
    """
    distinct = paths.select(path).dropna().distinct()
    pick = F.max_by if last else F.min_by
    hits = distinct.join(F.broadcast(rules), F.expr(f"{path} rlike pattern")).groupBy(path).agg(pick(F.struct("rule_order", "rule_name"), F.col("rule_order")).alias("_r"))
    return paths.join(hits, path, "left").select(*paths.columns, F.col("_r.rule_order").alias("rule_order"), F.col("_r.rule_name").alias("rule_name"))


def longest_prefix(paths: DataFrame, path: str, owners: DataFrame, directory: str) -> DataFrame:
    """``paths`` with the columns of the owner of the deepest directory above each path; NULL without one.

    Each path is exploded into its directories, which are joined by equality; the directory ``""``
    owns everything. ``owners`` is distinct by ``directory``.
    """
    distinct = paths.select(path).dropna().distinct()
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    climbed = distinct.select(path, F.explode(above).alias(directory))
    others = [c for c in owners.columns if c != directory]
    best = climbed.join(owners, directory).groupBy(path).agg(F.max_by(F.struct(directory, *others), F.length(directory)).alias("_o"))
    return paths.join(best, path, "left").select(*paths.columns, *[F.col(f"_o.{c}").alias(c) for c in [directory, *others]])


def first_found(wanted: DataFrame, key: str, candidates: str, known: DataFrame, name: str) -> DataFrame:
    """``wanted`` with ``name``: the first of the candidate names in the array ``candidates`` that is in ``known``; NULL if none is."""
    ranked = wanted.select(key, F.posexplode(candidates).alias("_rank", name))
    hits = ranked.join(known.select(name).distinct(), name, "left_semi").groupBy(key).agg(F.min_by(name, "_rank").alias(name))
    return wanted.join(hits, key, "left")
