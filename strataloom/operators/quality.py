"""Data quality: declared rules over tables, content hashes, reconciliation, completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """What must hold for a table: columns never NULL, keys, references {column: (table, column)}, columns never below 0, ranges, enumerations."""

    required: Sequence[str] = ()
    unique: Sequence[Sequence[str]] = ()
    references: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    not_negative: Sequence[str] = ()
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    values: Mapping[str, Sequence[str]] = field(default_factory=dict)


def check(tables: Mapping[str, DataFrame], contracts: Mapping[str, Contract]) -> DataFrame:
    """(table_name, rule, subject, n_failed): rows that break each rule, also where none do.

    Rules on single rows are counted in one pass over the table; keys and references take a shuffle
    each. NULL breaks only ``required``; a missing referenced table makes every reference an orphan.
    """
    parts = []
    for name, contract in contracts.items():
        df = tables[name]
        tests: dict[tuple[str, str], Column] = {}
        for c in contract.required:
            tests["required", c] = F.col(c).isNull()
        for c in contract.not_negative:
            tests["not_negative", c] = F.col(c) < 0
        for c, (low, high) in contract.ranges.items():
            tests["range", c] = (F.col(c) < low) | (F.col(c) > high)
        for c, allowed in contract.values.items():
            tests["values", c] = ~F.col(c).isin(list(allowed))
        if tests:
            counted = df.agg(*[F.count_if(t).alias(f"_{i}") for i, t in enumerate(tests.values())])
            rows = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("subject"), F.col(f"_{i}").alias("n_failed")) for i, (rule, c) in enumerate(tests)])
            parts.append(counted.select(F.lit(name).alias("table_name"), F.inline(rows)))
        for key in contract.unique:
            repeated = df.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
            parts.append(repeated.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_failed")).select(F.lit(name).alias("table_name"), F.lit("unique").alias("rule"), F.lit(",".join(key)).alias("subject"), "n_failed"))
        for c, (other, key) in contract.references.items():
            held = df.select(F.col(c).alias("_k")).filter("_k IS NOT NULL").groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
            if other in tables:
                held = held.join(tables[other].select(F.col(key).alias("_k")).distinct(), "_k", "left_anti")
            parts.append(held.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_failed")).select(F.lit(name).alias("table_name"), F.lit("references").alias("rule"), F.lit(c).alias("subject"), "n_failed"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def uniform(tables: Mapping[str, DataFrame], stamps: Mapping[str, str]) -> DataFrame:
    """(table_name, stamp, n_versions, is_uniform): whether a table's rows all carry one version."""
    out = None
    for name, c in stamps.items():
        one = tables[name].agg(F.count_distinct(c).alias("n_versions"), F.count_if(F.col(c).isNull()).alias("_nulls")).select(F.lit(name).alias("table_name"), F.lit(c).alias("stamp"), "n_versions", ((F.col("n_versions") == 1) & (F.col("_nulls") == 0)).alias("is_uniform"))
        out = one if out is None else out.unionByName(one)
    return out


def row_text(columns: Sequence[str]) -> Column:
    """A row as text that tells NULL, empty and values apart: what its hash is taken of."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns])


def content_hash(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(n_rows, xor_hash, sum_hash) of a table whatever the order of its rows and columns, in one pass without a sort."""
    columns = sorted(c for c in df.columns if c not in exclude)
    row = F.conv(F.substring(F.sha2(row_text(columns), 256), 1, 15), 16, 10).cast("bigint")
    return df.select(row.alias("_h")).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor("_h"), F.lit(0)).alias("xor_hash"), F.coalesce(F.sum(F.pmod("_h", F.lit(1_000_000_007))), F.lit(0)).alias("sum_hash"))


def exact_hash(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(content_hash): SHA-256 of the sorted rows' hashes, for tables that fit one task."""
    columns = sorted(c for c in df.columns if c not in exclude)
    rows = df.select(F.sha2(row_text(columns), 256).alias("_h"))
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), "\n"), 256).alias("content_hash"))


def completeness(df: DataFrame, at: str, columns: Sequence[str]) -> DataFrame:
    """(month, n_rows, has_<c>...): rows a month and how many of them know each column."""
    return df.groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"has_{c}") for c in columns])


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, n_rows, n_missing, share) of each column."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_{c}").alias("n_missing")) for c in columns])
    return counted.select("n_rows", F.inline(rows)).select("field", "n_rows", "n_missing", F.round(F.try_divide("n_missing", "n_rows"), 6).alias("share"))


def reconcile_counts(counts: DataFrame, tolerance: float) -> DataFrame:
    """``counts`` (name, own, independent) with difference, share and whether it lies within the tolerance; NULL if either is unknown."""
    gap = F.abs(F.col("own") - F.col("independent"))
    share = F.try_divide(gap, F.greatest("own", "independent"))
    return counts.select("name", "own", "independent", gap.alias("difference"), F.round(share, 6).alias("share"), (share <= tolerance).alias("agrees"))


def search_secrets(texts: DataFrame, key: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """(``key``, pattern): texts in which a forbidden pattern is found."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns.items()]))
    return texts.select(key, F.explode(hits).alias("pattern"))
