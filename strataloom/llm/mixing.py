"""Mixing of sources to target shares of tokens, by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.skew import running_sums

#: Expected copies are decimals, so that prefix sums are exact whatever their order.
_COPIES = "decimal(38,12)"


def source_name(source: Column) -> Column:
    """One spelling a source: lower case, blanks and hyphens as underscores; blank is NULL."""
    name = F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"[\s\p{Z}\p{Cf}_-]+", " "))), " ", "_")
    return F.when(name != "", name)


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """What each source of a mix is to give: the columns of ``targets`` and
    (n_documents, available, wanted, expected_copies).

    ``sizes``: source, n_tokens, one row a document. ``targets``: mix_name, source, target_share,
    max_repeats. A mix is to hold ``total`` tokens, by default as many as its sources have together;
    expected_copies of a document is wanted / available, at most max_repeats, and 0 for a source
    without tokens or share; a NULL max_repeats caps nothing. ``targets`` is configuration, a few rows a mix.
    """
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("available"))
    known = targets.join(have, "source", "left").fillna(0, ["n_documents", "available"])
    size = known.groupBy("mix_name").agg(F.sum("available").alias("_total"))
    wanted = F.coalesce("target_share", F.lit(0.0)) * (F.lit(total) if total is not None else F.col("_total"))
    copies = F.when(F.col("available") > 0, F.least(F.col("wanted") / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    planned = known.join(size, "mix_name").withColumn("wanted", wanted.cast("double")).withColumn("expected_copies", F.floor(copies * 1e12).cast("decimal(38,0)") / F.lit(10**12).cast("decimal(13,0)"))
    return planned.withColumn("expected_copies", F.col("expected_copies").cast(_COPIES)).select("mix_name", "source", "target_share", "max_repeats", "n_documents", "available", "wanted", "expected_copies")


def mix(sizes: DataFrame, planned: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """(mix_name, source, ``key``, n_tokens, copies) of the documents that a mix uses, copies at least 1.

    Systematic sampling: the expected copies of a source's documents are summed one after the
    other, a random offset below 1 for the mix and source is added, and a document is used once for
    each whole number its sum passes. Copies therefore differ from their expectation by less than
    one, for each document and for the source as a whole, and never exceed max_repeats. Documents
    without a listed source are in no mix.
    """
    rates = planned.filter("expected_copies > 0").select("mix_name", "source", "expected_copies")
    wanted = sizes.join(F.broadcast(rates), "source")
    summed = running_sums(wanted, ["mix_name", "source"], key, F.col("expected_copies"), "_before")
    offset = (F.pmod(F.xxhash64(F.lit(seed), "mix_name", "source"), F.lit(10**9)) / F.lit(1e9)).cast(_COPIES)
    passed = F.floor(F.col("_before") + offset + F.col("expected_copies")) - F.floor(F.col("_before") + offset)
    return summed.withColumn("copies", passed.cast("long")).filter("copies > 0").select("mix_name", "source", key, "n_tokens", "copies")


def report(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """Per mix and source: target and actual share of the mix's tokens, documents, repeats, and whether it falls short.

    A source falls short if max_repeats, or its having no documents, keeps it below what is wanted.
    """
    used = mixed.groupBy("mix_name", "source").agg(
        F.count(F.lit(1)).alias("documents_used"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens")
    )
    joined = planned.join(used, ["mix_name", "source"], "left").fillna(0, ["documents_used", "copies", "most_repeats", "tokens"])
    whole = joined.groupBy("mix_name").agg(F.sum("tokens").alias("_whole"))
    short = F.col("wanted") > F.col("available") * F.col("max_repeats")
    return joined.join(whole, "mix_name").select(
        "mix_name", "source", "target_share", F.try_divide("tokens", "_whole").alias("actual_share"), "n_documents", "documents_used", "copies", "most_repeats", "tokens", short.alias("falls_short")
    )
