"""Aggregates: entropy, percentiles of several kinds, shares, medians from frequencies, ordered weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entropy(rows: DataFrame, group: Sequence[str], value: str, base: float = 2.0) -> DataFrame:
    """(``group``, entropy, n_values): Shannon entropy of the values of a group, NULL values left out."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    # H = log(N) - sum(n log n) / N needs no second look at the groups
    total, weighted = F.sum("n"), F.sum(F.col("n") * F.log(F.col("n")))
    return counts.groupBy(*group).agg(((F.log(total) - weighted / total) / F.log(F.lit(base))).alias("entropy"), F.count(F.lit(1)).alias("n_values"))


def dominant(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(``group``, value, n, share): the most frequent value of a group, ties to the least."""
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*group).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("t"), F.sum("n").alias("total")).select(*group, f"t.{value}", "t.n", (F.col("t.n") / F.col("total")).alias("share"))


def histogram(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(``group``, histogram): MAP value to count, in order of the values."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(value), "n")))).alias("histogram"))


def sum_or_null(value: Column) -> Column:
    """Sum of a column, NULL if nothing is known or it adds up to 0."""
    return F.nullif(F.sum(F.coalesce(value, F.lit(0))), F.lit(0))


def upper_median(value: Column) -> Column:
    """The value at place n / 2 of n in order."""
    ordered = F.array_sort(F.collect_list(value))
    return F.get(ordered, (F.size(ordered) / 2).cast("int"))


def frequency_summary(table: DataFrame, group: str, value: str, n: str, top: int) -> DataFrame:
    """Mean, mode and its share, median, p05, p95 and the chance of being at most ``top`` from a frequency table (``group``, ``value``, ``n``).

    A quantile q is the least value up to which at least q of the group's total lies.
    """
    w = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = table.withColumn("_upto", F.sum(n).over(w)).withColumn("_total", F.sum(n).over(Window.partitionBy(group)))
    at = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_total"), F.col(value)))
    v, c = F.col(value), F.col(n)
    return summed.groupBy(group).agg(
        (F.sum(v * c) / F.sum(c)).alias("mean"), at(0.5).alias("median"), at(0.05).alias("p05"), at(0.95).alias("p95"), F.min_by(v, F.struct(-c, v)).alias("mode"), (F.max(c) / F.sum(c)).alias("mode_share"),
        (F.sum(F.when(v <= top, c).otherwise(0)) / F.sum(c)).alias("top_share"),
    )


def ordered_weights(rows: DataFrame, owner: str, value: str, key: str, coefficients: Sequence[float], headroom: float, most: float) -> DataFrame:
    """(``owner``, value, trace): the greatest entry plus the next ones by falling coefficients, these capped at ``headroom``, all at ``most``."""
    w = Window.partitionBy(owner).orderBy(F.col(value).desc(), F.col(key).asc())
    ranked = rows.filter(F.col(value).isNotNull()).withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= len(coefficients))
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in coefficients]), F.col("_rank"))
    parts = ranked.withColumn("_part", weight * F.col(value))
    first, rest = F.sum(F.when(F.col("_rank") == 1, F.col("_part")).otherwise(0.0)), F.sum(F.when(F.col("_rank") > 1, F.col("_part")).otherwise(0.0))
    out = F.least(F.lit(float(most)), first + F.least(F.lit(float(headroom)), rest))
    trace = F.array_sort(F.collect_list(F.struct(F.col("_rank").alias("rank"), F.col(key).alias("entry"), F.round("_part", 6).alias("part"))))
    return parts.groupBy(owner).agg(out.alias("value"), trace.alias("trace"))


def concentration(rows: DataFrame, owner: str, value: str, key: str) -> DataFrame:
    """(``owner``, top1_share, top3_share): how much of an owner's total its greatest entries hold."""
    w = Window.partitionBy(owner).orderBy(F.col(value).desc(), F.col(key).asc())
    ranked = rows.withColumn("_rank", F.row_number().over(w))
    upto = lambda k: F.try_divide(F.sum(F.when(F.col("_rank") <= k, F.col(value)).otherwise(0)), F.sum(value))
    return ranked.groupBy(owner).agg(upto(1).alias("top1_share"), upto(3).alias("top3_share"))


def rescale(rows: DataFrame, group: Sequence[str], value: str, most: float) -> DataFrame:
    """``rows`` with scaled: values of a group whose sum exceeds ``most`` shrunk to add up to it."""
    total = F.sum(value).over(Window.partitionBy(*group))
    return rows.withColumn("scaled", F.when(total > most, F.col(value) * most / total).otherwise(F.col(value)))
