"""Joins and running sums in which one key may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import cut_lineage, shuffle_partitions

#: A key with at least this share of all rows is heavy, so there are at most 1 / share of them.
HEAVY_SHARE = 0.001
#: Below so many rows a key is not worth a broadcast.
LEAST_HEAVY = 1_000
#: A table of up to so many rows is sent to every executor.
BROADCAST_ROWS = 50_000


def heavy_keys(df: DataFrame, by: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """The at most 1 / ``HEAVY_SHARE`` keys that hold that share of the rows; ``counts``: (``by``, n) if already there."""
    per_key = counts if counts is not None else df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = per_key.agg(F.sum("n")).scalar()
    return per_key.filter(F.col("n") >= F.greatest(F.lit(LEAST_HEAVY), HEAVY_SHARE * total)).select(*by)


def skew_left_join(left: DataFrame, right: DataFrame, by: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right``, which is distinct by ``by``: rows of heavy keys by broadcast of these keys, others by shuffle.

    Rows of ``left`` with a heavy key never move; the shuffled rest has no hot key. The heavy keys'
    answers, a few rows, are found in a job before, so that the plan of the join stays small; without
    any the join is an ordinary one.
    """
    by = list(by)
    heavy = heavy_keys(left, by, counts)
    new = [c for c in right.columns if c not in by]
    answers = cut_lineage(heavy.join(F.broadcast(right.join(F.broadcast(heavy), by, "left_semi")), by, "left").withColumn("_heavy", F.lit(True)))
    if answers.isEmpty():
        return left.join(right, by, "left")
    split = left.join(F.broadcast(answers), by, "left")
    hot = split.filter("_heavy").drop("_heavy")
    cold = split.filter("_heavy IS NULL").drop("_heavy", *new).join(right, by, "left")
    return hot.unionByName(cold)


def lookup_join(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """``left`` joined to ``right``, which is distinct by ``by``: by broadcast up to ``BROADCAST_ROWS`` rows, beyond by ``skew_left_join``.

    ``right`` is counted, so it should be a table or a checkpoint; the result is the same either way.
    """
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), list(by), "left")
    return skew_left_join(left, right, by)


def running_sums(df: DataFrame, group: Sequence[str], key: str, value: Column, name: str, buckets: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the group before this one, in the order of (hash bucket, key).

    Each group is cut into hash buckets of its key; sums run within a bucket and buckets are shifted
    by the sums of those before them, so that no task holds a whole group.
    """
    group = list(group)
    buckets = buckets or 4 * shuffle_partitions(df.sparkSession)
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).withColumn("_value", value)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_sum"))
    shifts = sums.withColumn("_shift", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*group, "_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("_inner", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    match = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_bucket"]]
    joined = summed.alias("a").join(shifts.alias("b"), match, "left")
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._inner") + F.col("b._shift")).alias(name))


def ranked(df: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the row's number from 0 within its group by ``order``, for groups larger than a task.

    Rows are range partitioned by group and order, counted per partition, and numbered within it.
    """
    sliced = cut_lineage(df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order).withColumn("_slice", F.spark_partition_id()))
    counts = sliced.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(group, "_slice").orderBy(*order)
    numbered = sliced.withColumn("_inner", F.row_number().over(inner) - 1)
    return numbered.join(shifts, [group, "_slice"]).withColumn(name, F.col("_inner") + F.col("_shift")).drop("_inner", "_shift", "_slice")
