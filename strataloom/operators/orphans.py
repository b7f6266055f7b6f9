"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.skew import heavy_keys, lookup_join
from strataloom.session import cut_lineage


def arrivals(targets: DataFrame, key: str, kinds: list[str], arrived: Column | None) -> DataFrame:
    """(kind, target, first_arrival) of the rows of ``targets`` for each of ``kinds``; without ``arrived`` a target has always been there."""
    at = arrived if arrived is not None else F.lit(None)
    rows = targets.select(F.col(key).cast("string").alias("target"), at.cast("timestamp").alias("first_arrival")).filter(F.col("target").isNotNull())
    return rows.select(F.explode(F.array(*map(F.lit, kinds))).alias("kind"), "target", "first_arrival")


def references(df: DataFrame, table: str, field: str, key: str, reference: Column, kind: Column | None, period: Column, arrived: Column) -> DataFrame:
    """The rows that refer to something: (table_name, field, record_key, target, kind, period, arrived)."""
    return df.select(
        F.lit(table).alias("table_name"),
        F.lit(field).alias("field"),
        F.col(key).cast("string").alias("record_key"),
        reference.cast("string").alias("target"),
        (kind if kind is not None else F.lit(None)).cast("string").alias("kind"),
        period.alias("period"),
        arrived.alias("arrived"),
    ).filter(F.col("target").isNotNull())


def loose_keys(rows: DataFrame, targets: DataFrame, deleted: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, found, first_arrival, gone) of the keys that some reference cannot use: absent, or first there after a reference was.

    The references are counted per key first, so a key is one row however many refer to it. Heavy
    keys are checked by broadcasting these keys to the targets; the remaining ones by a shuffled
    anti-join, which keeps the keys without a target and those of a later one.
    """
    rows = rows.select(*by, "arrived")
    per_key = cut_lineage(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("arrived").alias("earliest")))
    heavy = cut_lineage(heavy_keys(per_key, by, per_key))
    first = lambda df: df.groupBy(*by).agg(F.min("first_arrival").alias("first_arrival")).withColumn("found", F.lit(True))
    few = F.broadcast(heavy)
    hot = per_key.join(few, by, "left_semi").join(F.broadcast(first(targets.join(few, by, "left_semi"))), by, "left")
    cold = per_key.join(few, by, "left_anti").join(first(targets.join(few, by, "left_anti")), by, "left")
    unusable = F.col("found").isNull() | (F.col("first_arrival") > F.col("earliest"))
    loose = hot.unionByName(cold).filter(unusable)
    gone = deleted.filter(F.col("target").isNotNull()).select("target").distinct().withColumn("gone", F.lit(True))
    return cut_lineage(loose.join(gone, "target", "left").select(*by, F.coalesce("found", F.lit(False)).alias("found"), "first_arrival", F.coalesce("gone", F.lit(False)).alias("gone")))


def orphans(rows: DataFrame, targets: DataFrame, deleted: DataFrame, by: list[str]) -> DataFrame:
    """Records of ``rows`` (``references``) without a usable target: table_name, field, record_key, target, kind, period, arrived, status.

    ``late``: the target exists and first arrived after the referring record; ``deleted``: it does
    not exist and its key is in ``deleted`` (one column, target); ``missing``: neither. A target
    whose first arrival is NULL is never late, nor is a reference whose own is NULL. ``targets``
    (``arrivals``) may repeat keys. Only rows of loose keys are looked at one by one; repeated rows
    of a record are taken together, and one that names several targets counts once for each.
    """
    loose = loose_keys(rows, targets, deleted, by)
    touched = lookup_join(rows, loose, by).filter("found IS NOT NULL")
    keys = ["table_name", "field", "record_key", "target", "kind"]
    records = touched.groupBy(*keys, "found", "first_arrival", "gone").agg(F.min("period").alias("period"), F.min("arrived").alias("arrived"))
    late = F.coalesce(F.col("first_arrival") > F.col("arrived"), F.lit(False))
    status = F.when(F.col("found"), F.when(late, "late")).when(F.col("gone"), "deleted").otherwise("missing")
    return records.withColumn("status", status).filter("status IS NOT NULL").select(*keys, "period", "arrived", "status")


def orphan_report(rows: DataFrame, targets: DataFrame, deleted: DataFrame, by: list[str]) -> DataFrame:
    """(table_name, field, period, status, n_records) of ``orphans``."""
    return orphans(rows, targets, deleted, by).groupBy("table_name", "field", "period", "status").agg(F.count(F.lit(1)).alias("n_records"))
