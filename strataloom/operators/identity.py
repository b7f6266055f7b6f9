"""Clusters of identities by mail addresses, and rules that mark automatic accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.graph import connected_components

# Patterns of accounts that no person uses, with their probability; the greatest holds.
BOT_RULES = [("login_suffix", "login", r"\[bot\]$", 0.99), ("typename", "account_type", r"(?i)^bot$", 1.0), ("automation_word", "login", r"(?i)(^|[-_])(ci|bot|automation|deploy|release)([-_]|$)", 0.75)]


def bot_probability(login: Column, account_type: Column) -> tuple[Column, Column]:
    """(probability, names of the rules that hold) by ``BOT_RULES``."""
    source = {"login": login, "account_type": account_type}
    hit = lambda c, p: F.coalesce(source[c].rlike(p), F.lit(False))
    most = F.greatest(*[F.when(hit(c, p), F.lit(w)).otherwise(0.0) for _, c, p, w in BOT_RULES])
    return most, F.array_compact(F.array(*[F.when(hit(c, p), F.lit(n)) for n, c, p, _ in BOT_RULES]))


def mail_clusters(identities: DataFrame, key: str, mails: str, login: str) -> DataFrame:
    """(``key``, cluster): identities that share an address, case aside, unless more than one login does: such addresses join nobody.

    A row of an address is linked to the least of its identities, so an address of many rows makes
    as many links, not their square; components are the clusters, named by their least key.
    """
    rows = identities.select(key, F.col(login).alias("_login"), F.explode_outer(F.transform(mails, lambda m: F.lower(F.trim(m)))).alias("_mail"))
    usable = rows.filter("_mail IS NOT NULL").groupBy("_mail").agg(F.min(key).alias("_first"), F.count_distinct(F.lower("_login")).alias("_logins")).filter("_logins <= 1")
    links = rows.join(usable, "_mail").select(F.col(key).alias("src"), F.col("_first").alias("dst"))
    found = connected_components(links)
    return identities.select(key).distinct().join(found.select(F.col("node").alias(key), F.col("component").alias("cluster")), key, "left").withColumn("cluster", F.coalesce("cluster", key))
