"""Queries that bring the actors' accounts and identities together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.entities import match
from strataloom.sources.tables import read_table


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = read_table(spark, sf_dir, "actors", "actor_id", "login", "display_name", "emails", "git_names").withColumnRenamed("actor_id", "id")
    return match(people)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of actors that are one person."""
    return _matches(spark, sf_dir).select(F.col("a").alias("actor_id_a"), F.col("b").alias("actor_id_b"))


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """These pairs with their confidence, and whether identity_cluster_id joins them already."""
    clusters = read_table(spark, sf_dir, "actors", "actor_id", "identity_cluster_id").groupBy("actor_id").agg(F.max("identity_cluster_id").alias("c"))
    pairs = _matches(spark, sf_dir)
    joined = pairs.join(clusters.select(F.col("actor_id").alias("a"), F.col("c").alias("ca")), "a", "left").join(clusters.select(F.col("actor_id").alias("b"), F.col("c").alias("cb")), "b", "left")
    return joined.select(F.col("a").alias("actor_id_a"), F.col("b").alias("actor_id_b"), "confidence", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("clustered"))


QUERIES = {"p4_found": p4_found, "p4_matches": p4_matches}
ORACLE: dict[str, str] = {}
