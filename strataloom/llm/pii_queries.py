"""Queries on personal data in the texts of comments, issues and review comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.pii import find, mask
from strataloom.sources.tables import read_table

TABLES = {"comments": "comment_id", "issues": "issue_id", "review_comments": "comment_id"}


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [read_table(spark, sf_dir, t, k, "body_text").select(F.lit(t).alias("table_name"), F.col(k).alias("record_key"), F.col("body_text").alias("body")) for t, k in TABLES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of personal data in each record."""
    return find(_texts(spark, sf_dir)).filter("record_key IS NOT NULL").select("table_name", "record_key", "kind").distinct()


def p5_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with placeholders in place of personal data."""
    texts = _texts(spark, sf_dir)
    return mask(texts, find(texts)).select("table_name", "record_key", F.col("body_masked").alias("body_text"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per table and kind of personal data."""
    return p5_found(spark, sf_dir).groupBy("table_name", "kind").agg(F.count(F.lit(1)).alias("n_records"))


QUERIES = {"p5_found": p5_found, "p5_masked": p5_masked, "p5_report": p5_report}
ORACLE: dict[str, str] = {}
