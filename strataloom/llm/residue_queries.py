"""Queries on template residue in the web artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.residue import find_residue, template_table, without_residue
from strataloom.sources.tables import read_table

FIELDS = ["title", "description"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls whose title or description is about no page."""
    return find_residue(read_table(spark, sf_dir, "web_artifacts", "url", "host", *FIELDS), "url", "host", FIELDS).filter("url IS NOT NULL").select("url").distinct()


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web artifacts without these."""
    return without_residue(read_table(spark, sf_dir, "web_artifacts"), "url", "host", FIELDS)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls per field and class of residue."""
    found = find_residue(read_table(spark, sf_dir, "web_artifacts", "url", "host", *FIELDS), "url", "host", FIELDS)
    return found.groupBy("field", "residue").agg(F.count(F.lit(1)).alias("n_urls"))


def p6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of titles and descriptions with their verdict, and how many texts, hosts and urls share each."""
    return template_table(read_table(spark, sf_dir, "web_artifacts", "url", "host", *FIELDS), "url", "host", FIELDS).withColumnRenamed("n_keys", "n_urls")


QUERIES = {"p6_found": p6_found, "p6_templates": p6_templates, "p6_clean": p6_clean, "p6_report": p6_report}
ORACLE: dict[str, str] = {}
