"""Queries on the subject areas of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.subjects import assign
from strataloom.sources.tables import read_table


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return assign(documents, "doc_id", "text", read_table(spark, sf_dir, "subject_labels", "doc_id", "subject"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects that each document deals with."""
    listed = read_table(spark, sf_dir, "subject_areas", "subject").distinct()
    return _assigned(spark, sf_dir).join(F.broadcast(listed), "subject", "left_semi").select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters per subject and language, with the mean evidence."""
    documents = read_table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars")
    joined = _assigned(spark, sf_dir).join(documents, "doc_id")
    return joined.groupBy("subject", "lang").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").alias("n_chars"), F.avg("evidence").alias("mean_evidence"))


QUERIES = {"p9_found": p9_found, "p9_composition": p9_composition}
ORACLE: dict[str, str] = {}
