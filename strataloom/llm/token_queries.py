"""Queries on the tokens of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.mixing import mix, plan, report, source_name
from strataloom.llm.tokens import encode
from strataloom.session import cut_lineage
from strataloom.sources.tables import read_table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens."""
    return encode(read_table(spark, sf_dir, "documents", "doc_id", "text"), "text").select("doc_id", "ids")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = read_table(spark, sf_dir, "documents", "doc_id", "text", "source").withColumn("source", source_name(F.col("source")))
    return cut_lineage(encode(named, "text").select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens")))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "mix_targets").withColumn("source", source_name(F.col("source")))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix and how often each is used."""
    sizes = _sizes(spark, sf_dir)
    return mix(sizes, plan(sizes, _targets(spark, sf_dir)), "doc_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual shares and repeats of each mix's sources."""
    sizes = _sizes(spark, sf_dir)
    planned = plan(sizes, _targets(spark, sf_dir))
    return report(mix(sizes, planned, "doc_id"), planned)


QUERIES = {"p7_ids": p7_ids, "p8_mix": p8_mix, "p8_report": p8_report}
ORACLE: dict[str, str] = {}
