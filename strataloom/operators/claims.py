"""Claims with evidence: registry and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def register(claims: DataFrame) -> DataFrame:
    """(claim_id, claim_type, subject, sentence, evidence): claims with evidence, each once.

    ``claims``: claim_type, subject, sentence, evidence (ARRAY<STRING>). Blanks of the sentence are
    taken together; a claim without evidence is none. The id is a hash of type, subject, sentence
    and sorted evidence.
    """
    clean = claims.select("claim_type", F.col("subject").cast("string").alias("subject"), F.trim(F.regexp_replace("sentence", r"\s+", " ")).alias("sentence"), F.array_sort(F.array_distinct(F.array_compact("evidence"))).alias("evidence"))
    kept = clean.filter((F.size("evidence") > 0) & (F.col("sentence") != ""))
    text = F.concat_ws("|", "claim_type", "subject", "sentence", F.array_join("evidence", ","))
    return kept.withColumn("claim_id", F.concat(F.lit("claim/"), F.substring(F.sha2(text, 256), 1, 20))).dropDuplicates(["claim_id"]).select("claim_id", "claim_type", "subject", "sentence", "evidence")


def audit(claims: DataFrame, referenced: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(problem, id): references to no claim (``dangling``), claims nobody refers to (``unreferenced``), evidence that is no artifact (``orphan_evidence``)."""
    ids, used, known = claims.select(F.col("claim_id").alias("id")), referenced.select(F.col("claim_id").alias("id")).dropna().distinct(), artifacts.select(F.col("artifact_id").alias("id")).dropna().distinct()
    cited = claims.select(F.explode("evidence").alias("id")).distinct()
    tag = lambda df, name: df.select(F.lit(name).alias("problem"), "id")
    return tag(used.join(ids, "id", "left_anti"), "dangling").unionByName(tag(ids.join(used, "id", "left_anti"), "unreferenced")).unionByName(tag(cited.join(known, "id", "left_anti"), "orphan_evidence"))
