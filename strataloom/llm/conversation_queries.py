"""Queries that rebuild the review threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.conversations import has_text, reassemble, verdicts, with_roles
from strataloom.sources.tables import read_table


def _rows(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    names = {"thread_id": "thread_id", "comment_id": "message_id", "reply_to_id": "reply_to", "position_in_thread": "position", "author_login": "author", "body_text": "body", "created_at": "created_at", "computed_at": "fetched_at"}
    return read_table(spark, sf_dir, "review_comments", *names, *more).withColumnsRenamed(names)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads whose conversation is to be dropped."""
    rows = _rows(spark, sf_dir)
    return verdicts(reassemble(rows.withColumn("has_text", has_text(F.col("body"))).drop("body"))).filter(F.size("defects") > 0).select("thread_id")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads per defect."""
    rows = _rows(spark, sf_dir)
    found = verdicts(reassemble(rows.withColumn("has_text", has_text(F.col("body"))).drop("body")))
    return found.select(F.explode("defects").alias("defect")).groupBy("defect").agg(F.count(F.lit(1)).alias("n_threads"))


def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the conversations that are kept, with the speaker's role."""
    rows = _rows(spark, sf_dir, "author_typename", "pr_id")
    pulls = read_table(spark, sf_dir, "pull_requests", "pr_id", "author_login", "computed_at").filter("pr_id IS NOT NULL")
    owners = pulls.groupBy("pr_id").agg(F.max(F.struct("computed_at", "author_login")).alias("r")).select("pr_id", F.col("r.author_login").alias("owner"))
    kept = reassemble(rows).filter(F.size("defects") == 0)
    return with_roles(kept, owners, "pr_id").select("thread_id", F.col("turn").cast("long").alias("turn"), F.col("message_id").alias("comment_id"), "role", F.col("body").alias("body_text"))


_BLANK = r"[\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{2800}\x{3164}\x{FE00}-\x{FE0F}]*"

_P1 = f"""
WITH RECURSIVE c AS (SELECT * FROM review_comments WHERE thread_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY computed_at DESC) = 1),
t AS (SELECT c.*, p.position_in_thread AS parent, count(*) OVER (PARTITION BY c.thread_id) AS n,
    NOT coalesce(regexp_full_match(c.body_text, '{_BLANK}'), TRUE) AS shows
  FROM c LEFT JOIN c p ON p.comment_id = c.reply_to_id AND p.thread_id = c.thread_id),
v AS (SELECT thread_id,
    count(DISTINCT position_in_thread) FILTER (position_in_thread BETWEEN 0 AND n - 1) <> count(*) AS positions,
    NOT bool_or(shows) AS no_text,
    count(DISTINCT lower(author_login)) < 2 AS one_voice,
    coalesce(bool_or(position_in_thread = 0 AND reply_to_id IS NOT NULL), FALSE) AS opener_replies,
    coalesce(bool_or(position_in_thread <> 0 AND NOT coalesce(parent < position_in_thread, FALSE)), FALSE) AS bad_reply
  FROM t GROUP BY thread_id)
"""
_KEPT = "positions OR no_text OR one_voice OR opener_replies OR bad_reply"

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_turns": p1_turns}
ORACLE = {
    "p1_found": _P1 + f"SELECT thread_id FROM v WHERE {_KEPT}",
    "p1_turns": _P1
    + f""", k AS (SELECT * FROM t WHERE thread_id IN (SELECT thread_id FROM v WHERE NOT ({_KEPT}))),
walk AS (SELECT comment_id, 0 AS level, created_at AS ready FROM k WHERE reply_to_id IS NULL
  UNION ALL SELECT k.comment_id, level + 1, greatest(ready, k.created_at) FROM walk JOIN k ON k.reply_to_id = walk.comment_id),
pulls AS (SELECT pr_id, lower(author_login) AS owner FROM pull_requests QUALIFY row_number() OVER (PARTITION BY pr_id ORDER BY computed_at DESC) = 1)
SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY ready, level, created_at, position_in_thread, comment_id) - 1 AS turn, comment_id,
  CASE WHEN author_login IS NULL THEN NULL WHEN author_typename = 'Bot' OR suffix(author_login, '[bot]') THEN 'bot' WHEN lower(author_login) = owner THEN 'author' ELSE 'reviewer' END AS role, body_text
FROM k JOIN walk USING (comment_id) LEFT JOIN pulls USING (pr_id)""",
}
