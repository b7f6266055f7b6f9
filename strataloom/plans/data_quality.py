"""Queries on copies and references of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.orphans import arrivals, orphan_report, orphans, references
from strataloom.operators.reconcile import compare_copies, latest, whole_number
from strataloom.sources.tables import read_table

COUNTS = ["git_additions", "github_additions", "git_changed_files", "github_changed_files"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of the counts of Git and GitHub, and of the store and its export."""
    store = read_table(spark, sf_dir, "pr_anomalies", "pr_number", *COUNTS)
    side = lambda s: store.select("pr_number", F.col(f"{s}_additions").alias("additions"), F.col(f"{s}_changed_files").alias("changed_files")).filter(
        "additions IS NOT NULL OR changed_files IS NOT NULL"
    )
    counts = compare_copies(side("git"), side("github"), "pr_number", ["additions", "changed_files"])
    exported = read_table(spark, sf_dir, "pr_anomalies_export").select(
        F.regexp_extract("pr_ref", r"(\d+)\s*$", 1).try_cast("bigint").alias("pr_number"), "exported_at", *[whole_number(F.col(c)).alias(c) for c in COUNTS]
    )
    copies = compare_copies(store, latest(exported.filter("pr_number IS NOT NULL"), "pr_number", "exported_at", COUNTS), "pr_number", COUNTS)
    return (
        counts.select("pr_number", F.lit("git_github").alias("comparison"), "field")
        .unionByName(copies.select("pr_number", F.lit("store_export").alias("comparison"), "field"))
    )


def _number(c: str) -> str:
    """SQL of ``whole_number``."""
    t = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    plain = f"CASE WHEN regexp_full_match({t}, '[+-]?\\d{{1,3}}([ ,_''.]\\d{{3}})+') AND NOT regexp_full_match({t}, '[+-]?\\d{{1,3}}\\.\\d{{3}}') THEN regexp_replace({t}, '[ ,_''.]', '', 'g') WHEN regexp_full_match({t}, '[+-]?\\d{{1,3}}([ ,_'']\\d{{3}})+\\.0*') THEN regexp_replace({t}, '[ ,_'']', '', 'g') WHEN regexp_full_match({t}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN {t} END"
    return f"(SELECT CASE WHEN x = floor(x) THEN CAST(x AS BIGINT) END FROM (SELECT TRY_CAST({plain} AS DECIMAL(38,9)) AS x))"


P2_FOUND_SQL = f"""
WITH store AS (SELECT DISTINCT pr_number, {', '.join(COUNTS)} FROM pr_anomalies WHERE pr_number IS NOT NULL),
parsed AS (SELECT TRY_CAST(regexp_extract(pr_ref, '(\\d+)\\s*$', 1) AS BIGINT) AS pr_number, exported_at, {', '.join(f'{_number(c)} AS {c}' for c in COUNTS)} FROM pr_anomalies_export),
export AS (SELECT * FROM parsed WHERE pr_number IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY pr_number ORDER BY exported_at DESC NULLS LAST, {', '.join(f'{c} DESC NULLS LAST' for c in COUNTS)}) = 1),
sides AS (SELECT *, git_additions IS NOT NULL OR git_changed_files IS NOT NULL AS git, github_additions IS NOT NULL OR github_changed_files IS NOT NULL AS github FROM store)
SELECT pr_number, 'git_github' AS comparison, 'row_missing_left' AS field FROM sides WHERE github AND NOT git
UNION SELECT pr_number, 'git_github', 'row_missing_right' FROM sides WHERE git AND NOT github
UNION SELECT pr_number, 'git_github', 'additions' FROM sides WHERE git AND github AND git_additions IS DISTINCT FROM github_additions
UNION SELECT pr_number, 'git_github', 'changed_files' FROM sides WHERE git AND github AND git_changed_files IS DISTINCT FROM github_changed_files
UNION SELECT pr_number, 'store_export', 'row_missing_left' FROM export WHERE pr_number NOT IN (SELECT pr_number FROM store)
UNION SELECT pr_number, 'store_export', 'row_missing_right' FROM store WHERE pr_number NOT IN (SELECT pr_number FROM export)
""" + "".join(f"UNION SELECT s.pr_number, 'store_export', '{c}' FROM store s JOIN export e USING (pr_number) WHERE s.{c} IS DISTINCT FROM e.{c}\n" for c in COUNTS)


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    month = lambda c: F.date_format(c, "yyyy-MM")
    of = lambda name, *c: read_table(spark, sf_dir, name, *c)
    replies = of("review_comments", "comment_id", "reply_to_id", "created_at", "computed_at")
    threads = of("review_threads", "thread_id", "pr_id", "resolved_by_actor_id", "first_comment_at", "computed_at")
    comments = of("comments", "comment_id", "parent_id", "parent_kind", "created_at", "computed_at")
    arrived = F.col("computed_at")
    space = F.when(F.col("parent_kind").isNull(), "issue or pull_request").otherwise(F.col("parent_kind"))
    rows = (
        references(replies, "review_comments", "reply_to_id", "comment_id", F.col("reply_to_id"), F.lit("review_comment"), month("created_at"), arrived)
        .unionByName(references(threads, "review_threads", "pr_id", "thread_id", F.col("pr_id"), F.lit("pull_request"), month("first_comment_at"), arrived))
        .unionByName(references(threads, "review_threads", "resolved_by_actor_id", "thread_id", F.col("resolved_by_actor_id"), F.lit("actor"), month("first_comment_at"), arrived))
        .unionByName(references(comments, "comments", "parent_id", "comment_id", F.col("parent_id"), space, month("created_at"), arrived))
    )
    targets = (
        arrivals(of("review_comments", "comment_id", "computed_at"), "comment_id", ["review_comment"], arrived)
        .unionByName(arrivals(of("pull_requests", "pr_id", "computed_at"), "pr_id", ["pull_request", "issue or pull_request"], arrived))
        .unionByName(arrivals(of("issues", "issue_id", "computed_at"), "issue_id", ["issue", "issue or pull_request"], arrived))
        .unionByName(arrivals(of("actors", "actor_id"), "actor_id", ["actor"], None))
    )
    return rows, targets, of("deleted_records", "record_id").select(F.col("record_id").alias("target"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of the project's tables that lead to no record, or to one that came later."""
    found = orphans(*_references(spark, sf_dir), ["kind", "target"])
    return found.select("table_name", "field", "record_key", "status").distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references of ``p3_found`` counted per table, field, month and status."""
    return orphan_report(*_references(spark, sf_dir), ["kind", "target"])


_P3 = """
WITH
pulls AS (SELECT pr_id AS id, min(computed_at) AS arrived FROM pull_requests WHERE pr_id IS NOT NULL GROUP BY 1),
iss AS (SELECT issue_id AS id, min(computed_at) AS arrived FROM issues WHERE issue_id IS NOT NULL GROUP BY 1),
com AS (SELECT comment_id AS id, min(computed_at) AS arrived FROM review_comments WHERE comment_id IS NOT NULL GROUP BY 1),
act AS (SELECT DISTINCT actor_id AS id, NULL::TIMESTAMPTZ AS arrived FROM actors WHERE actor_id IS NOT NULL),
targets AS (SELECT 'review_comment' AS kind, * FROM com UNION ALL SELECT 'pull_request', * FROM pulls UNION ALL SELECT 'issue', * FROM iss UNION ALL SELECT 'actor', * FROM act
  UNION ALL SELECT 'either', id, min(arrived) FROM (FROM pulls UNION ALL FROM iss) GROUP BY id),
refs AS (
  SELECT 'review_comments' AS table_name, 'reply_to_id' AS field, comment_id AS record_key, reply_to_id AS target, 'review_comment' AS kind, strftime(min(created_at) AT TIME ZONE 'UTC', '%Y-%m') AS period, min(computed_at) AS arrived FROM review_comments WHERE reply_to_id IS NOT NULL GROUP BY 3, 4
  UNION ALL SELECT 'review_threads', 'pr_id', thread_id, pr_id, 'pull_request', strftime(min(first_comment_at) AT TIME ZONE 'UTC', '%Y-%m'), min(computed_at) FROM review_threads WHERE pr_id IS NOT NULL GROUP BY 3, 4
  UNION ALL SELECT 'review_threads', 'resolved_by_actor_id', thread_id, resolved_by_actor_id, 'actor', strftime(min(first_comment_at) AT TIME ZONE 'UTC', '%Y-%m'), min(computed_at) FROM review_threads WHERE resolved_by_actor_id IS NOT NULL GROUP BY 3, 4
  UNION ALL SELECT 'comments', 'parent_id', comment_id, parent_id, coalesce(parent_kind, 'either'), strftime(min(created_at) AT TIME ZONE 'UTC', '%Y-%m'), min(computed_at) FROM comments WHERE parent_id IS NOT NULL GROUP BY 3, 4, 5),
loose AS (SELECT r.*, CASE WHEN t.id IS NOT NULL THEN 'late' WHEN r.target IN (SELECT record_id FROM deleted_records WHERE record_id IS NOT NULL) THEN 'deleted' ELSE 'missing' END AS status
  FROM refs r LEFT JOIN targets t ON t.kind = r.kind AND t.id = r.target WHERE t.id IS NULL OR t.arrived > r.arrived)
"""

QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_report": p3_report}
ORACLE = {
    "p2_found": P2_FOUND_SQL,
    "p3_found": _P3 + "SELECT DISTINCT table_name, field, record_key, status FROM loose",
    "p3_report": _P3 + "SELECT table_name, field, period, status, count(*) AS n_records FROM loose GROUP BY ALL",
}
