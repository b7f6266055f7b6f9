"""Queries that join changes with each other and with their reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import numbers as N
from strataloom.functions import text as X
from strataloom.operators import pairs as P
from strataloom.plans.texts import _PULLS, _REVIEWS, REVIEW_SUBSTANCE, latest_pulls, review_substance
from strataloom.sources.tables import read_table

#: Branches that everything starts from.
TRUNKS = ["main", "master", "develop"]


def stacked_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests whose base is another one's branch."""
    pulls = latest_pulls(spark, sf_dir, "base_ref", "head_ref")
    lower = pulls.filter(~F.col("base_ref").isin(TRUNKS)).select(F.col("pr_number").alias("upper"), F.col("base_ref").alias("ref"))
    return lower.join(pulls.select(F.col("pr_number").alias("lower"), F.col("head_ref").alias("ref")), "ref").filter("upper <> lower").select("upper", "lower", "ref")


def same_subject_reverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverts after a pull request of the same subject."""
    pulls = latest_pulls(spark, sf_dir, "title_subject", "title_prefix", "created_at").withColumn("s", F.lower(F.trim("title_subject")))
    later = pulls.filter("title_prefix = 'revert'").select("s", F.col("pr_number").alias("revert"), F.col("created_at").alias("then"))
    return pulls.join(later, "s").filter((F.col("then") > F.col("created_at")) & (F.col("revert") != F.col("pr_number"))).select("pr_number", "revert")


REVERTS = f"WITH p AS (SELECT pr_number, title_prefix, created_at, lower(trim(title_subject)) AS s FROM {_PULLS}) SELECT a.pr_number, b.pr_number AS revert FROM p a JOIN p b ON a.s = b.s AND b.title_prefix = 'revert' AND b.created_at > a.created_at AND a.pr_number <> b.pr_number"


def answered_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review comments after which the same file was commented again by somebody else, or its pull request was updated within 14 days."""
    rows = read_table(spark, sf_dir, "review_comments", "comment_id", "pr_number", "path", "author_login", "created_at", "computed_at")
    last = rows.groupBy("comment_id").agg(F.max_by(F.struct("pr_number", "path", "author_login", "created_at"), "computed_at").alias("r")).select("comment_id", "r.*")
    # the latest answer of each author decides whether a later one by somebody else exists: no pair of comments is made
    per = last.groupBy("pr_number", "path", "author_login").agg(F.max("created_at").alias("m"))
    two = P.top_k(per, ["pr_number", "path"], [F.col("m").desc(), F.col("author_login").asc_nulls_last()], 2)
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    runner = two.groupBy("pr_number", "path").agg(at(1, "m").alias("m1"), at(1, "author_login").alias("a1"), at(2, "m").alias("m2"))
    updated = latest_pulls(spark, sf_dir, "updated_at")
    joined = last.join(runner, ["pr_number", "path"], "left").join(updated, "pr_number", "left")
    other = F.when(F.col("author_login").eqNullSafe(F.col("a1")), F.col("m2")).otherwise(F.col("m1"))
    again = F.coalesce(other > F.col("created_at"), F.lit(False))
    soon = N.within(F.col("updated_at"), F.col("created_at"), F.expr("created_at + INTERVAL 14 DAYS"))
    return joined.select("comment_id", again.alias("answered"), soon.alias("updated_soon"))


ANSWERED = f"""
WITH c AS (SELECT comment_id, pr_number, path, author_login, created_at FROM {_REVIEWS} r)
SELECT comment_id, EXISTS (SELECT 1 FROM c d WHERE d.pr_number = c.pr_number AND d.path = c.path AND d.created_at > c.created_at AND d.author_login IS DISTINCT FROM c.author_login) AS answered,
  coalesce((SELECT u.updated_at >= c.created_at AND u.updated_at < c.created_at + INTERVAL 14 DAY FROM {_PULLS} u WHERE u.pr_number = c.pr_number), FALSE) AS updated_soon FROM c"""


def reviewer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each reviewer over their comments: counts, substance, pull requests, terms of risk."""
    rows = read_table(spark, sf_dir, "review_comments", "comment_id", "pr_number", "author_login", "body_text", "computed_at")
    last = rows.groupBy("comment_id").agg(F.max_by(F.struct("pr_number", "author_login", "body_text"), "computed_at").alias("r")).select("comment_id", "r.*")
    judged = last.join(review_substance(spark, sf_dir), "comment_id").withColumn("login", F.lower("author_login")).filter("login IS NOT NULL")
    risky = F.size(X.vocabulary_terms(F.col("body_text"), X.SAFETY_TERMS)) > 0
    return judged.groupBy("login").agg(F.count(F.lit(1)).alias("n_comments"), F.count_if(F.col("substance") == "substantive").alias("n_substantive"), F.countDistinct("pr_number").alias("n_pull_requests"), F.count_if(risky).alias("n_risky"))


_TERMS = " OR ".join("contains(lower(body_text), '{}')".format(t) for ts in X.SAFETY_TERMS.values() for t in ts)


def repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that tables hold more than once."""
    out = None
    for table, key in {"issues": "issue_id", "comments": "comment_id", "review_threads": "thread_id", "actors": "actor_id", "web_artifacts": "url"}.items():
        counted = read_table(spark, sf_dir, table, F.col(key).alias("record_key")).groupBy("record_key").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1").select(F.lit(table).alias("table_name"), "record_key", "n_rows")
        out = counted if out is None else out.unionByName(counted)
    return out


_REPEATED = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {k} AS record_key, count(*) AS n_rows FROM {t} GROUP BY {k} HAVING count(*) > 1" for t, k in {"issues": "issue_id", "comments": "comment_id", "review_threads": "thread_id", "actors": "actor_id", "web_artifacts": "url"}.items())


def path_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of threads and comments: in both, in one only."""
    a, b = read_table(spark, sf_dir, "review_threads", "path").dropna(), read_table(spark, sf_dir, "review_comments", "path").dropna()
    tag = lambda df, name: df.withColumn("side", F.lit(name))
    return tag(a.intersect(b), "both").unionByName(tag(a.distinct().exceptAll(b.distinct()), "threads")).unionByName(tag(b.distinct().exceptAll(a.distinct()), "comments"))


def directory_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests that touch one file which two to twelve touch, created within 45 days of each other."""
    touched = read_table(spark, sf_dir, "review_threads", "path", "pr_number").dropna()
    pairs = P.shared_pairs(touched, "path", "pr_number", 2, 12).select("a", "b").distinct()
    at = latest_pulls(spark, sf_dir, "created_at")
    dated = pairs.join(at.select(F.col("pr_number").alias("a"), F.col("created_at").alias("ta")), "a").join(at.select(F.col("pr_number").alias("b"), F.col("created_at").alias("tb")), "b")
    days = F.abs(N.days_between(F.col("ta"), F.col("tb")))
    return dated.filter(days <= 45).select("a", "b", F.round(days, 4).alias("days"))


NEIGHBOURS = f"""
WITH t AS (SELECT DISTINCT path, pr_number FROM review_threads WHERE path IS NOT NULL AND pr_number IS NOT NULL), g AS (SELECT path FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND 12), p AS (SELECT DISTINCT a.pr_number AS a, b.pr_number AS b FROM t a JOIN t b USING (path) JOIN g USING (path) WHERE a.pr_number < b.pr_number)
SELECT a, b, round(abs(epoch_us(x.created_at) - epoch_us(y.created_at)) / 86400000000.0::DOUBLE, 4) AS days FROM p JOIN {_PULLS} x ON x.pr_number = a JOIN {_PULLS} y ON y.pr_number = b WHERE abs(epoch_us(x.created_at) - epoch_us(y.created_at)) / 86400000000.0::DOUBLE <= 45"""


def capped_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties of a pull request's anomaly flags, 0.25 each and at most 1, with the flags in order."""
    rows = read_table(spark, sf_dir, "pr_anomalies", "pr_number", "anomaly_flags").distinct()
    return rows.select("pr_number", F.least(F.lit(1.0), 0.25 * F.coalesce(F.size(N.sorted_distinct(F.col("anomaly_flags"))), F.lit(0))).alias("penalty"), F.array_join(N.sorted_distinct(F.col("anomaly_flags")), ",").alias("flags"))


def monthly_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests per month and state, with the running number of the months before."""
    from pyspark.sql import Window

    monthly = latest_pulls(spark, sf_dir, "created_at", "state").groupBy(N.month(F.col("created_at")).alias("month"), "state").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("state").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    return monthly.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0)))


QUERIES = {
    "stacked_branches": stacked_branches, "same_subject_reverts": same_subject_reverts, "answered_comments": answered_comments, "reviewer_rollup": reviewer_rollup, "repeated_rows": repeated_rows, "path_sets": path_sets, "directory_neighbours": directory_neighbours,
    "capped_penalties": capped_penalties, "monthly_flow": monthly_flow,
}
ORACLE = {
    "stacked_branches": f"SELECT a.pr_number AS upper, b.pr_number AS lower, a.base_ref AS ref FROM {_PULLS} a JOIN {_PULLS} b ON a.base_ref = b.head_ref AND a.pr_number <> b.pr_number AND a.base_ref NOT IN ('main', 'master', 'develop')",
    "same_subject_reverts": REVERTS, "answered_comments": ANSWERED,
    "reviewer_rollup": f"SELECT lower(author_login) AS login, count(*) AS n_comments, count(*) FILTER (substance = 'substantive') AS n_substantive, count(DISTINCT pr_number) AS n_pull_requests, count(*) FILTER ({_TERMS}) AS n_risky FROM {_REVIEWS} r JOIN ({REVIEW_SUBSTANCE}) USING (comment_id) WHERE author_login IS NOT NULL GROUP BY 1",
    "repeated_rows": _REPEATED,
    "path_sets": "WITH a AS (SELECT DISTINCT path FROM review_threads WHERE path IS NOT NULL), b AS (SELECT DISTINCT path FROM review_comments WHERE path IS NOT NULL) SELECT path, 'both' AS side FROM (FROM a INTERSECT FROM b) UNION ALL SELECT path, 'threads' FROM (FROM a EXCEPT FROM b) UNION ALL SELECT path, 'comments' FROM (FROM b EXCEPT FROM a)",
    "directory_neighbours": NEIGHBOURS,
    "capped_penalties": "SELECT DISTINCT pr_number, least(1.0::DOUBLE, 0.25::DOUBLE * coalesce(len(list_distinct(anomaly_flags)), 0)) AS penalty, array_to_string(list_sort(list_distinct(anomaly_flags)), ',') AS flags FROM pr_anomalies",
    "monthly_flow": f"WITH m AS (SELECT strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, state, count(*) AS n FROM {_PULLS} GROUP BY ALL) SELECT month, state, n, coalesce(sum(n) OVER (PARTITION BY state ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_before FROM m",
}
