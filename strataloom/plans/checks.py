"""Queries on the quality of tables, on claims, windows of events and scenarios of a ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions import numbers as N
from strataloom.operators import claims as L
from strataloom.operators import pairs as P
from strataloom.operators import quality as Q
from strataloom.operators import ranking as K
from strataloom.plans.rankings import SCORES, WEIGHTS, scores
from strataloom.sources.tables import read_table
from strataloom.streaming import windows as S

CONTRACTS = {
    "pull_requests": Q.Contract(required=["pr_number", "pr_id", "state", "body_text"], unique=[["pr_number"]], not_negative=["git_additions", "comment_count"], values={"state": ["OPEN", "CLOSED", "MERGED"]}, ranges={"title_parser_confidence": (0.0, 1.0)}),
    "review_threads": Q.Contract(required=["thread_id"], unique=[["thread_id"]], references={"pr_id": ("pull_requests", "pr_id")}, not_negative=["comment_count"]),
    "review_comments": Q.Contract(required=["comment_id", "author_login"], references={"thread_id": ("review_threads", "thread_id"), "reply_to_id": ("review_comments", "comment_id")}, not_negative=["position_in_thread"]),
    "actors": Q.Contract(required=["actor_id"], unique=[["actor_id"]], ranges={"bot_probability": (0.0, 1.0)}),
    "lineitem": Q.Contract(unique=[["l_orderkey", "l_linenumber"]], references={"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey")}, ranges={"l_discount": (0.0, 0.05)}, values={"l_returnflag": ["A", "N"]}),
}


def invariants_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the project's tables that break their contracts."""
    names = {*CONTRACTS, *(t for c in CONTRACTS.values() for t, _ in c.references.values())}
    return Q.check({n: read_table(spark, sf_dir, n) for n in names}, CONTRACTS)


def _contract_sql() -> str:
    out = []
    for name, c in CONTRACTS.items():
        row = lambda rule, subject, count, name=name: out.append(f"SELECT '{name}' AS table_name, '{rule}' AS rule, '{subject}' AS subject, {count} AS n_failed")
        for x in c.required:
            row("required", x, f"(SELECT count(*) FROM {name} WHERE {x} IS NULL)")
        for x in c.not_negative:
            row("not_negative", x, f"(SELECT count(*) FROM {name} WHERE {x} < 0)")
        for x, (low, high) in c.ranges.items():
            row("range", x, f"(SELECT count(*) FROM {name} WHERE {x} < {low}::DOUBLE OR {x} > {high}::DOUBLE)")
        for x, allowed in c.values.items():
            row("values", x, f"(SELECT count(*) FROM {name} WHERE {x} NOT IN ({', '.join(map(repr, allowed))}))")
        for key in c.unique:
            k = ", ".join(key)
            row("unique", ",".join(key), f"(SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM {name} GROUP BY {k}))")
        for x, (other, key) in c.references.items():
            row("references", x, f"(SELECT count(*) FROM {name} WHERE {x} IS NOT NULL AND {x} NOT IN (SELECT {key} FROM {other} WHERE {key} IS NOT NULL))")
    return " UNION ALL ".join(out)


def version_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamps = {"pull_requests": "schema_version", "actors": "actor_identity_version", "pr_anomalies": "anomaly_version", "web_artifacts": "extractor_version"}
    return Q.uniform({n: read_table(spark, sf_dir, n, c) for n, c in stamps.items()}, stamps)


VERSIONS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS stamp, count(DISTINCT {c}) AS n_versions, count(DISTINCT {c}) = 1 AND count({c}) = count(*) AS is_uniform FROM {t}"
    for t, c in {"pull_requests": "schema_version", "actors": "actor_identity_version", "pr_anomalies": "anomaly_version", "web_artifacts": "extractor_version"}.items()
)


def table_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes of tables, whatever the order of their rows."""
    columns = {"nation": ["n_name", "n_nationkey", "n_regionkey"], "subject_areas": ["description", "subject"], "deleted_records": ["record_id", "record_kind"], "comments": ["author_login", "comment_id", "parent_id"]}
    out = None
    for name, cols in columns.items():
        one = Q.content_hash(read_table(spark, sf_dir, name, *cols)).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _hash_sql(name: str, columns: list[str]) -> str:
    text = "concat_ws('|', " + ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '~')" for c in columns) + ")"
    return f"SELECT count(*) AS n_rows, bit_xor(h) AS xor_hash, sum(h % 1000000007)::BIGINT AS sum_hash, '{name}' AS table_name FROM (SELECT CAST('0x' || substr(sha256({text}), 1, 15) AS BIGINT) AS h FROM {name})"


TABLE_HASH = " UNION ALL ".join([_hash_sql("nation", ["n_name", "n_nationkey", "n_regionkey"]), _hash_sql("subject_areas", ["description", "subject"]), _hash_sql("deleted_records", ["record_id", "record_kind"]), _hash_sql("comments", ["author_login", "comment_id", "parent_id"])])


def completeness_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "pull_requests", "created_at", "body_text", "merged_at", "git_additions", "milestone_title", "github_additions")
    return Q.completeness(rows, "created_at", ["body_text", "merged_at", "git_additions", "github_additions", "milestone_title"])


def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["body_text", "author_login", "milestone_title", "git_additions", "github_additions", "merged_at"]
    return Q.missingness(read_table(spark, sf_dir, "pull_requests", *columns), columns)


_MISSING = " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n_rows, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*), 6) AS share FROM pull_requests" for c in ["body_text", "author_login", "milestone_title", "git_additions", "github_additions", "merged_at"])


def count_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes per month in pull requests and in their anomalies, within two per cent or not."""
    pulls = read_table(spark, sf_dir, "pull_requests", "pr_number", "created_at").groupBy("pr_number").agg(F.min("created_at").alias("created_at"))
    held = read_table(spark, sf_dir, "pr_anomalies", "pr_number").distinct().withColumn("held", F.lit(1))
    counts = pulls.join(held, "pr_number", "left").groupBy(N.month(F.col("created_at")).alias("name")).agg(F.count(F.lit(1)).alias("own"), F.count("held").alias("independent"))
    return Q.reconcile_counts(counts, 0.02)


RECONCILE = """
WITH p AS (SELECT pr_number, min(created_at) AS c FROM pull_requests GROUP BY 1), k AS (SELECT strftime(c AT TIME ZONE 'UTC', '%Y-%m') AS name, count(*) AS own, count(h.pr_number) AS independent FROM p LEFT JOIN (SELECT DISTINCT pr_number FROM pr_anomalies) h USING (pr_number) GROUP BY 1)
SELECT name, own, independent, abs(own - independent) AS difference, round(abs(own - independent) / greatest(own, independent), 6) AS share, abs(own - independent) / greatest(own, independent) <= 0.02::DOUBLE AS agrees FROM k"""


def size_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies whose counts of changed files differ by more than one and ten per cent."""
    rows = read_table(spark, sf_dir, "pr_anomalies", "pr_number", "git_changed_files", "github_changed_files").distinct()
    return rows.select("pr_number", N.differs(F.col("git_changed_files"), F.col("github_changed_files"), 1, 0.1).alias("mismatch"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five orders a status by salted hash."""
    return P.stratified_sample(read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", "audit", 5)


def independent_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest order a customer and priority, with the number of those that depend on it."""
    rows = read_table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey")
    return P.independent_entries(rows, "o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey", F.size("excluded").alias("n_excluded"))


def both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests without anomalies, and the other way round."""
    return P.both_missing(read_table(spark, sf_dir, "pull_requests", "pr_number"), read_table(spark, sf_dir, "pr_anomalies", "pr_number"), "pr_number")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "pr_anomalies", "pr_number", "pr_id", "anomaly_count", "anomaly_flags").distinct()
    return L.register(rows.filter("anomaly_count > 0").select(F.lit("anomaly").alias("claim_type"), F.col("pr_number").alias("subject"), F.format_string("Change %d  has %d flags.", "pr_number", "anomaly_count").alias("sentence"), F.concat(F.array("pr_id"), F.coalesce("anomaly_flags", F.array())).alias("evidence")))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of anomalies with their evidence."""
    return _claims(spark, sf_dir).withColumn("evidence", F.array_join("evidence", ","))


CLAIMS = """
WITH c AS (SELECT DISTINCT pr_number, 'Change ' || pr_number || ' has ' || anomaly_count || ' flags.' AS sentence, list_sort(list_distinct(list_filter(list_concat([pr_id], coalesce(anomaly_flags, [])), lambda x: x IS NOT NULL))) AS e FROM pr_anomalies WHERE anomaly_count > 0)
SELECT DISTINCT 'claim/' || substr(sha256(concat_ws('|', 'anomaly', CAST(pr_number AS VARCHAR), sentence, array_to_string(e, ','))), 1, 20) AS claim_id, 'anomaly' AS claim_type, CAST(pr_number AS VARCHAR) AS subject, sentence, array_to_string(e, ',') AS evidence FROM c WHERE len(e) > 0"""


def claims_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of these claims: flags are no artifacts, and only claims of even changes are referred to."""
    made = _claims(spark, sf_dir)
    used = made.filter(F.col("subject").cast("bigint") % 2 == 0).select("claim_id").unionByName(spark.createDataFrame([("claim/none",)], "claim_id string"))
    artifacts = read_table(spark, sf_dir, "pull_requests", F.col("pr_id").alias("artifact_id"))
    return L.audit(made, used, artifacts).groupBy("problem").agg(F.count(F.lit(1)).alias("n_ids"))


AUDIT = f"""
WITH c AS ({CLAIMS}), e AS (SELECT DISTINCT unnest(string_split(evidence, ',')) AS id FROM c)
SELECT * FROM (SELECT 'dangling' AS problem, 1 AS n_ids UNION ALL SELECT 'unreferenced', count(*) FROM c WHERE CAST(subject AS BIGINT) % 2 <> 0 UNION ALL SELECT 'orphan_evidence', count(*) FROM e WHERE id NOT IN (SELECT pr_id FROM pull_requests WHERE pr_id IS NOT NULL)) WHERE n_ids > 0"""

SCENARIOS = {"balanced": None, "spending_first": "spending", "supply_first": "supply"}


def _scenarios(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = [(s, c, w + (0.2 if c == first else 0.0)) for s, first in SCENARIOS.items() for c, w in WEIGHTS.items()]
    weights = spark.createDataFrame(rows, "scenario string, criterion string, weight double")
    names = spark.createDataFrame([(s,) for s in SCENARIOS], "scenario string").withColumn("_one", F.lit(1))
    return scores(spark, sf_dir).withColumn("_one", F.lit(1)).join(names, "_one").drop("_one"), weights


def scenario_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' positions in each scenario, a column a scenario, with the greatest change."""
    values, weights = _scenarios(spark, sf_dir)
    ranked = K.promethee(values, weights, by=["scenario"])
    wide = ranked.groupBy("alternative").pivot("scenario", list(SCENARIOS)).agg(F.first("position"))
    return wide.withColumn("movement", F.greatest(*SCENARIOS) - F.least(*SCENARIOS))


_SCENARIO_W = "(VALUES " + ", ".join(f"('{s}', '{c}', {round(w + (0.2 if c == f else 0.0), 10)}::DOUBLE)" for s, f in SCENARIOS.items() for c, w in WEIGHTS.items()) + ") w(scenario, criterion, weight)"
SCENARIO_SQL = f"""
WITH s AS {SCORES}, n AS (SELECT DISTINCT alternative FROM s), k AS (SELECT DISTINCT scenario FROM {_SCENARIO_W}),
x AS (SELECT scenario, a.alternative AS a, b.alternative AS b, sum(weight * greatest(0.0, least(1.0, a.value - b.value))) / sum(weight) AS ab FROM s a JOIN s b USING (criterion) JOIN {_SCENARIO_W} USING (criterion) WHERE a.alternative <> b.alternative AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2, 3),
e AS (SELECT k.scenario, p.alternative AS a, coalesce(x.ab, 0) - coalesce(y.ab, 0) AS net FROM k, n p JOIN n r ON p.alternative <> r.alternative LEFT JOIN x ON x.a = p.alternative AND x.b = r.alternative AND x.scenario = k.scenario LEFT JOIN x y ON y.b = p.alternative AND y.a = r.alternative AND y.scenario = k.scenario),
f AS (SELECT scenario, a AS alternative, row_number() OVER (PARTITION BY scenario ORDER BY round(avg(net), 6) DESC, a) AS position FROM e GROUP BY 1, 2),
v AS (SELECT alternative, max(position) FILTER (scenario = 'balanced') AS balanced, max(position) FILTER (scenario = 'spending_first') AS spending_first, max(position) FILTER (scenario = 'supply_first') AS supply_first FROM f GROUP BY 1)
SELECT *, greatest(balanced, spending_first, supply_first) - least(balanced, spending_first, supply_first) AS movement FROM v"""


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per six hours and type."""
    return S.window_counts(read_table(spark, sf_dir, "events"), "ts", ["event_type"], "value", "6 hours").withColumn("total", F.round("total", 2))


def event_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day, each half a day."""
    return S.window_counts(read_table(spark, sf_dir, "events"), "ts", [], "value", "1 day", "12 hours").withColumn("total", F.round("total", 2))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each user's events without a pause of an hour."""
    return S.sessions(read_table(spark, sf_dir, "events", "user_id", "ts"), "ts", "user_id", "1 hour")


SESSIONS = """
WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, (max(ts) + INTERVAL 1 HOUR) AS session_end, count(*) AS n_events FROM s GROUP BY user_id, k"""


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in each event's properties, summed by type."""
    rows = read_table(spark, sf_dir, "events", "event_type", "props").withColumn("k", F.from_json("props", "k long")["k"])
    return rows.groupBy("event_type").agg(F.count("k").alias("n_known"), F.sum("k").alias("total"), F.max("k").alias("most"))


def host_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corroborating addresses: distinct urls and references a host, the first ten."""
    rows = read_table(spark, sf_dir, "web_artifacts", "url", "host", "reference_count").groupBy("url", "host").agg(F.max("reference_count").alias("n"))
    sums = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_urls"), F.sum("n").alias("n_references"))
    order = [F.col("n_urls").desc(), F.col("host").asc()]
    return sums.orderBy(*order).limit(10).withColumn("place", F.row_number().over(Window.orderBy(*order)))


QUERIES = {
    "invariants_report": invariants_report, "version_stamps": version_stamps, "table_hash": table_hash, "completeness_by_month": completeness_by_month, "missingness": missingness, "count_reconciliation": count_reconciliation, "size_mismatch": size_mismatch,
    "stratified_sample": stratified_sample, "independent_entries": independent_entries, "both_sides": both_sides, "claims": claims, "claims_audit": claims_audit, "scenario_positions": scenario_positions, "event_windows": event_windows, "event_slides": event_slides,
    "event_sessions": event_sessions, "event_properties": event_properties, "host_share": host_share,
}
ORACLE = {
    "invariants_report": _contract_sql(), "version_stamps": VERSIONS, "table_hash": TABLE_HASH,
    "completeness_by_month": "SELECT strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_rows, count(body_text) AS has_body_text, count(merged_at) AS has_merged_at, count(git_additions) AS has_git_additions, count(github_additions) AS has_github_additions, count(milestone_title) AS has_milestone_title FROM pull_requests GROUP BY 1",
    "missingness": _MISSING, "count_reconciliation": RECONCILE,
    "size_mismatch": "SELECT DISTINCT pr_number, abs(git_changed_files - github_changed_files) > 1 AND abs(git_changed_files - github_changed_files) > 0.1::DOUBLE * greatest(git_changed_files, github_changed_files) AS mismatch FROM (SELECT DISTINCT pr_number, git_changed_files, github_changed_files FROM pr_anomalies) WHERE git_changed_files IS NOT NULL AND github_changed_files IS NOT NULL UNION ALL SELECT DISTINCT pr_number, FALSE FROM pr_anomalies WHERE git_changed_files IS NULL OR github_changed_files IS NULL",
    "stratified_sample": "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('audit|' || o_orderkey), o_orderkey) AS rank FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('audit|' || o_orderkey), o_orderkey) <= 5",
    "independent_entries": "SELECT o_custkey, o_orderpriority, o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1 AS n_excluded FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "both_sides": "SELECT DISTINCT pr_number, 'left_only' AS side FROM pull_requests WHERE pr_number NOT IN (SELECT pr_number FROM pr_anomalies WHERE pr_number IS NOT NULL) UNION ALL SELECT DISTINCT pr_number, 'right_only' FROM pr_anomalies WHERE pr_number NOT IN (SELECT pr_number FROM pull_requests WHERE pr_number IS NOT NULL)",
    "claims": CLAIMS, "claims_audit": AUDIT, "scenario_positions": SCENARIO_SQL,
    "event_windows": "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "event_slides": "SELECT w AS window_start, count(*) AS n_events, round(sum(value), 2) AS total FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w, value FROM events) GROUP BY 1",
    "event_sessions": SESSIONS,
    "event_properties": "SELECT event_type, count(CAST(props->>'k' AS BIGINT)) AS n_known, sum(CAST(props->>'k' AS BIGINT))::BIGINT AS total, max(CAST(props->>'k' AS BIGINT)) AS most FROM events GROUP BY 1",
    "host_share": "WITH u AS (SELECT url, host, max(reference_count) AS n FROM web_artifacts GROUP BY ALL) SELECT host, count(*) AS n_urls, sum(n)::BIGINT AS n_references, row_number() OVER (ORDER BY count(*) DESC, host) AS place FROM u GROUP BY host QUALIFY row_number() OVER (ORDER BY count(*) DESC, host) <= 10",
}
