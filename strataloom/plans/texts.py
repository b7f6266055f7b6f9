"""Queries of text functions over the project's titles, bodies and comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.sources.tables import read_table


def latest_pulls(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row a pull request, the last delivered."""
    rows = read_table(spark, sf_dir, "pull_requests", "pr_number", "computed_at", *columns)
    picked = rows.groupBy("pr_number").agg(F.max_by(F.struct(*columns), F.col("computed_at")).alias("r"))
    return picked.select("pr_number", *[F.col(f"r.{c}").alias(c) for c in columns])


_PULLS = "(SELECT * FROM pull_requests QUALIFY row_number() OVER (PARTITION BY pr_number ORDER BY computed_at DESC) = 1)"


def distinct_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "comments", "comment_id", "body_text").distinct()


def review_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "review_comments", "comment_id", "body_text", "author_typename", "author_login", "computed_at")
    r = rows.groupBy("comment_id").agg(F.max_by(F.struct("body_text", "author_typename", "author_login"), F.col("computed_at")).alias("r"))
    return r.select("comment_id", "r.*")


_REVIEWS = "(SELECT * FROM review_comments QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY computed_at DESC) = 1)"


def title_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each pull request's title."""
    return latest_pulls(spark, sf_dir, "title_raw", "body_text").select("pr_number", X.parse_title(F.col("title_raw"), F.col("body_text")).alias("t")).select("pr_number", "t.*").drop("tag")


_T = r"^([A-Za-z][A-Za-z0-9_-]{1,20})(\([^()]{0,80}\))?(!)?:\s*(.*)$"
TITLE_PARSE = f"""
WITH b AS (SELECT pr_number, coalesce(title_raw, '') AS raw, body_text, trim(regexp_replace(trim(coalesce(title_raw, '')), '\\s*\\(#([0-9]{{1,7}})\\)\\s*$', '')) AS bare FROM {_PULLS}),
w AS (SELECT *, CASE WHEN regexp_matches(bare, '^\\s*\\[([^\\]]{{1,30}})\\]\\s*.*$') THEN trim(regexp_extract(bare, '^\\s*\\[[^\\]]{{1,30}}\\]\\s*(.*)$', 1)) ELSE bare END AS t FROM b),
p AS (SELECT *, regexp_matches(t, '{_T}') AS m, nullif(regexp_extract(t, '{_T}', 1), '') AS prefix, nullif(trim(translate(regexp_extract(t, '{_T}', 2), '()', '')), '') AS s,
  CASE WHEN regexp_matches(raw, '^trunk-merge/pr-[0-9]+/') THEN 'merge_queue_artifact' WHEN regexp_matches(raw, '^(Bump|bump) .+ from .+ to .+$') OR regexp_matches(raw, '(?i)^chore\\(deps(-dev)?\\):') THEN 'dependency_bump'
    WHEN regexp_matches(raw, '(?i)^Revert "') THEN 'revert' WHEN regexp_matches(raw, '(?i)^\\[?auto(mated)?\\]?[: ]') THEN 'automation' END AS title_class FROM w),
n AS (SELECT *, lower(prefix) AS lp, lower(prefix) IN ({', '.join(f"'{t}'" for t in X.TITLE_TYPES)}) AS known, CASE lower(prefix) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in X.TITLE_ALIASES.items())} END AS alias,
  nullif(trim(CASE WHEN m THEN regexp_extract(t, '{_T}', 4) ELSE t END), '') AS subject, coalesce(title_class = 'merge_queue_artifact', FALSE) AS q FROM p)
SELECT pr_number, title_class, CAST(nullif(regexp_extract(raw, '\\s*\\(#([0-9]{{1,7}})\\)\\s*$', 1), '') AS BIGINT) AS squash_number, prefix, CASE WHEN known THEN lp ELSE alias END AS prefix_normalized, CASE WHEN m THEN s END AS scope,
  coalesce(regexp_matches(body_text, '(?m)^BREAKING[ -]CHANGE\\s*:'), FALSE) OR (m AND regexp_extract(t, '{_T}', 3) = '!') AS breaking, subject,
  CASE WHEN q THEN 'not_a_human_title' WHEN NOT m THEN 'not_conventional' WHEN known AND prefix = lp THEN 'strict' WHEN known THEN 'loose' WHEN alias IS NOT NULL THEN 'alias' ELSE 'unknown_type' END AS parser_status,
  CASE WHEN q OR NOT m THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN known THEN 0.98 WHEN alias IS NOT NULL THEN 0.8 ELSE 0.35 END)::DOUBLE - (CASE WHEN prefix <> lp THEN 0.08 ELSE 0.0 END)::DOUBLE
    - (CASE WHEN s IS NOT NULL AND NOT regexp_matches(s, '^[A-Za-z0-9 _./,+-]{{1,80}}$') THEN 0.1 ELSE 0.0 END)::DOUBLE - (CASE WHEN subject IS NULL THEN 0.3 ELSE 0.0 END)::DOUBLE)), 3) END AS confidence
FROM n"""


def prefix_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles per type word."""
    return title_parse(spark, sf_dir).groupBy(F.coalesce("prefix_normalized", F.lit("(none)")).alias("prefix")).agg(F.count(F.lit(1)).alias("n_titles"))


def reference_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to issues and pull requests in titles and bodies; those to itself are left out."""
    pulls = latest_pulls(spark, sf_dir, "title_raw", "body_text").withColumn("t", F.concat_ws("\n", "title_raw", "body_text"))
    return pulls.select("pr_number", F.explode(X.references(F.col("t"))).alias("r")).filter(F.col("r.value") != F.col("pr_number")).select("pr_number", F.col("r.value").alias("ref_number"), "r.subtype", "r.strength")


_C = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\b[:\s]+(?:https?://[\w.-]+/[\w.-]+/[\w.-]+/issues/|#|GH-)([0-9]{1,7})"
REFERENCE_EXTRACTION = rf"""
WITH p AS (SELECT pr_number, concat_ws(chr(10), title_raw, body_text) AS t FROM {_PULLS}),
c AS (SELECT DISTINCT pr_number, CAST(unnest(regexp_extract_all(t, '{_C}', 1)) AS BIGINT) AS v FROM p),
m AS (SELECT DISTINCT pr_number, CAST(unnest(list_concat(regexp_extract_all(t, '(?:^|[^\w/#])#([0-9]{{2,7}})\b', 1), regexp_extract_all(t, '(?i)\bGH-([0-9]{{2,7}})\b', 1))) AS BIGINT) AS v FROM p)
SELECT pr_number, v AS ref_number, 'closing' AS subtype, 'strong' AS strength FROM c WHERE v <> pr_number
UNION ALL SELECT pr_number, v, 'mention', 'medium' FROM m WHERE v <> pr_number AND (pr_number, v) NOT IN (SELECT pr_number, v FROM c)"""


def url_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in the documents' texts with their kind."""
    rows = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return rows.select("doc_id", F.explode(X.urls(F.col("text"))).alias("u")).select("doc_id", "u.*")


_KINDS = "CASE " + " ".join(f"WHEN regexp_matches(u, '{p}') THEN '{k}'" for k, p in X.DOCUMENT_KINDS) + " ELSE 'external' END"
URL_EXTRACTION = rf"""
WITH f AS (SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_extract_all(text, 'https?://[^\s<>()\[\]"'']{{6,300}}', 0)), '[.,;:!?]+$', '') AS u FROM documents)
SELECT doc_id, u AS url, {_KINDS} AS kind, CASE WHEN {_KINDS} IN ('changelog', 'docs', 'handbook') THEN 'strong' ELSE 'weak' END AS strength FROM f"""


def edge_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments with words that tie one change to another."""
    return distinct_comments(spark, sf_dir).select("comment_id", F.explode(X.edge_phrases(F.col("body_text"))).alias("phrase"))


EDGE_PHRASES = " UNION ALL ".join(f"SELECT comment_id, '{k}' AS phrase FROM (SELECT DISTINCT comment_id, body_text FROM comments) WHERE regexp_matches(body_text, '{p}')" for k, p in X.EDGE_PHRASES.items())


def trailer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailers of comments that end like commit messages."""
    return distinct_comments(spark, sf_dir).select("comment_id", F.explode(X.trailers(F.col("body_text"))).alias("t")).select("comment_id", "t.key", "t.value")


TRAILER_LINES = r"""
WITH l AS (SELECT comment_id, unnest(list_slice(string_split(body_text, chr(10)), greatest(1, len(string_split(body_text, chr(10))) - 14), len(string_split(body_text, chr(10))))) AS x FROM (SELECT DISTINCT comment_id, body_text FROM comments) WHERE body_text IS NOT NULL)
SELECT comment_id, lower(regexp_extract(x, '^([A-Z][A-Za-z-]+-by|Reverts|Fixes|Change-Id): (.+)$', 1)) AS key, trim(regexp_extract(x, '^([A-Z][A-Za-z-]+-by|Reverts|Fixes|Change-Id): (.+)$', 2)) AS value
FROM l WHERE regexp_matches(x, '^([A-Z][A-Za-z-]+-by|Reverts|Fixes|Change-Id): (.+)$')"""


def review_substance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The substance of each review comment."""
    rows = review_bodies(spark, sf_dir)
    bot = (F.col("author_typename") == "Bot") | F.coalesce(F.col("author_login").endswith("[bot]"), F.lit(False))
    return rows.select("comment_id", X.comment_substance(F.col("body_text"), bot).alias("substance"))


_BARE = r"regexp_replace(regexp_replace(regexp_replace(coalesce(body_text, ''), '```.*?```', ' ', 'gs'), '<!--.*?-->', ' ', 'gs'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
REVIEW_SUBSTANCE = f"""
WITH b AS (SELECT comment_id, coalesce(author_typename = 'Bot' OR suffix(author_login, '[bot]'), FALSE) AS bot, {_BARE} AS t FROM {_REVIEWS})
SELECT comment_id, CASE WHEN bot THEN 'bot' WHEN t = '' THEN 'empty'
  WHEN ({' OR '.join(f"regexp_matches(t, '{p}')" for p in X.ACKNOWLEDGEMENTS)}) AND length(t) <= 40 THEN 'acknowledgement'
  WHEN {' OR '.join(f"regexp_matches(t, '{p}')" for p in X.NITS)} THEN 'nit' WHEN length(t) <= 40 THEN 'short' ELSE 'substantive' END AS substance FROM b"""


def safety_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review comments per category of risk whose words they use, with the number of different terms."""
    rows = review_bodies(spark, sf_dir).select("comment_id", F.explode(X.vocabulary_terms(F.col("body_text"), X.SAFETY_TERMS)).alias("category", "terms"))
    return rows.select("comment_id", "category", F.size("terms").alias("n_terms"))


_SAFE = " UNION ALL ".join(f"SELECT '{k}' AS category, '{t}' AS term" for k, ts in X.SAFETY_TERMS.items() for t in ts)
SAFETY_TERMS = f"WITH v AS ({_SAFE}) SELECT comment_id, category, CAST(count(*) AS INTEGER) AS n_terms FROM {_REVIEWS} r JOIN v ON contains(lower(r.body_text), v.term) GROUP BY ALL"


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of pull requests' titles and how many titles have them."""
    rows = latest_pulls(spark, sf_dir, "title_raw").select("pr_number", F.explode(F.array_distinct(X.tokenize(F.col("title_raw"), ["the"]))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n_titles"))


TOKEN_COUNTS = f"""
WITH t AS (SELECT pr_number, unnest(regexp_extract_all(lower(regexp_replace(regexp_replace(title_raw, 'https?://\\S+', ' ', 'g'), '`[^`]*`', ' ', 'g')), '[a-z][a-z0-9_]+', 0)) AS w FROM {_PULLS}),
p AS (SELECT DISTINCT pr_number, unnest(regexp_extract_all(w, '[a-z]+|[0-9]+', 0)) AS token FROM t)
SELECT token, count(*) AS n_titles FROM p WHERE length(token) >= 3 AND token <> 'the' GROUP BY token"""


def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of code in review comments that two to six pull requests mention."""
    rows = read_table(spark, sf_dir, "review_comments", "pr_number", "body_text").filter("pr_number IS NOT NULL")
    named = rows.select("pr_number", F.explode(X.named_entities(F.col("body_text"))).alias("entity")).distinct()
    return named.groupBy("entity").agg(F.count(F.lit(1)).alias("document_frequency")).filter(F.col("document_frequency").between(2, 6))


ENTITY_NAMES = r"""
WITH n AS (SELECT DISTINCT pr_number, lower(unnest(regexp_extract_all(body_text, '\b([A-Za-z][a-z0-9]+(?:[_-][A-Za-z0-9]+)+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b', 1))) AS entity FROM review_comments WHERE pr_number IS NOT NULL)
SELECT entity, count(*) AS document_frequency FROM n WHERE length(entity) >= 6 GROUP BY entity HAVING count(*) BETWEEN 2 AND 6"""


def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments with mail addresses and tokens replaced, where there are any."""
    rows = distinct_comments(spark, sf_dir).withColumn("redacted", X.redact(F.col("body_text")))
    return rows.filter("redacted <> body_text").select("comment_id", "redacted")


REDACTION = r"""
SELECT DISTINCT comment_id, regexp_replace(regexp_replace(body_text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[redacted-email]', 'g'), '\b(gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|AKIA[A-Z0-9]{16})\b', '[redacted-token]', 'g') AS redacted
FROM comments WHERE regexp_matches(body_text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') OR regexp_matches(body_text, '\b(gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|AKIA[A-Z0-9]{16})\b')"""


def problem_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of at least 40 characters of each issue's latest body that speaks of a problem."""
    rows = read_table(spark, sf_dir, "issues", "issue_number", "body_text", "computed_at")
    last = rows.groupBy("issue_number").agg(F.max_by("body_text", "computed_at").alias("body_text"))
    marked = F.filter(X.sentences(F.col("body_text")), lambda s: (F.length(s) >= 40) & s.rlike(r"(?i)\b(fails?|broke|error|crash|bug|wrong|stopped|slow)\b"))
    return last.select("issue_number", F.get(marked, 0).alias("problem")).filter("problem IS NOT NULL")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several documents share, by hash."""
    rows = read_table(spark, sf_dir, "documents", "doc_id", "text").filter("text IS NOT NULL")
    return rows.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n_documents"), F.min("doc_id").alias("first_doc_id")).filter("n_documents > 1")


QUERIES = {
    "title_parse": title_parse, "prefix_distribution": prefix_distribution, "reference_extraction": reference_extraction, "url_extraction": url_extraction, "edge_phrases": edge_phrases, "trailer_lines": trailer_lines,
    "review_substance": review_substance, "safety_terms": safety_terms, "token_counts": token_counts, "entity_names": entity_names, "redaction": redaction, "problem_sentences": problem_sentences, "exact_duplicates": exact_duplicates,
}
ORACLE = {
    "title_parse": TITLE_PARSE,
    "prefix_distribution": f"SELECT coalesce(prefix_normalized, '(none)') AS prefix, count(*) AS n_titles FROM ({TITLE_PARSE}) GROUP BY 1",
    "reference_extraction": REFERENCE_EXTRACTION, "url_extraction": URL_EXTRACTION, "edge_phrases": EDGE_PHRASES, "trailer_lines": TRAILER_LINES, "review_substance": REVIEW_SUBSTANCE, "safety_terms": SAFETY_TERMS,
    "token_counts": TOKEN_COUNTS, "entity_names": ENTITY_NAMES, "redaction": REDACTION,
    "exact_duplicates": "SELECT sha256(text) AS text_hash, count(*) AS n_documents, min(doc_id) AS first_doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
}
