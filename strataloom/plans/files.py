"""Queries over changed files: rules, histograms, pairs. Lines of an order stand for the files of a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import numbers as N
from strataloom.functions import text as X
from strataloom.operators import aggregates as A
from strataloom.operators import pairs as P
from strataloom.operators import rules as R
from strataloom.sources.tables import read_table

#: Labels of paths, first match first.
CATEGORIES = {"tests": ["**/test_*", "**/*_test.*"], "docs": ["**/*.md", "docs/**"], "config": ["**/*.yml", "**/*.toml"], "data": ["**/*.sql"], "styling": ["**/*.css"], "scripts": ["**/*.sh"], "backend": ["**/*.py", "**/*.rs"], "frontend": ["**/*.ts", "**/*.tsx"]}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pr_number, path, component, platform, status, additions, owner): a row a change and path."""
    lines = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    parts = read_table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    one = lines.groupBy("l_orderkey", "l_partkey").agg(F.min("l_returnflag").alias("status"), F.sum("l_quantity").cast("bigint").alias("additions"), F.max("l_suppkey").alias("owner"))
    joined = one.join(parts, one["l_partkey"] == parts["p_partkey"])
    return joined.select(F.col("l_orderkey").alias("pr_number"), F.concat_ws("/", "p_type", "p_brand", F.col("p_partkey").cast("string")).alias("path"), F.col("p_brand").alias("component"), F.col("p_type").alias("platform"), "status", "additions", "owner")


FILES = """(SELECT l_orderkey AS pr_number, concat_ws('/', p_type, p_brand, CAST(p_partkey AS VARCHAR)) AS path, p_brand AS component, p_type AS platform, min(l_returnflag) AS status, CAST(sum(l_quantity) AS BIGINT) AS additions, max(l_suppkey) AS owner
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_type, p_brand, p_partkey)"""


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pr_number, part, status): a row a change and part, as :func:`files` has them but also of parts that no longer exist; rows of a change stay together."""
    lines = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_returnflag").repartition("l_orderkey")
    one = lines.groupBy("l_orderkey", "l_partkey").agg(F.min("l_returnflag").alias("status"))
    return one.select(F.col("l_orderkey").alias("pr_number"), F.col("l_partkey").alias("part"), "status")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pr_number, author, merged_at, kind): orders as changes."""
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pr_number"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("merged_at"), F.when(F.col("o_orderpriority") == "1-URGENT", "fix").otherwise("feat").alias("kind"))


CHANGES = "(SELECT o_orderkey AS pr_number, o_custkey AS author, o_orderdate AS merged_at, CASE WHEN o_orderpriority = '1-URGENT' THEN 'fix' ELSE 'feat' END AS kind FROM orders)"


def change_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each change: files, additions, components, statuses, entropy, dominant component."""
    rows = files(spark, sf_dir)
    sums = rows.groupBy("pr_number").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("additions").alias("additions"), F.countDistinct("component").alias("distinct_components"), F.countDistinct("platform").alias("distinct_platforms"), F.countDistinct("owner").alias("distinct_owners"),
        F.count_if(F.col("status") == "A").alias("files_added"), F.count_if(F.col("status") == "N").alias("files_modified"), F.count_if(F.col("status") == "R").alias("files_removed"), F.max("additions").alias("largest_file"), F.every(F.col("status") == "A").alias("all_added"), F.some(F.col("status") == "R").alias("any_removed"),
    )
    spread = A.entropy(rows, ["pr_number"], "component").select("pr_number", F.round("entropy", 6).alias("component_entropy"))
    top = A.dominant(rows, ["pr_number"], "component").select("pr_number", F.col("component").alias("dominant_component"), F.round("share", 6).alias("dominant_share"))
    return sums.join(spread, "pr_number").join(top, "pr_number")


CHANGE_SHAPE = f"""
WITH f AS {FILES}, c AS (SELECT pr_number, component, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT pr_number, sum(n) AS total, -sum(n) AS x FROM c GROUP BY 1),
e AS (SELECT pr_number, round(-sum((n / total) * log2(n / total)), 6) AS component_entropy FROM c JOIN t USING (pr_number) GROUP BY 1),
d AS (SELECT pr_number, component AS dominant_component, round(n / total, 6) AS dominant_share FROM c JOIN t USING (pr_number) QUALIFY row_number() OVER (PARTITION BY pr_number ORDER BY n DESC, component) = 1)
SELECT pr_number, count(*) AS file_count, sum(additions)::BIGINT AS additions, count(DISTINCT component) AS distinct_components, count(DISTINCT platform) AS distinct_platforms, count(DISTINCT owner) AS distinct_owners, count(*) FILTER (status = 'A') AS files_added,
  count(*) FILTER (status = 'N') AS files_modified, count(*) FILTER (status = 'R') AS files_removed, max(additions) AS largest_file, bool_and(status = 'A') AS all_added, bool_or(status = 'R') AS any_removed,
  any_value(component_entropy) + 0.0 AS component_entropy, any_value(dominant_component) AS dominant_component, any_value(dominant_share) AS dominant_share FROM f JOIN e USING (pr_number) JOIN d USING (pr_number) GROUP BY pr_number"""


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per component and status, a column a status."""
    return files(spark, sf_dir).groupBy("component").pivot("status", ["A", "N", "R"]).agg(F.count(F.lit(1))).fillna(0).withColumnsRenamed({"A": "files_a", "N": "files_n", "R": "files_r"})


def component_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of components of each platform, as text in order."""
    rows = A.histogram(files(spark, sf_dir), ["platform"], "component")
    return rows.select("platform", F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("histogram"))


def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label of the distinct paths that review threads are on."""
    paths = read_table(spark, sf_dir, "review_threads", "path").dropna().distinct()
    return paths.select("path", F.explode(R.labels(X.normalize_path(F.col("path")), CATEGORIES)).alias("label"))


_HITS = {"tests": "(^|/)test_[^/]*$|_test\\.[^/]*$", "docs": "\\.md$|^docs(/|$)", "config": "\\.(yml|toml)$", "data": "\\.sql$", "styling": "\\.css$", "scripts": "\\.sh$", "backend": "\\.(py|rs)$", "frontend": "\\.(ts|tsx)$"}
_PATHS = "(SELECT DISTINCT path, ltrim(regexp_replace(path, '^(\\./)+', ''), '/') AS p FROM review_threads WHERE path IS NOT NULL)"


def category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct paths per first label."""
    paths = read_table(spark, sf_dir, "review_threads", "path").dropna().distinct()
    return paths.groupBy(R.first_label(X.normalize_path(F.col("path")), CATEGORIES, "unclassified").alias("category")).agg(F.count(F.lit(1)).alias("n_paths"))


def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last rule that matches each distinct path of a change."""
    rules = spark.createDataFrame([(1, "^.*$", "everyone"), (2, "^(ECONOMY|SMALL)/.*$", "basics"), (3, "^[^/]*/Brand#1[0-9]?/.*$", "tens"), (4, "^[^/]*/[^/]*/[0-9]*7$", "sevens")], "rule_order int, pattern string, rule_name string")
    paths = files(spark, sf_dir).select("path").distinct()
    return R.match_rules(paths, "path", rules, last=True)


RULE_MATCH = f"""SELECT DISTINCT path, CASE WHEN regexp_matches(path, '^[^/]*/[^/]*/[0-9]*7$') THEN 4 WHEN regexp_matches(path, '^[^/]*/Brand#1[0-9]?/.*$') THEN 3 WHEN regexp_matches(path, '^(ECONOMY|SMALL)/.*$') THEN 2 ELSE 1 END AS rule_order,
  CASE WHEN regexp_matches(path, '^[^/]*/[^/]*/[0-9]*7$') THEN 'sevens' WHEN regexp_matches(path, '^[^/]*/Brand#1[0-9]?/.*$') THEN 'tens' WHEN regexp_matches(path, '^(ECONOMY|SMALL)/.*$') THEN 'basics' ELSE 'everyone' END AS rule_name FROM {FILES}"""


def longest_prefix_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of the deepest directory above each path: some brands have their own, each type has one."""
    rows = files(spark, sf_dir)
    paths = rows.select("path").distinct()
    types = rows.select(F.col("platform").alias("directory"), F.concat(F.lit("type:"), "platform").alias("team")).distinct()
    brands = rows.filter("component LIKE '%1'").select(F.concat_ws("/", "platform", "component").alias("directory"), F.concat(F.lit("brand:"), "component").alias("team")).distinct()
    return R.longest_prefix(paths, "path", types.unionByName(brands), "directory")


def cooccurrence_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that share a path of 2 to 40 changes, with the evidence of all shared paths combined."""
    pairs = P.shared_pairs(files(spark, sf_dir), "path", "pr_number", 2, 40)
    return P.combine_pairs(pairs, F.lit(1.0) / F.col("fan_out")).withColumn("strength", F.round("strength", 6))


COOCCURRENCE = f"""
WITH f AS (SELECT DISTINCT path, pr_number FROM {FILES}), g AS (SELECT path, count(*) AS k FROM f GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40)
SELECT a.pr_number AS a, b.pr_number AS b, round(1 - product(1 - 1.0 / k), 6) AS strength, count(*) AS n_edges FROM f a JOIN f b ON a.path = b.path AND a.pr_number < b.pr_number JOIN g ON g.path = a.path GROUP BY ALL"""


def later_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes within 14 days after a change that touch one of its paths."""
    rows = files(spark, sf_dir).select("path", "pr_number").join(changes(spark, sf_dir), "pr_number")
    return P.later_within(rows, rows.filter("kind = 'fix'"), "path", "pr_number", "merged_at", 14)


LATER_FIXES = f"""
WITH r AS (SELECT * FROM {FILES} f JOIN {CHANGES} c USING (pr_number))
SELECT a.pr_number AS first_key, b.pr_number AS then_key, count(DISTINCT a.path) AS n_shared FROM r a JOIN r b ON a.path = b.path AND b.kind = 'fix' AND b.merged_at > a.merged_at AND b.merged_at <= a.merged_at + INTERVAL 14 DAY AND a.pr_number <> b.pr_number GROUP BY ALL"""


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a change's added paths that are not removed 90 days later; NULL with nothing added."""
    rows = files(spark, sf_dir).join(changes(spark, sf_dir).select("pr_number", "merged_at"), "pr_number").withColumn("merged_at", F.col("merged_at").cast("timestamp"))
    added = rows.filter("status = 'A'").select("path", "pr_number", F.expr("merged_at + INTERVAL 90 DAYS").alias("checkpoint"))
    # several changes of one instant: the greatest number holds
    changed = rows.groupBy("path", "merged_at").agg(F.max_by("status", "pr_number").alias("status"))
    state = P.state_at(changed, "path", "merged_at", "status", added.select("path", "checkpoint").distinct(), "checkpoint")
    gone = added.join(state, ["path", "checkpoint"]).groupBy("pr_number").agg(F.count(F.lit(1)).alias("introduced"), F.count_if(F.col("status") == "R").alias("gone"))
    return gone.select("pr_number", "introduced", "gone", F.round(1 - F.col("gone") / F.col("introduced"), 6).alias("survival"))


SURVIVAL = f"""
WITH r AS (SELECT * FROM {FILES} f JOIN {CHANGES} c USING (pr_number)), s AS (SELECT path, merged_at, max_by(status, pr_number) AS status FROM r GROUP BY ALL),
a AS (SELECT path, pr_number, merged_at + INTERVAL 90 DAY AS checkpoint FROM r WHERE status = 'A'),
j AS (SELECT a.pr_number, s.status FROM a ASOF JOIN s ON a.path = s.path AND a.checkpoint >= s.merged_at)
SELECT pr_number, count(*) AS introduced, count(*) FILTER (status = 'R') AS gone, round(1 - count(*) FILTER (status = 'R') / count(*), 6) AS survival FROM j GROUP BY 1"""


def bulk_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of at least five files of which one platform has half or more."""
    rows = files(spark, sf_dir)
    top = A.dominant(rows, ["pr_number"], "platform")
    sizes = rows.groupBy("pr_number").agg(F.count(F.lit(1)).alias("file_count"))
    return top.join(sizes, "pr_number").filter((F.col("file_count") >= 5) & (F.col("share") >= 0.5)).select("pr_number", F.col("platform").alias("bulk_category"), "file_count", F.round("share", 6).alias("bulk_share"))


BULK = f"""
WITH c AS (SELECT pr_number, platform, count(*) AS n FROM {FILES} GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY pr_number)::BIGINT AS file_count FROM c QUALIFY row_number() OVER (PARTITION BY pr_number ORDER BY n DESC, platform) = 1)
SELECT pr_number, platform AS bulk_category, file_count, round(n / file_count, 6) AS bulk_share FROM t WHERE file_count >= 5 AND n / file_count >= 0.5"""


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of each path, in order."""
    return files(spark, sf_dir).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_set("pr_number")), lambda x: x.cast("string")), ",").alias("pr_numbers"))


def owner_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each owner, by grouping sets of owner and platform."""
    rows = files(spark, sf_dir)
    return rows.groupingSets([[F.col("owner"), F.col("platform")], [F.col("owner")]], F.col("owner"), F.col("platform")).agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("pr_number").alias("n_changes"), F.sum("additions").alias("additions"))


def rare_first_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first path of each change in order of additions, then name."""
    return P.keep_best(files(spark, sf_dir), ["pr_number"], [F.col("additions").desc(), F.col("path").asc()]).select("pr_number", "path", "additions")


def path_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated percentiles of additions per platform."""
    return files(spark, sf_dir).groupBy("platform").agg(F.round(F.percentile("additions", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("additions", F.lit(0.95)), 6).alias("p95"), A.upper_median(F.col("additions")).alias("upper_median"))


def merge_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes per author, weighted by age with a half-life of 180 days at the last change."""
    rows = changes(spark, sf_dir)
    last = rows.agg(F.max("merged_at")).scalar()
    aged = rows.withColumn("age", N.days_between(F.col("merged_at"), last))
    return aged.groupBy("author").agg(F.round(F.sum(N.decay(F.col("age"), 180.0)), 6).alias("weight"), F.count(F.lit(1)).alias("n_changes"))


QUERIES = {
    "change_shape": change_shape, "status_pivot": status_pivot, "component_histogram": component_histogram, "path_labels": path_labels, "category_histogram": category_histogram, "rule_match": rule_match, "longest_prefix_owner": longest_prefix_owner,
    "cooccurrence_guarded": cooccurrence_guarded, "later_fixes": later_fixes, "survival": survival, "bulk_changes": bulk_changes, "inverted_index": inverted_index, "owner_rollup": owner_rollup, "rare_first_file": rare_first_file,
    "path_percentiles": path_percentiles, "merge_decay": merge_decay,
}
ORACLE = {
    "change_shape": CHANGE_SHAPE,
    "status_pivot": f"SELECT component, count(*) FILTER (status = 'A') AS files_a, count(*) FILTER (status = 'N') AS files_n, count(*) FILTER (status = 'R') AS files_r FROM {FILES} GROUP BY 1",
    "component_histogram": f"WITH c AS (SELECT platform, component, count(*) AS n FROM {FILES} GROUP BY ALL) SELECT platform, string_agg(component || '=' || n, ',' ORDER BY component) AS histogram FROM c GROUP BY 1",
    "path_labels": " UNION ALL ".join(f"SELECT path, '{k}' AS label FROM {_PATHS} WHERE regexp_matches(p, '{v}')" for k, v in _HITS.items()),
    "category_histogram": f"SELECT CASE {' '.join(f'''WHEN regexp_matches(p, '{v}') THEN '{k}' ''' for k, v in _HITS.items())} ELSE 'unclassified' END AS category, count(*) AS n_paths FROM {_PATHS} GROUP BY 1",
    "rule_match": RULE_MATCH,
    "longest_prefix_owner": f"SELECT DISTINCT path, CASE WHEN component LIKE '%1' THEN platform || '/' || component ELSE platform END AS directory, CASE WHEN component LIKE '%1' THEN 'brand:' || component ELSE 'type:' || platform END AS team FROM {FILES}",
    "cooccurrence_guarded": COOCCURRENCE, "later_fixes": LATER_FIXES, "survival": SURVIVAL, "bulk_changes": BULK,
    "inverted_index": f"SELECT path, string_agg(DISTINCT CAST(pr_number AS VARCHAR), ',' ORDER BY CAST(pr_number AS VARCHAR)) AS pr_numbers FROM {FILES} GROUP BY 1".replace("string_agg(DISTINCT CAST(pr_number AS VARCHAR), ',' ORDER BY CAST(pr_number AS VARCHAR))", "array_to_string(list_sort(list(DISTINCT pr_number)), ',')"),
    "owner_rollup": f"SELECT owner, platform, count(*) AS n_files, count(DISTINCT pr_number) AS n_changes, sum(additions)::BIGINT AS additions FROM {FILES} GROUP BY GROUPING SETS ((owner, platform), (owner))",
    "rare_first_file": f"SELECT pr_number, path, additions FROM {FILES} QUALIFY row_number() OVER (PARTITION BY pr_number ORDER BY additions DESC, path) = 1",
    "path_percentiles": f"SELECT platform, round(quantile_cont(additions, 0.5), 6) AS p50, round(quantile_cont(additions, 0.95), 6) AS p95, list_sort(list(additions))[(count(*) // 2) + 1] AS upper_median FROM {FILES} GROUP BY 1",
    "merge_decay": f"WITH c AS {CHANGES}, l AS (SELECT max(merged_at) AS m FROM c) SELECT author, round(sum(CASE WHEN merged_at >= m THEN 1.0 ELSE round(exp(-ln(2) / 180.0 * (epoch_us(m) - epoch_us(merged_at)) / 86400000000.0), 6) END), 6) AS weight, count(*) AS n_changes FROM c, l GROUP BY 1",
}
