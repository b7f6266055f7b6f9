"""Queries that rank the nations by criteria taken from their customers and suppliers, and compare rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.operators import aggregates as A
from strataloom.operators import ranking as K
from strataloom.plans.files import FILES, files
from strataloom.sources.tables import read_table

#: Weights of the criteria; thresholds are those of the operators.
WEIGHTS = {"spending": 0.4, "balance": 0.25, "supply": 0.2, "urgency": 0.15}


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS.items()), "criterion string, weight double")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alternative, criterion, value): nations on a scale from 0 to 4; every seventh nation's urgency is unknown."""
    orders, customers, suppliers = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    bought = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).groupBy(F.col("c_nationkey").alias("alternative")).agg(F.avg("o_totalprice").alias("spending"), F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgency"))
    held = customers.groupBy(F.col("c_nationkey").alias("alternative")).agg(F.avg("c_acctbal").alias("balance"))
    made = suppliers.groupBy(F.col("s_nationkey").alias("alternative")).agg(F.avg("s_acctbal").alias("supply"))
    wide = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("alternative"))
    for part in (bought, held, made):
        wide = wide.join(part, "alternative", "left")
    wide = wide.withColumn("urgency", F.when(F.col("alternative") % 7 != 0, F.col("urgency")))
    long = wide.unpivot(["alternative"], list(WEIGHTS), "criterion", "value")
    w = Window.partitionBy("criterion")
    low, high = F.min("value").over(w), F.max("value").over(w)
    return long.withColumn("value", F.round(F.try_divide(4 * (F.col("value") - low), high - low), 4))


SCORES = """(WITH b AS (SELECT c_nationkey AS alternative, avg(o_totalprice) AS spending, avg(CAST(o_orderpriority = '1-URGENT' AS INTEGER)) AS urgency FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
  h AS (SELECT c_nationkey AS alternative, avg(c_acctbal) AS balance FROM customer GROUP BY 1), m AS (SELECT s_nationkey AS alternative, avg(s_acctbal) AS supply FROM supplier GROUP BY 1),
  w AS (SELECT n_nationkey AS alternative, spending, balance, supply, CASE WHEN n_nationkey % 7 <> 0 THEN urgency END AS urgency FROM nation LEFT JOIN b ON b.alternative = n_nationkey LEFT JOIN h ON h.alternative = n_nationkey LEFT JOIN m ON m.alternative = n_nationkey),
  l AS (SELECT alternative, 'spending' AS criterion, spending AS value FROM w UNION ALL SELECT alternative, 'balance', balance FROM w UNION ALL SELECT alternative, 'supply', supply FROM w UNION ALL SELECT alternative, 'urgency', urgency FROM w)
  SELECT alternative, criterion, round(4 * (value - min(value) OVER c) / nullif(max(value) OVER c - min(value) OVER c, 0), 4) AS value FROM l WINDOW c AS (PARTITION BY criterion))"""
_W = "(VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS.items()) + ") w(criterion, weight)"


def nation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir)


def ordered_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered weighted aggregate of each nation's criteria."""
    out = A.ordered_weights(scores(spark, sf_dir), "alternative", "value", "criterion", [1.0, 0.55, 0.3, 0.17, 0.1], 1.0, 4.0)
    return out.select("alternative", F.round("value", 6).alias("value"), F.size("trace").alias("n_entries"))


OWA = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY alternative ORDER BY value DESC, criterion) AS k FROM {SCORES} WHERE value IS NOT NULL),
p AS (SELECT *, value * [1.0, 0.55, 0.3, 0.17, 0.1][k]::DOUBLE AS x FROM r)
SELECT alternative, round(least(4.0::DOUBLE, sum(x) FILTER (k = 1) + least(1.0::DOUBLE, coalesce(sum(x) FILTER (k > 1), 0))), 6) AS value, count(*) AS n_entries FROM p GROUP BY 1"""


def electre_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credibility that a nation outranks another."""
    return K.electre(scores(spark, sf_dir), weights(spark))


ELECTRE = f"""
WITH s AS {SCORES}, n AS (SELECT DISTINCT alternative FROM s), x AS (SELECT a.alternative AS a, b.alternative AS b, weight, a.value AS va, b.value AS vb FROM s a JOIN s b USING (criterion) JOIN {_W} USING (criterion) WHERE a.alternative <> b.alternative AND a.value IS NOT NULL AND b.value IS NOT NULL),
y AS (SELECT *, CASE WHEN vb - va <= 0 THEN 1 WHEN vb - va >= 1 THEN 0 ELSE round(1 - (vb - va), 6) END AS c, CASE WHEN vb - va <= 1 THEN 0 WHEN vb - va >= 3 THEN 1 ELSE round((vb - va - 1) / 2, 6) END AS d FROM x),
z AS (SELECT a, b, sum(weight * c) / sum(weight) AS concordance, count(*) AS n_criteria FROM y GROUP BY a, b),
q AS (SELECT a, b, product(CASE WHEN d > concordance AND concordance < 1 THEN (1 - d) / (1 - concordance) WHEN d >= 1 THEN 0 ELSE 1 END) AS damp FROM y JOIN z USING (a, b) GROUP BY a, b)
SELECT p.alternative AS a, r.alternative AS b, round(concordance, 6) AS concordance, round(greatest(0, least(1, concordance * damp)), 6) AS credibility, coalesce(n_criteria, 0) AS n_criteria
FROM n p JOIN n r ON p.alternative <> r.alternative LEFT JOIN z ON z.a = p.alternative AND z.b = r.alternative LEFT JOIN q ON q.a = p.alternative AND q.b = r.alternative"""


def electre_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by both distillations."""
    return K.electre_ranking(K.electre(scores(spark, sf_dir), weights(spark)))


def promethee_ii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net flows of the nations."""
    flows = K.promethee(scores(spark, sf_dir), weights(spark))
    return flows.select("alternative", *[F.round(c, 5).alias(c) for c in ("phi_plus", "phi_minus", "phi", "sigma")])


_PREF = f"""s AS {SCORES}, n AS (SELECT DISTINCT alternative FROM s),
x AS (SELECT a.alternative AS a, b.alternative AS b, sum(weight * greatest(0.0, least(1.0, a.value - b.value))) / sum(weight) AS ab FROM s a JOIN s b USING (criterion) JOIN {_W} USING (criterion) WHERE a.alternative <> b.alternative AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2),
e AS (SELECT p.alternative AS a, r.alternative AS b, coalesce(x.ab, 0) AS ab, coalesce(y.ab, 0) AS ba FROM n p JOIN n r ON p.alternative <> r.alternative LEFT JOIN x ON x.a = p.alternative AND x.b = r.alternative LEFT JOIN x y ON y.b = p.alternative AND y.a = r.alternative),
f AS (SELECT a AS alternative, round(avg(ab), 6) AS phi_plus, round(avg(ba), 6) AS phi_minus, round(avg(ab - ba), 6) AS phi, round(stddev_pop(ab - ba), 6) AS sigma FROM e GROUP BY a)"""


def promethee_iii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the nations where intervals around their flows overlap."""
    spread = K.promethee_intervals(K.promethee(scores(spark, sf_dir), weights(spark)))
    return spread.select("alternative", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "position")


def dirichlet_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each nation is among the first five under 40 draws of the weights."""
    drawn = K.dirichlet_weights(weights(spark), 40)
    trials = spark.range(40).withColumnRenamed("id", "trial").withColumn("_one", F.lit(1)).join(scores(spark, sf_dir).withColumn("_one", F.lit(1)), "_one").drop("_one")
    ranked = K.promethee(trials, drawn, by=["trial"])
    return A.frequency_summary(K.rank_frequencies(ranked), "alternative", "position", "n", 5)


def bootstrap_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean changed lines of each platform over 20 draws of its files: the spread of a mean."""
    drawn = K.bootstrap(files(spark, sf_dir).select("platform", "additions", F.concat_ws("#", "path", "pr_number").alias("key")), "platform", "key", 20)
    means = drawn.groupBy("platform", "trial").agg((F.sum(F.col("copies") * F.col("additions")) / F.sum("copies")).alias("mean"))
    return means.groupBy("platform").agg(F.count(F.lit(1)).alias("n_trials"), F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("spread"))


def rank_frequency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of line numbers per part brand from their frequencies."""
    lines, parts = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_linenumber"), read_table(spark, sf_dir, "part", "p_partkey", "p_brand")
    table = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy("p_brand", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    out = A.frequency_summary(table, "p_brand", "l_linenumber", "n", 3)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "mode_share", "top_share")})


RANK_FREQUENCY = """
WITH t AS (SELECT p_brand, l_linenumber AS v, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY p_brand ORDER BY v) AS u, sum(n) OVER (PARTITION BY p_brand) AS t FROM t)
SELECT p_brand, round(sum(v * n) / sum(n), 6) AS mean, min(v) FILTER (u >= 0.5 * t) AS median, min(v) FILTER (u >= 0.05 * t) AS p05, min(v) FILTER (u >= 0.95 * t) AS p95, first(v ORDER BY n DESC, v) AS mode, round(max(n) / sum(n), 6) AS mode_share, round(coalesce(sum(n) FILTER (v <= 3), 0) / sum(n), 6) AS top_share FROM c GROUP BY 1"""


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return lines.groupBy(F.col("l_orderkey").alias("subject")).agg((F.max("l_linenumber") % 5).alias("a"), ((F.max("l_linenumber") + (F.max("l_partkey") % 3 == 0).cast("int")) % 5).alias("b"))


_RATINGS = "(SELECT l_orderkey AS subject, max(l_linenumber) % 5 AS a, (max(l_linenumber) + CAST(max(l_partkey) % 3 = 0 AS INTEGER)) % 5 AS b FROM lineitem GROUP BY 1)"


def rating_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.confusion(_ratings(spark, sf_dir))


def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two ratings of the orders."""
    return K.cohen_kappa(_ratings(spark, sf_dir))


COHEN = f"""
WITH c AS (SELECT a, b, count(*) AS n FROM {_RATINGS} GROUP BY ALL), s AS (SELECT greatest(max(a), max(b)) - least(min(a), min(b)) AS d, sum(n) AS n FROM c), ra AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1),
e AS (SELECT sum(na * nb * (1 - pow((a - b) / d, 2))) AS e FROM ra, rb, s), o AS (SELECT sum(c.n * (1 - pow((a - b) / d, 2))) AS o FROM c, s)
SELECT CAST(n AS BIGINT) AS n, round(o / n, 6) AS observed, round(e / pow(n, 2), 6) AS expected, round((o / n - e / pow(n, 2)) / (1 - e / pow(n, 2)), 6) AS kappa FROM s, e, o"""


def krippendorff_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the line numbers of an order."""
    return K.krippendorff_alpha(read_table(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("subject"), F.col("l_linenumber").alias("value")))


KRIPPENDORFF = """
WITH u AS (SELECT l_orderkey, count(*) AS k, sum(l_linenumber)::DOUBLE AS s, sum(l_linenumber * l_linenumber)::DOUBLE AS ss FROM lineitem GROUP BY 1 HAVING count(*) >= 2),
o AS (SELECT count(*) AS n, sum(k * ss - s * s) / sum(k * (k - 1) / 2) AS observed, (sum(k) * sum(ss) - sum(s) * sum(s)) / (sum(k) * (sum(k) - 1) / 2) AS expected FROM u)
SELECT n, round(observed, 6) AS observed, round(expected, 6) AS expected, round(1 - observed / expected, 6) AS alpha FROM o"""


def _two_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_nationkey").alias("item")).agg(F.avg("c_acctbal").alias("u"), F.count(F.lit(1)).alias("v"))
    one = Window.partitionBy(F.lit(1))
    return s.select("item", F.row_number().over(one.orderBy(F.col("u").desc(), "item")).alias("x"), F.row_number().over(one.orderBy(F.col("v").desc(), "item")).alias("y"))


_TWO = "(SELECT n_nationkey AS item, row_number() OVER (ORDER BY avg(c_acctbal) DESC, n_nationkey) AS x, row_number() OVER (ORDER BY count(*) DESC, n_nationkey) AS y FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey)"


def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two rankings of the nations."""
    return K.kendall_tau(_two_rankings(spark, sf_dir))


def top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.top_overlap(_two_rankings(spark, sf_dir), 5)


def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a platform's additions its greatest changes hold."""
    sums = files(spark, sf_dir).groupBy("platform", "pr_number").agg(F.sum("additions").alias("additions"))
    return A.concentration(sums, "platform", "additions", "pr_number").withColumns({c: F.round(c, 9) for c in ("top1_share", "top3_share")})


QUERIES = {
    "nation_scores": nation_scores, "ordered_weights": ordered_weights, "electre_pairs": electre_pairs, "electre_ranking": electre_ranking, "promethee_ii": promethee_ii, "promethee_iii": promethee_iii, "dirichlet_stability": dirichlet_stability,
    "bootstrap_stability": bootstrap_stability, "rank_frequency_summary": rank_frequency_summary, "rating_confusion": rating_confusion, "cohen_kappa": cohen_kappa, "krippendorff_alpha": krippendorff_alpha, "kendall_tau": kendall_tau,
    "top_overlap": top_overlap, "concentration": concentration,
}
ORACLE = {
    "nation_scores": f"SELECT * FROM {SCORES}", "ordered_weights": OWA, "electre_pairs": ELECTRE,
    "promethee_ii": f"WITH {_PREF} SELECT alternative, round(phi_plus, 5) AS phi_plus, round(phi_minus, 5) AS phi_minus, round(phi, 5) AS phi, round(sigma, 5) AS sigma FROM f",
    "promethee_iii": f"WITH {_PREF}, i AS (SELECT alternative, phi - 0.15 * sigma AS low, phi + 0.15 * sigma AS high FROM f) SELECT alternative, round(round(low, 6), 4) AS low, round(round(high, 6), 4) AS high, 1 + (SELECT count(*) FROM i j WHERE j.low > i.high) AS position FROM i",
    "rank_frequency_summary": RANK_FREQUENCY, "rating_confusion": f"SELECT a, b, count(*) AS n FROM {_RATINGS} GROUP BY ALL", "cohen_kappa": COHEN, "krippendorff_alpha": KRIPPENDORFF,
    "kendall_tau": f"WITH t AS {_TWO}, p AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s FROM t a JOIN t b ON a.item < b.item) SELECT count(*) FILTER (s > 0) AS concordant, count(*) FILTER (s < 0) AS discordant, round((count(*) FILTER (s > 0) - count(*) FILTER (s < 0)) / (count(*) FILTER (s > 0) + count(*) FILTER (s < 0)), 6) AS tau FROM p",
    "top_overlap": f"SELECT count(*) FILTER (x <= 5 AND y <= 5) / least(5, count(*)) AS overlap FROM {_TWO}",
    "concentration": f"WITH s AS (SELECT platform, pr_number, sum(additions) AS v FROM {FILES} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY v DESC, pr_number) AS k FROM s) SELECT platform, round(sum(v) FILTER (k <= 1) / sum(v), 9) AS top1_share, round(sum(v) FILTER (k <= 3) / sum(v), 9) AS top3_share FROM r GROUP BY 1",
}
