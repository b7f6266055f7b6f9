"""Rankings over several criteria: ELECTRE III, PROMETHEE II and III, agreement of rankings and ratings, stability under resampling.

Alternatives come as long tables (alternative, criterion, value); a NULL value is unknown, and only
criteria known on both sides of a pair are compared. Tables keyed by a trial as well run all trials
in one job. Pairs are made by equality on trial and criterion, so their number is the square of the
alternatives of a trial: pools are to be bounded before (``candidate_pool``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions import numbers as N


def criterion_pairs(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, a, b, criterion, va, vb) of all ordered pairs of different alternatives, known values only."""
    keys = [*by, "criterion"]
    known = values.filter("value IS NOT NULL")
    a = known.select(*keys, F.col("alternative").alias("a"), F.col("value").alias("va"))
    b = known.select(*keys, F.col("alternative").alias("b"), F.col("value").alias("vb"))
    return a.join(b, keys).filter("a <> b")


def _pairs(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """All ordered pairs of different alternatives (of a trial), whatever is known."""
    names = values.select(*by, "alternative").distinct()
    key = list(by) or ["_one"]
    a = names.withColumn("_one", F.lit(1)).select(*key, F.col("alternative").alias("a"))
    b = names.withColumn("_one", F.lit(1)).select(*key, F.col("alternative").alias("b"))
    return a.join(b, key).filter("a <> b").select(*by, "a", "b")


def electre(values: DataFrame, weights: DataFrame, q: float = 0.0, p: float = 1.0, v: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, a, b, concordance, credibility, n_criteria) of ELECTRE III; pairs without a shared criterion have neither.

    ``weights``: (``by``, criterion, weight).
    """
    rows = criterion_pairs(values, by).join(F.broadcast(weights), [*[c for c in by if c in weights.columns], "criterion"])
    own, other = F.col("va"), F.col("vb")
    scored = rows.withColumn("_c", F.round(N.concordance(own, other, q, p), 6)).withColumn("_d", F.round(N.discordance(own, other, p, v), 6))
    whole = scored.groupBy(*by, "a", "b").agg((F.sum(F.col("weight") * F.col("_c")) / F.sum("weight")).alias("concordance"), F.collect_list("_d").alias("_ds"), F.count(F.lit(1)).alias("n_criteria"))
    c = F.col("concordance")
    damp = F.aggregate("_ds", F.lit(1.0), lambda acc, d: F.when((d > c) & (c < 1), acc * (1 - d) / (1 - c)).when(d >= 1, 0.0).otherwise(acc))
    done = whole.withColumn("credibility", F.round(N.clamp(c * damp, 0.0, 1.0), 6)).withColumn("concordance", F.round("concordance", 6)).drop("_ds")
    return _pairs(values, by).join(done, [*by, "a", "b"], "left").fillna({"n_criteria": 0})


def qualification(cred: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    """How many of a pool each alternative outranks less how many outrank it, at the cut below the pool's highest credibility.

    a outranks b where the credibility lies above the cut and beats the converse by the threshold
    alpha - beta * credibility; the diagonal of ``cred`` is 0.
    """
    slack = alpha - beta * cred
    top = cred.max()
    wins = (cred > top - (alpha - beta * top)) & (cred > cred.T + slack)
    return wins.sum(axis=1) - wins.sum(axis=0)


def distillate(cred: np.ndarray, pool: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    """The alternatives of ``pool`` that are best in it, and best among these, until that tells no more of them apart."""
    inner = cred[np.ix_(pool, pool)]
    if len(pool) < 2 or inner.max() <= 0:
        return pool
    score = qualification(inner, alpha, beta)
    best = pool[score == score.max()]
    return best if len(best) == len(pool) else distillate(cred, best, alpha, beta)


def descending(cred: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    """The class, from 0, of each alternative of a credibility matrix in the descending distillation."""
    place = np.full(len(cred), -1)
    for rank in range(len(cred)):
        pool = np.flatnonzero(place < 0)
        if len(pool) == 0:
            break
        place[distillate(cred, pool, alpha, beta)] = rank
    return place


def distillations(cred: np.ndarray, alpha: float, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """The classes of both distillations, 0 the best: the ascending one is the descending one of the converse relation, read backwards."""
    up = descending(cred.T, alpha, beta)
    return descending(cred, alpha, beta), up.max(initial=0) - up


def electre_ranking(pairs: DataFrame, alpha: float = 0.30, beta: float = 0.15, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, alternative, down, up, median, tier, n_incomparable) from ``electre``: both distillations, their mean, and those no credibility decides.

    Distillation is a fixpoint over a shrinking set; each trial's pool is one group in pandas.
    """
    kind = pairs.schema["a"].dataType
    schema = T.StructType([*[pairs.schema[c] for c in by], T.StructField("alternative", kind), T.StructField("down", T.LongType()), T.StructField("up", T.LongType()), T.StructField("n_incomparable", T.LongType())])

    def run(key: tuple, pool: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pool["a"]) | set(pool["b"]))
        at = {x: i for i, x in enumerate(names)}
        cred = np.zeros((len(names), len(names)))
        cred[pool["a"].map(at), pool["b"].map(at)] = pool["credibility"].fillna(0.0)
        np.fill_diagonal(cred, 0.0)
        down, up = distillations(cred, alpha, beta)
        open_ = ((cred < 0.5) & (cred.T < 0.5)).sum(axis=1) - 1
        return pd.DataFrame([(*key, *r) for r in zip(names, down.tolist(), up.tolist(), open_.tolist(), strict=True)], columns=schema.names)

    grouped = pairs.groupBy(*by).applyInPandas(run, schema) if by else pairs.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(lambda k, d: run((), d), schema)
    median = grouped.withColumn("median", (F.col("down") + F.col("up")) / 2)
    return median.withColumn("tier", F.dense_rank().over(Window.partitionBy(*by).orderBy("median")))


def promethee(values: DataFrame, weights: DataFrame, q: float = 0.0, p: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, alternative, phi_plus, phi_minus, phi, sigma, position) of PROMETHEE II; a pair without a shared criterion prefers neither.

    sigma is the population deviation of the alternative's pairwise net preferences, for PROMETHEE III.
    """
    rows = criterion_pairs(values, by).join(F.broadcast(weights), [*[c for c in by if c in weights.columns], "criterion"])
    pref = rows.withColumn("_p", N.preference(F.col("va") - F.col("vb"), q, p))
    one = pref.groupBy(*by, "a", "b").agg((F.sum(F.col("weight") * F.col("_p")) / F.sum("weight")).alias("ab"))
    every = _pairs(values, by).join(one, [*by, "a", "b"], "left").withColumn("ab", F.coalesce("ab", F.lit(0.0)))
    both = every.join(every.select(*by, F.col("a").alias("b"), F.col("b").alias("a"), F.col("ab").alias("ba")), [*by, "a", "b"])
    flows = both.groupBy(*by, F.col("a").alias("alternative")).agg(F.avg("ab").alias("phi_plus"), F.avg("ba").alias("phi_minus"), F.avg(F.col("ab") - F.col("ba")).alias("phi"), F.stddev_pop(F.col("ab") - F.col("ba")).alias("sigma"))
    rounded = flows.withColumns({c: F.round(c, 6) for c in ("phi_plus", "phi_minus", "phi", "sigma")})
    return rounded.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("phi").desc(), "alternative")))


def promethee_intervals(flows: DataFrame, alpha: float = 0.15, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, alternative, low, high, position) of PROMETHEE III: position is 1 and those whose low lies above one's high."""
    spread = flows.select(*by, "alternative", (F.col("phi") - alpha * F.col("sigma")).alias("low"), (F.col("phi") + alpha * F.col("sigma")).alias("high"))
    key = list(by) or ["_one"]
    mine = spread.withColumn("_one", F.lit(1))
    better = mine.select(*key, F.col("low").alias("_low"))
    counted = mine.join(better, key).filter(F.col("_low") > F.col("high")).groupBy(*by, "alternative").agg(F.count(F.lit(1)).alias("_n"))
    ranked = spread.join(counted, [*by, "alternative"], "left").withColumn("position", F.coalesce("_n", F.lit(0)) + 1).drop("_n")
    return ranked.withColumns({c: F.round(c, 6) for c in ("low", "high")})


def candidate_pool(values: DataFrame, weights: DataFrame, size: int = 30) -> DataFrame:
    """The rows of the ``size`` alternatives of greatest weighted sum, ties by name: the pool that stability trials rank."""
    best = values.join(F.broadcast(weights), "criterion").groupBy("alternative").agg(F.sum(F.col("weight") * F.col("value")).alias("_s")).orderBy(F.col("_s").desc_nulls_last(), "alternative").limit(size)
    return values.join(F.broadcast(best.select("alternative")), "alternative", "left_semi")


def dirichlet_weights(weights: DataFrame, trials: int, concentration: float = 40.0, seed: int = 7) -> DataFrame:
    """(trial, criterion, weight): weights drawn around the given ones, adding up to 1 in each trial.

    A gamma draw of shape k is the sum of squares of normal draws where k is not small; draws come
    from hashes of seed, trial and criterion, so they do not depend on the order of rows.
    """
    spark = weights.sparkSession
    grid = spark.range(trials).withColumnRenamed("id", "trial").withColumn("_one", F.lit(1)).join(weights.withColumn("_one", F.lit(1)), "_one").drop("_one")

    def unit(salt: str) -> Column:
        return (F.pmod(F.xxhash64(F.lit(f"{seed}{salt}"), "trial", "criterion"), F.lit(2**52)) + 0.5) / F.lit(float(2**52))

    shape = F.col("weight") * concentration
    # Wilson-Hilferty: the cube root of a gamma draw is close to normal
    normal = F.sqrt(-2 * F.log(unit("a"))) * F.cos(2 * F.pi() * unit("b"))
    third = 1 - 1 / (9 * shape) + normal / (3 * F.sqrt(shape))
    drawn = grid.withColumn("_g", shape * F.pow(F.greatest(third, F.lit(1e-3)), F.lit(3.0)))
    return drawn.withColumn("weight", F.col("_g") / F.sum("_g").over(Window.partitionBy("trial"))).drop("_g")


def bootstrap(rows: DataFrame, owner: str, key: str, trials: int, seed: int = 7) -> DataFrame:
    """``rows`` drawn with replacement within each owner, for each trial: (trial, copies, and the columns of ``rows``).

    An owner of n rows makes n draws a trial; each draw names a row by the hash of seed, trial,
    owner and draw. Copies of a row are counted, rows that no draw names are left out.
    """
    w = Window.partitionBy(owner).orderBy(key)
    numbered = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(owner)))
    draws = numbered.select(owner, "_n", F.col("_i").alias("_draw"), F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    named = draws.withColumn("_i", F.pmod(F.xxhash64(F.lit(seed), "trial", owner, "_draw"), F.col("_n")).cast("int"))
    copies = named.groupBy("trial", owner, "_i").agg(F.count(F.lit(1)).alias("copies"))
    return copies.join(numbered.drop("_n"), [owner, "_i"]).drop("_i")


def rank_frequencies(ranked: DataFrame) -> DataFrame:
    """(alternative, position, n) over the trials of a ranking."""
    return ranked.groupBy("alternative", "position").agg(F.count(F.lit(1)).alias("n"))


def combine_stability(parts: dict[str, DataFrame]) -> DataFrame:
    """(alternative, min_share, mean_share, n_analyses) of top shares of several stability analyses (alternative, top_share), full outer."""
    rows = None
    for name, part in parts.items():
        one = part.select("alternative", F.lit(name).alias("analysis"), "top_share")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("alternative").agg(F.round(F.min("top_share"), 6).alias("min_share"), F.round(F.avg("top_share"), 6).alias("mean_share"), F.count(F.lit(1)).alias("n_analyses"))


def confusion(ratings: DataFrame) -> DataFrame:
    """(a, b, n) of ``ratings`` (subject, a, b)."""
    return ratings.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def cohen_kappa(ratings: DataFrame) -> DataFrame:
    """(n, observed, expected, kappa) with quadratic weights of two integer ratings (a, b); NULL ratings are left out, kappa is NULL without variance.

    Computed from the confusion counts, which are as many as pairs of categories.
    """
    cells = confusion(ratings.dropna(subset=["a", "b"]))
    span = cells.agg((F.greatest(F.max("a"), F.max("b")) - F.least(F.min("a"), F.min("b"))).alias("d")).scalar()
    agree = lambda a, b: 1 - F.pow((a - b) / F.greatest(span, F.lit(1)), 2)
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    margins = rows.withColumn("_one", F.lit(1)).join(F.broadcast(columns.withColumn("_one", F.lit(1))), "_one").agg(F.sum(F.col("na") * F.col("nb") * agree(F.col("a"), F.col("b"))).alias("e")).scalar()
    out = cells.agg(F.sum("n").alias("n"), F.sum(F.col("n") * agree(F.col("a"), F.col("b"))).alias("_o"))
    done = out.select("n", (F.col("_o") / F.col("n")).alias("observed"), (margins / F.pow("n", 2)).alias("expected"))
    kappa = F.when(F.abs(1 - F.col("expected")) >= 1e-12, (F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    return done.withColumn("kappa", F.round(kappa, 6)).withColumns({c: F.round(c, 6) for c in ("observed", "expected")})


def krippendorff_alpha(ratings: DataFrame) -> DataFrame:
    """(n, observed, expected, alpha) of interval alpha over ``ratings`` (subject, value): mean squared differences of pairs within subjects, against all pairs.

    Sums of values and squares stand for the pairs: n * sum(v^2) - sum(v)^2 is the sum over pairs of
    (v - w)^2, so no pair is made. Subjects with one rating are left out.
    """
    usable = ratings.dropna().groupBy("subject").agg(F.count("value").alias("k"), F.sum("value").cast("double").alias("s"), F.sum(F.col("value") * F.col("value")).cast("double").alias("ss")).filter("k >= 2")
    within = F.sum(F.col("k") * F.col("ss") - F.pow("s", 2)) / F.sum(F.col("k") * (F.col("k") - 1) / 2)
    n, s, ss = F.sum("k"), F.sum("s"), F.sum("ss")
    overall = (n * ss - s * s) / (n * (n - 1) / 2)
    out = usable.agg(F.count(F.lit(1)).alias("n"), within.alias("observed"), overall.alias("expected"))
    return out.withColumn("alpha", F.round(F.when(F.col("expected") > 0, 1 - F.col("observed") / F.col("expected")), 6)).withColumns({c: F.round(c, 6) for c in ("observed", "expected")})


def kendall_tau(rankings: DataFrame) -> DataFrame:
    """(concordant, discordant, tau) of two rankings (item, x, y) of the same items."""
    one = rankings.dropna().withColumn("_one", F.lit(1))
    pairs = one.join(one.select(F.col("item").alias("item2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "_one"), "_one").filter("item < item2")
    sign = F.signum(F.col("x") - F.col("x2")) * F.signum(F.col("y") - F.col("y2"))
    out = pairs.agg(F.count_if(sign > 0).alias("concordant"), F.count_if(sign < 0).alias("discordant"))
    return out.withColumn("tau", F.round(F.try_divide(F.col("concordant") - F.col("discordant"), F.col("concordant") + F.col("discordant")), 6))


def top_overlap(rankings: DataFrame, n: int) -> DataFrame:
    """(overlap): the share of the first ``n`` items of one ranking that are among the first ``n`` of the other."""
    return rankings.agg((F.count_if((F.col("x") <= n) & (F.col("y") <= n)) / F.least(F.lit(n), F.count(F.lit(1)))).alias("overlap"))
