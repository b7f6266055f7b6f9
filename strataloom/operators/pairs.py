"""Joins that make pairs: shared keys with guards, time ranges, what came later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_pairs(members: DataFrame, key: str, member: str, least: int = 2, most: int = 40) -> DataFrame:
    """(``key``, a, b, fan_out), a < b: members that share a key which between ``least`` and ``most`` distinct members have.

    The count is taken before the self-join: keys that everything shares say nothing, and would
    make pairs in the square of their size. ``most`` bounds a key's pairs.
    """
    distinct = members.select(key, member).dropna().distinct()
    guarded = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("fan_out")).filter(F.col("fan_out").between(least, most))
    kept = distinct.join(guarded, key)
    return kept.select(key, F.col(member).alias("a"), "fan_out").join(kept.select(key, F.col(member).alias("b")), key).filter("a < b").select(key, "a", "b", "fan_out")


def inner_pairs(members: DataFrame, key: str, member: str, groups: DataFrame, group: str, least: int = 2, most: int = 40) -> DataFrame:
    """The pairs of :func:`shared_pairs` whose members are in one group of ``groups`` (``member``, ``group``), with it; no others are made."""
    distinct = members.select(key, member).dropna().distinct()
    guarded = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("fan_out")).filter(F.col("fan_out").between(least, most))
    kept = distinct.join(guarded, key).join(groups, member)
    return kept.select(key, group, F.col(member).alias("a"), "fan_out").join(kept.select(key, group, F.col(member).alias("b")), [key, group]).filter("a < b").select(key, group, "a", "b", "fan_out")


def shared_stars(members: DataFrame, key: str, member: str, least: int = 2, most: int = 40) -> DataFrame:
    """(``key``, a, b, fan_out), a < b: as :func:`shared_pairs`, but only each key's least member with every other. The components are the same, in a row a member."""
    distinct = members.select(key, member).dropna().distinct()
    guarded = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("fan_out"), F.min(member).alias("a")).filter(F.col("fan_out").between(least, most))
    return distinct.join(guarded, key).filter(F.col("a") < F.col(member)).select(key, "a", F.col(member).alias("b"), "fan_out")


def combine_pairs(pairs: DataFrame, strength: Column) -> DataFrame:
    """(a, b, strength, n_edges): pairs with their evidence combined by noisy-or."""
    from strataloom.functions.numbers import noisy_or

    return pairs.groupBy("a", "b").agg(noisy_or(strength).alias("strength"), F.count(F.lit(1)).alias("n_edges"))


def later_within(first: DataFrame, then: DataFrame, on: str, key: str, at: str, days: int) -> DataFrame:
    """(first_key, then_key, n_shared): events of ``then`` that share ``on`` with one of ``first`` and follow it within ``days``, itself excepted.

    An equi-join on ``on`` and on time buckets of ``days``: an event looks into its own bucket and
    the one before, so a key of many events meets only its neighbours in time.
    """
    span = days * 86_400_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    a = first.select(F.col(on).alias("_on"), F.col(key).alias("first_key"), micros.alias("_a")).withColumn("_bucket", F.explode(F.array(F.floor(F.col("_a") / span), F.floor(F.col("_a") / span) + 1)))
    b = then.select(F.col(on).alias("_on"), F.col(key).alias("then_key"), micros.alias("_b")).withColumn("_bucket", F.floor(F.col("_b") / span))
    near = a.join(b, ["_on", "_bucket"]).filter((F.col("_b") > F.col("_a")) & (F.col("_b") <= F.col("_a") + span) & (F.col("first_key") != F.col("then_key")))
    return near.select("first_key", "then_key", "_on").distinct().groupBy("first_key", "then_key").agg(F.count(F.lit(1)).alias("n_shared"))


def state_at(changes: DataFrame, key: str, at: str, state: str, checkpoints: DataFrame, checkpoint: str) -> DataFrame:
    """``checkpoints`` (``key``, ``checkpoint``) with the last ``state`` not after each, as an as-of join: changes and checkpoints are merged in order of time."""
    merged = changes.select(key, F.col(at).alias("_at"), F.struct(F.col(state)).alias("_state"), F.lit(0).alias("_probe")).unionByName(
        checkpoints.select(key, F.col(checkpoint).alias("_at"), F.lit(None).cast(changes.select(F.struct(F.col(state)).alias("s")).schema["s"].dataType).alias("_state"), F.lit(1).alias("_probe"))
    )
    w = Window.partitionBy(key).orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = merged.withColumn("_last", F.last("_state", ignorenulls=True).over(w))
    return filled.filter("_probe = 1").select(key, F.col("_at").alias(checkpoint), F.col(f"_last.{state}").alias(state))


def keep_best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row a key by ``order``, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows a key by ``order``, with their rank from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def stratified_sample(rows: DataFrame, stratum: str, key: str, salt: str, size: int) -> DataFrame:
    """``size`` rows a stratum in the order of the salted SHA-256 of their key: the same rows whatever the order of the input."""
    rank = F.sha2(F.concat(F.lit(salt), F.lit("|"), F.col(key).cast("string")), 256)
    return top_k(rows.withColumn("_hash", rank), [stratum], [F.col("_hash").asc(), F.col(key).asc()], size).drop("_hash")


def round_robin_sample(rows: DataFrame, stratum: str, key: str, size: int) -> DataFrame:
    """``size`` rows in all, one after the other from each stratum, by key."""
    w = Window.partitionBy(stratum).orderBy(key)
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", stratum).limit(size)


def independent_entries(rows: DataFrame, owner: str, group: str, value: str, key: str) -> DataFrame:
    """The strongest row an owner and group of dependent ones, with the keys of the others as excluded."""
    w = Window.partitionBy(owner, group).orderBy(F.col(value).desc(), F.col(key).asc())
    ranked = rows.withColumn("_rank", F.row_number().over(w))
    others = ranked.filter("_rank > 1").groupBy(owner, group).agg(F.array_sort(F.collect_list(key)).alias("excluded"))
    best = ranked.filter("_rank = 1").drop("_rank").join(others, [owner, group], "left")
    return best.withColumn("excluded", F.coalesce("excluded", F.array().cast(others.schema["excluded"].dataType)))


def both_missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(``key``, side): keys of one table that the other lacks; NULL keys are none."""
    a, b = left.select(key).dropna().distinct(), right.select(key).dropna().distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))


def filter_pairs(edges: DataFrame, least: float, most_days: float) -> DataFrame:
    """(a, b, weight, n_edges, reason) of typed edges (a, b, edge_type, tier, strength, usable, days): pairs with their combined strength, and why one is to be left out.

    Reasons, the first that holds: every edge is guarded; only edges of tier C; structural edges
    alone and too far apart in time; too weak together. NULL for a pair that is kept.
    """
    from strataloom.functions.numbers import noisy_or

    usable = F.col("usable")
    strength = F.when(usable, F.col("strength"))
    grouped = edges.groupBy("a", "b").agg(
        noisy_or(strength).alias("weight"), F.count(F.lit(1)).alias("n_edges"), F.count_if(usable).alias("_usable"), F.bool_and(F.when(usable, F.col("tier") == "C")).alias("_weak"), F.bool_and(F.when(usable, F.col("edge_type").isin("structural", "symbol_downstream", "migration_dependency"))).alias("_structural"), F.max(F.abs("days")).alias("_days"),
    )
    reason = F.when(F.col("_usable") == 0, "all_guarded").when(F.col("_weak"), "tier_c_only").when(F.col("_structural") & (F.col("_days") > most_days), "far_apart").when(F.col("weight") < least, "weak")
    return grouped.select("a", "b", F.round("weight", 6).alias("weight"), "n_edges", reason.alias("reason"))


def degrees(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """``nodes`` with degree: the ends of ``edges`` (a, b) at each, repeated edges included; 0 for a node without."""
    ends = edges.select(F.col("a").alias(key)).unionByName(edges.select(F.col("b").alias(key))).groupBy(key).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(ends, key, "left").fillna(0, ["degree"])


def keep_verdicts(queue: DataFrame, earlier: DataFrame, key: str, verdict: str = "verdict") -> DataFrame:
    """A new audit queue with the verdicts that earlier queues gave; of several the greatest."""
    given = earlier.filter(F.col(verdict).isNotNull()).groupBy(key).agg(F.max(verdict).alias(verdict))
    return queue.drop(verdict).join(given, key, "left")
