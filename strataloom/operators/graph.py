"""Graph operators on edge tables: components, reachability, fan-in and fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import cut_lineage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node that the node is connected to.

    Alternates two steps on the edge table until it stays the same: each node links its greater
    neighbours to the least of all (large star), then its smaller ones (small star). The number of
    rounds grows with the logarithm of the longest path; edges never multiply, and no node's
    neighbours are gathered: the least of them is an aggregate that is joined back. Edges with a
    NULL end are left out; a self-edge makes its node a component. Labels that are not final after
    ``max_rounds`` are an error, not a result.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    links = cut_lineage(pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    signature = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        links = cut_lineage(joined.select(F.col("b").alias("x"), F.col("m").alias("y")).filter("x <> y").unionByName(joined.select(F.col("a").alias("x"), F.col("m").alias("y"))).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        now = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == signature:
            break
        signature = now
    else:
        raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    return nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def reachable(edges: DataFrame, depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(source, node, depth): nodes within ``depth`` steps of each source, at their least depth; a source is not its own."""
    steps = edges.select(F.col(src).alias("_from"), F.col(dst).alias("_to")).dropna().distinct()
    frontier = steps.filter("_from <> _to").select(F.col("_from").alias("source"), F.col("_to").alias("node"), F.lit(1).alias("depth"))
    seen = frontier
    for level in range(2, depth + 1):
        onward = frontier.join(steps, frontier["node"] == steps["_from"]).select("source", F.col("_to").alias("node")).filter("source <> node").distinct()
        frontier = onward.join(seen, ["source", "node"], "left_anti").withColumn("depth", F.lit(level))
        seen = seen.unionByName(frontier)
    return seen


def fan(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, fan_in, fan_out): distinct neighbours on either side, self-edges left out."""
    clean = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).dropna().filter("s <> d").distinct()
    sides = clean.select(F.col("s").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(clean.select(F.col("d").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return sides.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def hub_threshold(fans: DataFrame, percentile: float) -> DataFrame:
    """(threshold): the fan-in at place floor(n * percentile) of the ascending fan-ins above 0, and (n)."""
    positive = fans.filter("fan_in > 0").groupBy("fan_in").agg(F.count(F.lit(1)).alias("c"))
    upto = positive.withColumn("upto", F.sum("c").over(Window.orderBy("fan_in"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    place = F.least(F.floor(F.col("n") * F.lit(percentile)), F.col("n") - 1)
    return upto.filter(F.col("upto") > place).agg(F.min("fan_in").alias("threshold"), F.max("n").alias("n"))
