"""Weighted communities of a pair graph, their split by size, and walks that respect time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.graph import connected_components
from strataloom.operators.skew import BROADCAST_ROWS
from strataloom.session import cut_lineage, release

#: Rounds of a level, levels, and the gain of modularity below which a level is done.
ROUNDS, LEVELS, LEAST_GAIN = 12, 12, 1e-4
#: Weights are counted in whole parts of 1, so that sums and ties do not depend on the order of rows.
UNIT = 1_000_000
#: Up to so many nodes, what is known of each is sent to every executor as arrays, and links are kept packed; the result is the same.
ARRAY_NODES = 5_000_000
#: Up to so many bytes of events and times of touches, these are sent to every executor as arrays; the result is the same.
ARRAY_BYTES = 400_000_000
#: Touches that a walk over arrays looks at together, and sources that are walked together, about.
WALK_HITS, WALK_SOURCES = 400_000, 2_000
#: Links a row of packed ones holds, and a task packs, about.
PACKED, PACKED_TASK = 250_000, 2_000_000


def _settle(links: DataFrame, nodes: DataFrame, total: int, resolution: float) -> tuple[DataFrame, float]:
    """((node, community) of a level, its modularity): rounds in which half of the nodes, by a hash, move to their best neighbouring community at once.

    ``links``: a, b, w in both directions, ``nodes``: node, degree, inner. Of two single nodes only
    the greater moves to the smaller, so that they do not change places. The partition of the
    greatest modularity is kept; rounds end when nobody wants to move or three of them bring nothing.
    """
    home = cut_lineage(nodes.withColumn("community", F.col("node")))
    # tables of nodes are sent to every executor while they are few; links never are
    slim = F.broadcast if home.count() <= BROADCAST_ROWS else lambda df: df
    best, most, idle = home, None, 0
    for turn in range(ROUNDS + 1):
        groups = home.groupBy("community").agg(F.sum("degree").alias("mass"), F.count(F.lit(1)).alias("size"))
        placed = home.join(slim(groups), "community").select(F.col("node").alias("a"), "community", "degree", "inner", "mass", "size")
        toward = links.join(slim(home.select(F.col("node").alias("b"), F.col("community").alias("goal"))), "b").groupBy("a", "goal").agg(F.sum("w").alias("into"))
        offers = toward.join(slim(placed), "a").join(slim(groups.select(F.col("community").alias("goal"), F.col("mass").alias("there"), F.col("size").alias("crowd"))), "goal")
        own = F.col("goal") == F.col("community")
        gain = F.col("into") - F.col("degree") * resolution * (F.col("there") - F.when(own, F.col("degree")).otherwise(0)) / F.lit(total)
        allowed = ~((F.col("size") == 1) & (F.col("crowd") == 1) & (F.col("goal") > F.col("community")))
        chosen = offers.withColumn("gain", gain).groupBy("a").agg(
            F.max(F.when(own, F.col("gain"))).alias("_stay"),
            F.max(F.when(own, F.col("into"))).alias("kept"),
            F.min(F.when(~own & allowed, F.struct((-F.col("gain")).alias("g"), F.col("goal").alias("c")))).alias("_go"),
        )
        stay = F.coalesce("_stay", -F.col("degree") * resolution * (F.col("mass") - F.col("degree")) / F.lit(total))
        wish = placed.join(chosen, "a", "left").withColumn("goal", F.when(-F.col("_go.g") > stay + 1e-9 * F.lit(total), F.col("_go.c")))
        wish = cut_lineage(wish.select(F.col("a").alias("node"), "degree", "inner", "community", F.col("inner") + F.coalesce("kept", F.lit(0)), "goal").toDF("node", "degree", "inner", "community", "within", "goal"))
        inside = wish.agg(F.sum("within"), F.count("goal"), F.min(F.when(F.col("goal").isNotNull(), F.col("node")))).first()
        squares = groups.agg(F.sum(F.pow(F.col("mass") / F.lit(total), 2))).first()[0]
        quality = inside[0] / total - resolution * squares
        if most is None or quality > most + LEAST_GAIN:
            best, most, idle = wish.select("node", "degree", "inner", "community"), quality, 0
        else:
            idle += 1
        if inside[1] == 0 or idle == 3 or turn == ROUNDS:
            break
        # the least node that wants to move always may, so that a round without moves is never one by chance
        turns = (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0) | (F.col("node") == F.lit(inside[2]))
        home = wish.select("node", "degree", "inner", F.when(turns, F.coalesce("goal", "community")).otherwise(F.col("community")).alias("community"))
    return best, most


def _packed(links: DataFrame, n: int) -> DataFrame:
    """(a, b, w) summed as rows of arrays in bytes: nodes with the numbers of their links, all links of a node in one row, and what nodes have with themselves (loop, within)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if not parts:
            return
        a, b, w = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        key, w = _summed(a.astype("i8") << 32 | b, w)
        a, b = (key >> 32).astype("i4"), (key & (2**32 - 1)).astype("i4")
        own = a == b
        rest = [x[own].astype(t) for x, t in ((a, "i4"), (w, "i8"))]
        a, b, w = a[~own], b[~own], w[~own]
        begin = 0
        while begin < len(a) or len(rest[0]):
            end = len(a) if begin + PACKED >= len(a) else int(np.searchsorted(a, a[begin + PACKED], "right"))
            node, size = np.unique(a[begin:end], return_counts=True)
            some = w[begin:end]
            columns = (node, size.astype("i4"), b[begin:end], some.astype("i4" if not len(some) or some.max() < 2**31 else "i8"), *rest)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in columns], names=["a", "size", "b", "w", "loop", "within"])
            begin, rest = end, [x[:0] for x in rest]

    return cut_lineage(links.repartition(n, "a").mapInArrow(pack, "a binary, size binary, b binary, w binary, loop binary, within binary"))


def _over(packed: DataFrame, fn, schema: str) -> DataFrame:
    """``packed`` through ``fn``, from arrays of a, b and w to arrays in the order of ``schema``; its binary columns hold them as bytes."""
    names = [c.split()[0] for c in schema.split(", ")]
    binary = "binary" in schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, size, b, w in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                w = np.frombuffer(w, "i8" if len(w) > len(b) else "i4").astype("i8")
                out = fn(np.repeat(np.frombuffer(a, "i4"), np.frombuffer(size, "i4")), np.frombuffer(b, "i4"), w)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) if binary else pa.array(x) for x in out], names=names)

    return packed.filter(F.length("b") > 0).select("a", "size", "b", "w").mapInArrow(run, schema)


def _summed(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their ``w``."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(w[order], first)


def _by_arrays(links: list[DataFrame], count: int, nodes: DataFrame, total: int, resolution: float) -> DataFrame:
    """What ``communities`` gives from its ``count`` ``links`` (taken out of their list, so that their files go once they are packed) and ``nodes``: the same rounds and levels, with the numbers of the nodes in arrays in the order of the nodes.

    A round reads the packed links once where they are and shuffles nothing; it brings back a wish a node.
    """
    spark = nodes.sparkSession
    turns = sum((F.when(F.pmod(F.xxhash64("node", F.lit(t)), F.lit(2)) == 0, 1 << t).otherwise(0) for t in range(ROUNDS + 1)), F.lit(0))
    table = nodes.select("node", "degree", turns.alias("turns")).toArrow().sort_by("node")
    ids, degree, turns = table["node"].combine_chunks(), table["degree"].to_numpy(), table["turns"].to_numpy()
    values = ids.to_numpy(zero_copy_only=False)
    n = len(values)
    known = spark.sparkContext.broadcast(values)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = lambda c: pa.array(np.searchsorted(known.value, c.to_numpy(zero_copy_only=False)).astype("i4"))
            yield pa.RecordBatch.from_arrays([place(batch.column(0)), place(batch.column(1)), batch.column(2)], names=["a", "b", "w"])

    tasks = lambda count: max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")) if count > PACKED else 1, count // PACKED_TASK + 1)
    packed = _packed(links.pop().select("a", "b", "w").mapInArrow(number, "a int, b int, w long"), tasks(count))
    release(spark)
    at, inner = np.arange(n), np.zeros(n, dtype="i8")
    member, best = np.arange(n), None
    for _ in range(LEVELS):
        home, quality = _rounds(packed, at, degree, inner, turns, total, resolution)
        if best is not None and quality <= best + LEAST_GAIN:
            break
        best = quality
        name = np.full(n, n)
        np.minimum.at(name, home[at], at)
        named = np.arange(n)
        named[at] = name[home[at]]
        member = named[member]
        sent = spark.sparkContext.broadcast(named)

        def merge(a, b, w, sent=sent):
            key, w = _summed(sent.value[a] * n + sent.value[b], w)
            return (key // n).astype("i4"), (key % n).astype("i4"), w

        count = (packed.agg(F.sum(F.length("b"))).first()[0] or 0) // 4
        packed = _packed(_over(packed, merge, "a int, b int, w long"), tasks(count))
        release(spark)
        degree, inner = (_total(named[at], x[at], n) for x in (degree, inner))
        for row in packed.filter(F.length("loop") > 0).select("loop", "within").toLocalIterator():
            inner[np.frombuffer(row["loop"], "i4")] += np.frombuffer(row["within"], "i8")
        before, at = len(at), np.unique(named[at])
        if len(at) == before:
            break
    # the arrays are as large as the nodes, so the result is made of them in parts
    kind = nodes.schema["node"].dataType
    step = 100_000
    parts = [spark.createDataFrame(pa.table({"node": ids[k : k + step], "community": ids.take(pa.array(member[k : k + step]))})) for k in range(0, n, step)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("node").cast(kind), F.col("community").cast(kind))


def _total(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers a group; exact, as all of them together are below 2 to the 53."""
    return np.bincount(group, values, n).astype("i8")


def _rounds(packed: DataFrame, at: np.ndarray, degree: np.ndarray, inner: np.ndarray, turns: np.ndarray, total: int, resolution: float) -> tuple[np.ndarray, float]:
    """(community of each node, modularity) of a level, as ``_settle``; ``at``: the nodes of the level."""
    spark, n = packed.sparkSession, len(degree)
    home = np.arange(n)
    best, most, idle = home, None, 0
    for turn in range(ROUNDS + 1):
        mass, size = _total(home[at], degree[at], n), np.bincount(home[at], minlength=n)
        sent = spark.sparkContext.broadcast((home, mass, size, degree))

        def wishes(a, b, w, sent=sent):
            home, mass, size, degree = sent.value
            key, into = _summed(a.astype("i8") * n + home[b], w)
            node, goal = key // n, key % n
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            own = goal == home[node]
            gain = into - degree[node] * resolution * (mass[goal] - np.where(own, degree[node], 0)) / total
            kept = np.add.reduceat(np.where(own, into, 0), first)
            who = node[first]
            stay = np.where(np.logical_or.reduceat(own, first), np.maximum.reduceat(np.where(own, gain, -np.inf), first), -degree[who] * resolution * (mass[home[who]] - degree[who]) / total)
            free = ~own & ~((size[home[node]] == 1) & (size[goal] == 1) & (goal > home[node]))
            go = np.maximum.reduceat(np.where(free, gain, -np.inf), first)
            # of several goals the least: goals are in order within a node
            count = np.diff(np.r_[first, len(node)])
            chosen = np.minimum.reduceat(np.where(free & (gain == np.repeat(go, count)), goal, n), first)
            return who.astype("i4"), kept, np.where(go > stay + 1e-9 * total, chosen, -1).astype("i4")

        wish, within = np.full(n, -1), inner.copy()
        for row in _over(packed, wishes, "who binary, kept binary, goal binary").toArrow().to_pylist():
            who = np.frombuffer(row["who"], "i4")
            within[who] += np.frombuffer(row["kept"], "i8")
            wish[who] = np.frombuffer(row["goal"], "i4")
        sent.destroy()
        quality = int(within[at].sum()) / total - resolution * float(((mass / total) ** 2).sum())
        if most is None or quality > most + LEAST_GAIN:
            best, most, idle = home, quality, 0
        else:
            idle += 1
        wanting = np.flatnonzero(wish >= 0)
        if not len(wanting) or idle == 3 or turn == ROUNDS:
            break
        moves = wanting[((turns[wanting] >> turn) & 1 == 1) | (wanting == wanting[0])]
        home = home.copy()
        home[moves] = wish[moves]
    return best, most


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, community) of weighted pairs (a, b, weight) by the method of Louvain, the same whatever the order of rows.

    Every step is a join or an aggregate of the edge table, so one component may be as large as the
    data: in rounds, nodes move to the neighbouring community that raises modularity most (ties to
    the least community), then communities become the nodes of the next level, until no level
    raises it. A community is named by its least node. Pairs without a positive weight, with a NULL
    end or with equal ends are left out. Weights count in millionths.
    """
    pairs = edges.filter("a <> b AND weight > 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.round(F.sum("weight") * UNIT).cast("long").alias("w")).filter("w > 0")
    ends = F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("w")))
    # on disk each pair is once, and the shuffles that made it are not
    links = cut_lineage(pairs).select(F.inline(ends))
    release(edges.sparkSession)
    nodes = cut_lineage(links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree"), F.lit(0).cast("long").alias("inner")))
    total = nodes.agg(F.sum("degree")).first()[0]
    members = nodes.select("node", F.col("node").alias("community"))
    if not total:
        return members
    if nodes.count() <= ARRAY_NODES and total < 2**53:
        count, held = links.count(), [links]
        del links, pairs
        return _by_arrays(held, count, nodes, total, resolution)
    best = None
    for _ in range(LEVELS):
        home, quality = _settle(links, nodes, total, resolution)
        if best is not None and quality <= best + LEAST_GAIN:
            break
        best = quality
        names = home.groupBy("community").agg(F.min("node").alias("name"))
        named = cut_lineage(home.join(names, "community").select("node", F.col("name").alias("community"), "degree", "inner"))
        members = cut_lineage(members.withColumnRenamed("community", "_at").join(named.select(F.col("node").alias("_at"), "community"), "_at").select("node", "community"))
        side = lambda c: named.select(F.col("node").alias(c), F.col("community").alias(f"_{c}"))
        merged = cut_lineage(links.join(side("a"), "a").join(side("b"), "b").groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("w").alias("w")))
        loops = merged.filter("a = b").select(F.col("a").alias("node"), "w")
        grouped = named.groupBy(F.col("community").alias("node")).agg(F.sum("degree").alias("degree"), F.sum("inner").alias("_inner"))
        before = nodes.count()
        nodes = cut_lineage(grouped.join(loops, "node", "left").select("node", "degree", (F.col("_inner") + F.coalesce("w", F.lit(0))).alias("inner")))
        links = merged.filter("a <> b")
        if nodes.count() == before:
            break
    return members


def split_large(members: DataFrame, edges: DataFrame, most: int, strong: Column) -> DataFrame:
    """(node, community): communities of more than ``most`` nodes become the components of their ``strong`` edges, single nodes themselves."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    large = members.join(sizes.filter(F.col("n") > most).select("community"), "community", "left_semi")
    side = lambda c: large.select(F.col("node").alias(c), F.col("community").alias(f"_{c}"))
    inner = edges.filter(strong).select("a", "b").join(side("a"), "a").join(side("b"), "b").filter("_a = _b").select("a", "b")
    pieces = connected_components(inner, "a", "b").withColumnRenamed("component", "piece")
    done = large.join(pieces, "node", "left").select("node", F.coalesce("piece", "node").alias("community"))
    return members.join(large.select("node"), "node", "left_anti").select("node", "community").unionByName(done)


def confidence(members: DataFrame, edges: DataFrame, strong: Column) -> DataFrame:
    """(community, n_nodes, n_edges, strong_share, confidence): 0.35, up to 0.45 by the share of strong inner edges, 0.20 if these connect it, less 0.10 above 8 nodes."""
    side = lambda c: members.select(F.col("node").alias(c), F.col("community").alias(f"_{c}"))
    inner = cut_lineage(edges.withColumn("_strong", strong).join(side("a"), "a").join(side("b"), "b").filter("_a = _b").withColumnRenamed("_a", "community"))
    counted = inner.groupBy("community").agg(F.count(F.lit(1)).alias("n_edges"), F.avg(F.col("_strong").cast("double")).alias("strong_share"))
    pieces = connected_components(inner.filter("_strong"), "a", "b")
    tied = members.join(pieces, "node").groupBy("community", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("community").agg(F.max("k").alias("k"))
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("n_nodes"))
    out = sizes.join(counted, "community", "left").join(tied, "community", "left").fillna({"n_edges": 0, "strong_share": 0.0, "k": 0})
    value = 0.35 + 0.45 * F.col("strong_share") + F.when(F.col("k") == F.col("n_nodes"), 0.20).otherwise(0.0) - F.when(F.col("n_nodes") > 8, 0.10).otherwise(0.0)
    return out.select("community", "n_nodes", "n_edges", F.round("strong_share", 6).alias("strong_share"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4).alias("confidence"))


def first_steps(sources: DataFrame, imports: DataFrame, touches: DataFrame) -> int:
    """How many rows the first level of :func:`propagate` has at most, from counts a path."""
    starts = sources.groupBy("path").agg(F.count(F.lit(1)).alias("s"))
    acts = touches.groupBy(F.col("path").alias("next")).agg(F.count(F.lit(1)).alias("t"))
    steps = imports.select(F.col("dst").alias("path"), F.col("src").alias("next"))
    return steps.join(starts, "path").join(acts, "next").agg(F.sum(F.col("s") * F.col("t"))).first()[0] or 0


def propagate(sources: DataFrame, imports: DataFrame, touches: DataFrame, depth: int = 3, fade: float = 0.5, most: int = 150) -> DataFrame:
    """(group, event, depth, path, at, weight): what takes up a group's paths later, each event once a group.

    ``sources``: group, path, weight, at. ``imports``: src depends on dst. ``touches``: path, event,
    at. From a path the walk goes to those that import it and to the events that touch them after
    it; the first way to an event in order of (depth, time, event, path) counts, with ``fade`` of
    the weight a step; of each level ``most`` paths a group go on, the weightiest. A level is a
    round of joins.
    """
    front = sources.select("group", "path", F.col("weight").cast("double").alias("weight"), F.col("at").cast("timestamp").alias("at"))
    steps = imports.select(F.col("dst").alias("path"), F.col("src").alias("next")).dropna().distinct()
    acts = touches.select(F.col("path").alias("next"), "event", F.col("at").cast("timestamp").alias("then")).dropna().distinct()
    seen = None
    for level in range(1, depth + 1):
        hits = front.join(steps, "path").join(acts, "next").filter(F.col("then") > F.col("at"))
        hits = hits.select("group", "event", F.lit(level).alias("depth"), F.col("next").alias("path"), F.col("then").alias("at"), (F.col("weight") * fade).alias("weight"))
        w = Window.partitionBy("group", "event").orderBy("at", "path", F.col("weight").desc())
        first = hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
        new = cut_lineage(first if seen is None else first.join(seen.select("group", "event"), ["group", "event"], "left_anti"))
        seen = new if seen is None else seen.unionByName(new)
        release(sources.sparkSession)
        ahead = new.groupBy("group", "path").agg(F.max("weight").alias("weight"), F.min("at").alias("at"))
        rank = Window.partitionBy("group").orderBy(F.col("weight").desc(), "path")
        front = ahead.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= most).drop("_r")
    return seen


def _packed_touches(touches: DataFrame) -> DataFrame:
    """(path, event, at) as rows of arrays in bytes, all distinct touches of a path in one row; events of 4 bytes where that is enough, times as places in the row's own times."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if not parts:
            return
        path, event, at = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((event, at, path))
        path, event, at = path[order], event[order], at[order]
        first = np.r_[True, (path[1:] != path[:-1]) | (event[1:] != event[:-1]) | (at[1:] != at[:-1])]
        path, event, at = path[first], event[first], at[first]
        paths, counts = np.unique(path, return_counts=True)
        times, codes = np.unique(at, return_inverse=True)
        narrow = -(2**31) <= event.min() and event.max() < 2**31
        columns = (paths, counts.astype("i8"), event.astype("i4" if narrow else "i8"), times, codes.astype("i4" if len(times) > 2**16 else "u2"))
        yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()]) for x in columns), pa.array([len(event)])], names=["paths", "counts", "events", "times", "codes", "n"])

    rows = touches.select(F.col("path").cast("long"), F.col("event").cast("long"), F.unix_micros(F.col("at").cast("timestamp")).alias("at")).dropna()
    return cut_lineage(rows.repartition("path").mapInArrow(pack, "paths binary, counts binary, events binary, times binary, codes binary, n long"))


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): the places from ``start`` on, ``count`` of them, of each row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) + np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count)


def _walk(known: dict[str, np.ndarray], group: np.ndarray, path: np.ndarray, weight: np.ndarray, at: np.ndarray, depth: int, fade: float, most: int) -> list[np.ndarray]:
    """[group, depth, n_events, weight] of the sources of some whole groups, in order of their groups, as :func:`propagate` finds them."""
    groups, g = np.unique(group, return_inverse=True)
    events, codes, n = known["events"], known["codes"], len(known["paths"])
    w, late, out = weight, np.searchsorted(known["times"], at, "right") - 1, []
    begin = np.searchsorted(known["origins"], path)
    found = begin < len(known["origins"])
    found[found] = known["origins"][begin[found]] == path[found]
    g, w, late, begin = g[found], w[found], late[found], begin[found]
    seen = np.empty(0, dtype="i8")
    for level in range(1, depth + 1):
        step, place = _spread(known["step_start"][begin], known["step_count"][begin])
        ahead = known["step_next"][place].astype("i8")
        size = known["count"][ahead]
        if size.sum() > WALK_HITS and len(groups) > 1:
            half = group < groups[len(groups) // 2]
            two = [_walk(known, group[x], path[x], weight[x], at[x], depth, fade, most) for x in (half, ~half)]
            return [np.concatenate(c) for c in zip(*two, strict=True)]
        hit, place = _spread(known["start"][ahead], size)
        then = codes[place].astype("i8")
        later = then > late[step][hit]
        hit, place, then = hit[later], place[later], then[later]
        who, to, gain = g[step][hit], ahead[hit], w[step][hit] * fade
        event = events[place].astype("i8") - known["least"]
        key = who * known["span"] + event
        order = np.argsort(key, kind="stable")
        key = key[order]
        change = np.r_[True, key[1:] != key[:-1]][: len(key)]
        single = change & np.r_[change[1:], True][: len(key)]
        # of several ways to an event the first by time, path and weight
        several = order[~single]
        several = several[np.lexsort((-gain[several], then[several] * n + to[several], who[several] * known["span"] + event[several]))]
        first = np.r_[order[single], several[change[~single]]] if len(several) else order
        key = who[first] * known["span"] + event[first]
        place = np.searchsorted(seen, key)
        old = place < len(seen)
        old[old] = seen[place[old]] == key[old]
        first, key = first[~old], key[~old]
        if not len(first):
            break
        seen = np.sort(np.concatenate([seen, key]), kind="stable")
        who, to, gain, then = who[first], to[first], gain[first], then[first]
        number = np.bincount(who, minlength=len(groups))
        some = np.flatnonzero(number)
        out.append([groups[some], np.full(len(some), level, dtype="i4"), number[some], np.bincount(who, gain, len(groups))[some]])
        front = who * n + to
        order = np.argsort(front, kind="stable")
        front = front[order]
        cut = np.flatnonzero(np.r_[True, front[1:] != front[:-1]])
        g, to, w, late = front[cut] // n, front[cut] % n, np.maximum.reduceat(gain[order], cut), np.minimum.reduceat(then[order], cut)
        order = np.lexsort((to, -w, g))
        rank = np.arange(len(order)) - np.searchsorted(g, g)  # order is by group first, as g is
        order = order[rank < most]
        begin = known["origin_of"][to[order]]
        order, begin = order[begin >= 0], begin[begin >= 0]
        g, w, late = g[order], w[order], late[order]
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, t) for t in ("i8", "i4", "i8", "f8")]


def reach_by_depth(sources: DataFrame, imports: DataFrame, touches: DataFrame, depth: int = 3, fade: float = 0.5, most: int = 150) -> DataFrame | None:
    """(group, depth, n_events, weight): the events of :func:`propagate` counted and their weights summed, for groups, paths and events that are whole numbers.

    All touches of all paths are sent to every executor, packed as arrays, and each group is walked
    within a task; nothing but the sources is shuffled after that. None, if the touches are more
    than ``ARRAY_BYTES``: then the walk is for joins. Sources without a group, path, weight or time
    lead nowhere.
    """
    spark = sources.sparkSession
    packed = _packed_touches(touches)
    release(spark)
    sizes = packed.agg(F.sum("n"), F.max(F.length("events") / F.col("n")), F.sum(F.length("times"))).first()
    kind = sources.schema["group"].dataType
    if not sizes[0]:
        return sources.select("group", F.lit(1).alias("depth"), F.lit(0).cast("long").alias("n_events"), F.lit(0.0).alias("weight")).limit(0)
    if sizes[0] * sizes[1] > ARRAY_BYTES or sizes[2] > ARRAY_BYTES:
        return None
    times = np.unique(np.concatenate([np.unique(np.frombuffer(r.times, "i8")) for r in packed.select("times").toLocalIterator()]))
    wide = len(times) > 2**16
    events, codes = np.empty(sizes[0], "i8" if sizes[1] > 4 else "i4"), np.empty(sizes[0], "i4" if wide else "u2")
    if events.nbytes + codes.nbytes > ARRAY_BYTES:
        return None
    paths, counts, done = [], [], 0
    for r in packed.toLocalIterator():
        own = np.frombuffer(r.times, "i8")
        events[done : done + r.n] = np.frombuffer(r.events, "i8" if len(r.events) > 4 * r.n else "i4")
        codes[done : done + r.n] = np.searchsorted(times, own)[np.frombuffer(r.codes, "i4" if len(own) > 2**16 else "u2")]
        paths.append(np.frombuffer(r.paths, "i8"))
        counts.append(np.frombuffer(r.counts, "i8"))
        done += r.n
    paths, counts = np.concatenate(paths), np.concatenate(counts)
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    order = np.argsort(paths)
    paths, counts, starts = paths[order], counts[order], starts[order]
    # steps to paths that nothing touches end there
    steps = imports.select(F.col("dst").cast("long").alias("origin"), F.col("src").cast("long").alias("next")).dropna().distinct().toArrow()
    origin, ahead = (steps[c].to_numpy() for c in ("origin", "next"))
    place = np.minimum(np.searchsorted(paths, ahead), len(paths) - 1)
    origin, place = origin[paths[place] == ahead], place[paths[place] == ahead]
    order = np.argsort(origin, kind="stable")
    origins, step_count = np.unique(origin, return_counts=True)
    origin_of = np.full(len(paths), -1)
    shared = np.searchsorted(origins, paths)
    inside = shared < len(origins)
    inside[inside] = origins[shared[inside]] == paths[inside]
    origin_of[inside] = shared[inside]
    least = int(events.min())
    known = {
        "paths": paths, "start": starts, "count": counts, "events": events, "codes": codes, "times": times, "origins": origins, "step_start": np.r_[0, np.cumsum(step_count)][:-1], "step_count": step_count, "step_next": place[order].astype("i4"), "origin_of": origin_of, "least": least, "span": int(events.max()) - least + 1,
    }
    if known["span"] * WALK_SOURCES * 2 >= 2**63 or len(paths) * max(len(times), WALK_SOURCES * 2) >= 2**63:
        return None
    sent = spark.sparkContext.broadcast(known)
    del known, events, codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        rest = [np.empty(0, t) for t in ("i8", "i8", "f8", "i8")]
        for batch in batches:
            rest = [np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(rest, batch.columns, strict=True)]
            # the last group may go on in the next batch
            while len(rest[0]) > WALK_SOURCES and rest[0][0] != rest[0][-1]:
                end = np.searchsorted(rest[0], rest[0][min(WALK_SOURCES, np.searchsorted(rest[0], rest[0][-1]) - 1)], "right")
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _walk(table, *(x[:end] for x in rest), depth, fade, most)], names=names)
                rest = [x[end:] for x in rest]
        if len(rest[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _walk(table, *rest, depth, fade, most)], names=names)

    names = ["group", "depth", "n_events", "weight"]
    rows = sources.select(F.col("group").cast("long"), F.col("path").cast("long"), F.col("weight").cast("double"), F.unix_micros(F.col("at").cast("timestamp")).alias("at")).dropna()
    out = rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, "group long, depth int, n_events long, weight double")
    return out.withColumn("group", F.col("group").cast(kind))
