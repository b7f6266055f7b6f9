"""Ordered conversations from message rows, by a topological sort of each reply graph."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.operators.skew import ranked, skew_left_join
from strataloom.session import cut_lineage

#: Threads of up to so many rows are sorted within one task; longer ones by joins.
IN_TASK = 50_000

#: A text of nothing but white space and characters that show nothing (zero-width, soft hyphen, byte order mark, fillers).
BLANK = r"^[\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{2800}\x{3164}\x{FE00}-\x{FE0F}]*$"

#: Why a conversation is dropped.
DEFECTS = ["positions", "no_text", "one_voice", "opener_replies", "bad_reply", "cycle"]


def has_text(body: Column) -> Column:
    """Whether a text has a visible character; NULL has none."""
    return F.coalesce(~body.rlike(BLANK), F.lit(False))


def latest_messages(rows: DataFrame) -> DataFrame:
    """One row a message: that of the greatest ``fetched_at``, ties by the greatest values.

    Rows without message_id are one message if they agree in everything else.
    """
    others = [c for c in rows.columns if c not in ("message_id", "fetched_at")]
    no_id = F.when(F.col("message_id").isNull(), F.xxhash64(*others)).alias("_no_id")
    picked = rows.groupBy("message_id", no_id).agg(F.max(F.struct("fetched_at", *others)).alias("_row"))
    return picked.select("message_id", *[F.col(f"_row.{c}").alias(c) for c in others])


def kahn(ids: list, replies: list, micros: list) -> tuple[list, list, list]:
    """(level, ready_at, in_cycle) of each message of a thread by Kahn's algorithm.

    A message is ready once its parent is placed: its level is one more, and it cannot have been
    said before it, so ready_at is the later of its own time and its parent's ready_at. Replies to
    messages outside the list start a tree. What is never ready lies on a cycle or hangs on one.
    """
    at = {k: i for i, k in enumerate(ids) if k is not None}
    n = len(ids)
    children: list[list[int]] = [[] for _ in range(n)]
    queue: deque[int] = deque()
    level, ready_at = [None] * n, list(micros)
    for i, parent in enumerate(replies):
        p = at.get(parent) if parent is not None else None
        if p is None:
            level[i] = 0
            queue.append(i)
        else:
            children[p].append(i)
    while queue:
        p = queue.popleft()
        for i in children[p]:
            level[i] = level[p] + 1
            if ready_at[p] is not None and (ready_at[i] is None or ready_at[i] < ready_at[p]):
                ready_at[i] = ready_at[p]
            queue.append(i)
    return level, ready_at, [x is None for x in level]


def _none_last(x: object) -> tuple:
    return (x is None, 0 if x is None else x)


def judge_thread(ids: list, replies: list, micros: list, positions: list, authors: list, texts: list) -> tuple[list, list[str]]:
    """(turn of each message, defects) of one thread; turns follow (ready_at, level, time, position, id), None on cycles."""
    n = len(ids)
    level, ready_at, cyclic = kahn(ids, replies, micros)
    placed = sorted((i for i in range(n) if not cyclic[i]), key=lambda i: (_none_last(ready_at[i]), level[i], _none_last(micros[i]), _none_last(positions[i]), _none_last(ids[i]), _none_last(replies[i]), _none_last(authors[i])))
    turns: list = [None] * n
    for turn, i in enumerate(placed):
        turns[i] = turn
    place = {k: p for k, p in zip(ids, positions, strict=True) if k is not None}
    opener = bad = False
    for p, r in zip(positions, replies, strict=True):
        if p == 0:
            opener |= r is not None
        elif p is not None:
            q = place.get(r) if r is not None else None
            bad |= q is None or q >= p
    found = [sorted(-1 if p is None else p for p in positions) != list(range(n)), not any(texts), len({a for a in authors if a is not None}) < 2, opener, bad, any(cyclic)]
    return turns, [d for d, x in zip(DEFECTS, found, strict=True) if x]


def _within_tasks(messages: DataFrame) -> DataFrame:
    """``messages`` with turn and defects, thread after thread within a task; a task holds one thread at a time."""
    ordered = messages.repartition("thread_id").sortWithinPartitions("thread_id")
    schema = T.StructType([*messages.schema.fields, T.StructField("turn", T.LongType()), T.StructField("defects", T.ArrayType(T.StringType()))])
    needed = ["message_id", "reply_to", "micros", "position", "author", "has_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)

        def judged(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            threads = table["thread_id"].to_pylist()
            columns = [table[c].to_pylist() for c in needed]
            turns: list = []
            defects: list = []
            start = 0
            for end in range(1, len(threads) + 1):
                if end == len(threads) or threads[end] != threads[start]:
                    t, d = judge_thread(*[c[start:end] for c in columns])
                    turns += t
                    defects += [d] * (end - start)
                    start = end
            arrays = [*table.columns, pa.chunked_array([pa.array(turns, target.field("turn").type)]), pa.chunked_array([pa.array(defects, target.field("defects").type)])]
            yield from pa.Table.from_arrays([a.cast(f.type) for a, f in zip(arrays, target, strict=True)], schema=target).to_batches(max_chunksize=20_000)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            threads = batch.column("thread_id")
            last = threads[-1].as_py()
            cut = batch.num_rows - 1
            while cut >= 0 and threads[cut].as_py() == last:
                cut -= 1
            cut += 1
            if cut:
                yield from judged(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                same = not held or held[0].column("thread_id")[0].as_py() == last
                if not same:
                    yield from judged(pa.Table.from_batches(held))
                    held = []
                held.append(batch)
        if held:
            yield from judged(pa.Table.from_batches(held))

    return ordered.mapInArrow(run, schema)


def _by_joins(messages: DataFrame, rounds: int) -> DataFrame:
    """The same for threads of any length, with Kahn's levels found by pointer doubling.

    A message points to its parent; in each round it takes over the pointer of what it points to, so
    chains halve and ``rounds`` = log2 of the longest possible chain suffice. Messages that still
    point somewhere then are on cycles or hang on them.
    """
    at = ["thread_id", "message_id"]
    identified = messages.filter("message_id IS NOT NULL")
    parents = identified.select("thread_id", F.col("message_id").alias("reply_to"), F.col("position").alias("_parent_position"), F.lit(True).alias("_has_parent"))
    linked = skew_left_join(messages, parents, ["thread_id", "reply_to"])
    linked = linked.withColumn("_up", F.when(F.col("_has_parent"), F.col("reply_to"))).withColumn("_level", F.when(F.col("_up").isNull(), 0).otherwise(1).cast("long")).withColumn("_ready", F.col("micros"))
    slim = cut_lineage(linked)
    walk = slim.filter("message_id IS NOT NULL").select(*at, "_up", "_level", "_ready")
    for _ in range(rounds):
        open_ = walk.filter("_up IS NOT NULL")
        if open_.isEmpty():
            break
        ahead = walk.select("thread_id", F.col("message_id").alias("_up"), F.col("_up").alias("_next"), F.col("_level").alias("_add"), F.col("_ready").alias("_later"))
        jumped = skew_left_join(open_, ahead, ["thread_id", "_up"]).select(*at, F.col("_next").alias("_up"), (F.col("_level") + F.col("_add")).alias("_level"), F.greatest("_ready", "_later").alias("_ready"))
        walk = cut_lineage(walk.filter("_up IS NULL").unionByName(jumped))
    # a message without id is nobody's parent, so its pointer needs no more than its parent's answer
    answers = walk.select("thread_id", F.col("message_id").alias("_id"), F.col("_up").alias("_end"), F.col("_level").alias("_l"), F.col("_ready").alias("_r"))
    named = slim.filter("message_id IS NOT NULL").drop("_up", "_level", "_ready").join(answers.withColumnRenamed("_id", "message_id"), at, "left")
    nameless = skew_left_join(slim.filter("message_id IS NULL").drop("_level", "_ready"), answers.withColumnRenamed("_id", "_up"), ["thread_id", "_up"])
    nameless = nameless.withColumn("_l", F.coalesce(F.col("_l") + 1, F.lit(0))).withColumn("_r", F.greatest("micros", "_r")).drop("_up")
    done = named.unionByName(nameless).withColumn("_cyclic", F.col("_end").isNotNull())
    last = [F.col(c).asc_nulls_last() for c in ("_r", "_l", "micros", "position", "message_id", "reply_to", "author")]
    numbered = ranked(done, "thread_id", [F.col("_cyclic").asc(), *last], "turn").withColumn("turn", F.when(~F.col("_cyclic"), F.col("turn")))
    seats = messages.groupBy("thread_id", "position").agg(F.count(F.lit(1)).alias("n")).groupBy("thread_id").agg(
        ((F.max("n") > 1) | (F.coalesce(F.min("position"), F.lit(-1)) != 0) | (F.max("position") != F.sum("n") - 1) | F.max(F.col("position").isNull())).alias("positions")
    )
    parent = F.coalesce(F.col("_parent_position") < F.col("position"), F.lit(False))
    facts = done.groupBy("thread_id").agg(
        (~F.max("has_text")).alias("no_text"),
        F.coalesce(F.min("author") == F.max("author"), F.lit(True)).alias("one_voice"),
        F.max(F.coalesce((F.col("position") == 0) & F.col("reply_to").isNotNull(), F.lit(False))).alias("opener_replies"),
        F.max(F.coalesce((F.col("position") != 0) & ~parent, F.lit(False))).alias("bad_reply"),
        F.max("_cyclic").alias("cycle"),
    )
    named_defects = F.array_compact(F.array(*[F.when(F.coalesce(F.col(d), F.lit(True)), F.lit(d)) for d in DEFECTS]))
    verdicts = facts.join(seats, "thread_id").select("thread_id", named_defects.alias("defects"))
    return numbered.join(F.broadcast(verdicts), "thread_id").select(*messages.columns, "turn", "defects")


def reassemble(rows: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """Messages of all threads in conversation order: the columns of ``rows`` and (turn, defects).

    ``rows``: thread_id, message_id, reply_to, position (BIGINT), author, body (or has_text, if
    only the verdicts are asked), created_at, fetched_at; other columns go along, but for earlier
    turn, defects and micros. Of repeated rows of a message the last fetched holds; rows
    without thread_id belong to no conversation and are left out. defects is empty for a
    conversation to keep, else some of ``DEFECTS``: positions are not exactly 0 to n-1; no text
    shows anything; fewer than two authors (without regard to case; NULL is none); the opener is a
    reply; a later message replies to nothing, or not to an earlier position of its thread; replies
    form a cycle. Empty input gives no rows. turn is NULL for messages on a cycle.
    """
    shows = F.col("has_text") if "has_text" in rows.columns else has_text(F.col("body"))
    typed = rows.drop("turn", "defects", "micros").filter("thread_id IS NOT NULL").withColumns(
        {"position": F.col("position").cast("long"), "micros": F.unix_micros("created_at"), "has_text": shows, "author": F.lower("author")}
    )
    sizes = typed.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))
    giants = sizes.filter(F.col("n") > in_task)
    largest = giants.agg(F.max("n")).first()[0]
    if largest is None:
        return _within_tasks(latest_messages(typed)).drop("micros", "has_text")
    giants = cut_lineage(giants.select("thread_id"))
    small = latest_messages(typed.join(giants, "thread_id", "left_anti"))
    large = cut_lineage(latest_messages(typed.join(giants, "thread_id", "left_semi")))
    rounds = math.ceil(math.log2(largest + 1)) + 1
    return _within_tasks(small).unionByName(_by_joins(large, rounds)).drop("micros", "has_text")


def verdicts(judged: DataFrame) -> DataFrame:
    """(thread_id, n_messages, defects) of ``reassemble``."""
    return judged.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max("defects").alias("defects"))


def with_roles(judged: DataFrame, owners: DataFrame, subject: str) -> DataFrame:
    """``judged`` with role: ``bot``, ``author`` (who opened the ``subject``), ``reviewer``, or NULL without a login.

    ``owners``: one row a ``subject`` with owner, its author's login. Logins compare without case.
    """
    joined = skew_left_join(judged, owners.select(subject, F.lower("owner").alias("_owner")), [subject])
    bot = F.coalesce(F.col("author_typename") == "Bot", F.lit(False)) | F.col("author").endswith("[bot]")
    role = F.when(F.col("author").isNull(), F.lit(None).cast("string")).when(bot, "bot").when(F.col("author") == F.col("_owner"), "author").otherwise("reviewer")
    return joined.withColumn("role", role).drop("_owner")
