"""Differences between two copies of a table, by presence bitmaps over shared key ordinals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions import bitmaps

#: Keys of one block; fits the uint16 ordinals of the bitmaps and bounds what a task holds.
BLOCK = 32_768


def whole_number(text: Column) -> Column:
    """A count written as text (``1,653``, ``148.0``, `` -14 ``, ``1e3``) as BIGINT; NULL if it is no whole number."""
    t = F.trim(F.regexp_replace(text.cast("string"), r"[\s ]+", " "))
    grouped = t.rlike(r"^[+-]?\d{1,3}([ ,_'.]\d{3})+$") & ~t.rlike(r"^[+-]?\d{1,3}\.\d{3}$")
    grouped_fraction = t.rlike(r"^[+-]?\d{1,3}([ ,_']\d{3})+\.0*$")
    plain = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    number = F.when(grouped, F.regexp_replace(t, r"[ ,_'.]", "")).when(grouped_fraction, F.regexp_replace(t, r"[ ,_']", "")).when(plain, t)
    exact = number.try_cast("decimal(38,9)")
    return F.when(exact == F.floor(exact), exact.try_cast("bigint"))


def presence_blocks(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Blocks of shared ordinals: (keys, left_bitmap, right_bitmap, left_<f>..., right_<f>...).

    Both copies are united and reduced to one row a key in one shuffle with map-side combination (so
    a key that is repeated a third of all rows long costs one partial row a task). That shuffle's
    partitions are ordered by key and numbered; ``BLOCK`` keys form a block. A block holds each
    copy's values without gaps, in ordinal order.
    """
    values = lambda df: F.struct(*[df[f].cast("string").alias(f) for f in fields])
    row = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    none = F.lit(None).cast(row)
    both = left.select(left[key].alias("k"), values(left).alias("l"), none.alias("r")).unionByName(right.select(right[key].alias("k"), none.alias("l"), values(right).alias("r")))
    keyed = both.filter(F.col("k").isNotNull()).groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    spread = keyed.sortWithinPartitions("k")
    kind = keyed.schema["k"].dataType
    column = T.ArrayType(T.StringType())
    schema = T.StructType(
        [T.StructField("keys", T.ArrayType(kind)), T.StructField("left_bitmap", T.BinaryType()), T.StructField("right_bitmap", T.BinaryType())]
        + [T.StructField(f"left_{f}", column) for f in fields]
        + [T.StructField(f"right_{f}", column) for f in fields]
    )
    names = list(fields)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)

        def block(table: pa.Table) -> pa.RecordBatch:
            l, r = table["l"].combine_chunks(), table["r"].combine_chunks()
            has_l, has_r = l.is_valid(), r.is_valid()
            one = lambda a, t: pa.array([a.to_pylist()], t)
            arrays = [one(table["k"].combine_chunks(), target.field("keys").type)]
            arrays += [pa.array([bitmaps.pack(np.asarray(h))], target.field("left_bitmap").type) for h in (has_l, has_r)]
            for side, has in ((l, has_l), (r, has_r)):
                arrays += [one(pc.struct_field(side, f).filter(has), target.field(3).type) for f in names]
            return pa.RecordBatch.from_arrays(arrays, schema=target)

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, BLOCK - rows)
                held.append(take)
                rows += take.num_rows
                batch = batch.slice(take.num_rows)
                if rows == BLOCK:
                    yield block(pa.Table.from_batches(held))
                    held, rows = [], 0
        if held:
            yield block(pa.Table.from_batches(held))

    return spread.select("k", "l", "r").mapInArrow(build, schema)


def compare_copies(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows (key, field): ``row_missing_left`` or ``row_missing_right`` for a key of one copy only, else each differing field.

    ``key`` and ``fields`` are columns of both; values compare as text, NULL equals NULL and differs
    from everything else. Rows that share a key must agree or be resolved before; if they don't, the
    greatest row by the fields' order holds. A row without key names no record and is in no result.
    Empty copies give every key of the other as missing; other columns are ignored.
    """
    names = list(fields)
    blocks = presence_blocks(left, right, key, names)
    kind = blocks.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField(key, kind), T.StructField("field", T.StringType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column("keys")[i].values
                n = len(keys)
                a, b = batch.column("left_bitmap")[i].as_py(), batch.column("right_bitmap")[i].as_py()
                found = [("row_missing_right", bitmaps.and_not(a, b, n)), ("row_missing_left", bitmaps.and_not(b, a, n))]
                shared = bitmaps.both(a, b, n)
                at_a, at_b = bitmaps.ranks(a, shared), bitmaps.ranks(b, shared)
                for f in names:
                    x, y = batch.column(f"left_{f}")[i].values.take(pa.array(at_a)), batch.column(f"right_{f}")[i].values.take(pa.array(at_b))
                    equal = pc.fill_null(pc.equal(x, y), False)
                    same = pc.or_(equal, pc.and_(x.is_null(), y.is_null()))
                    found.append((f, shared[~np.asarray(same, dtype=bool)]))
                for f, ordinals in found:
                    if len(ordinals):
                        hit = keys.take(pa.array(ordinals))
                        yield pa.RecordBatch.from_arrays([hit.cast(target.field(0).type), pa.array([f] * len(hit), target.field(1).type)], schema=target)

    return blocks.mapInArrow(compare, schema)


def latest(df: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """One row a key, that of the greatest ``order`` (NULL is least; ties go to the greatest values)."""
    picked = F.max(F.struct(F.col(order), *[F.col(f) for f in fields])).alias("_row")
    return df.groupBy(key).agg(picked).select(key, *[F.col(f"_row.{f}").alias(f) for f in fields])
