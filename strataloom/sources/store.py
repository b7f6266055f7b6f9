"""Sinks and sources of evidence: tables with their content hash, shards of JSON lines, packages, git output."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.operators.quality import content_hash


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in whatever file system ``path`` names, replaced as a whole."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    # not by a reader, which leaves out files whose name begins with an underscore
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_table(df: DataFrame, path: str, sort_keys: Sequence[str] = (), exclude: Sequence[str] = (), partitions: int | None = None) -> dict:
    """Writes ``df`` as Parquet, its rows sorted within range partitions of ``sort_keys``, and beside it ``_meta.json`` with schema, row count and content hash (without ``exclude``)."""
    ordered = df.repartitionByRange(*([partitions] if partitions else []), *sort_keys).sortWithinPartitions(*sort_keys) if sort_keys else df
    ordered.write.mode("overwrite").option("compression", "zstd").parquet(path)
    spark = df.sparkSession
    found = content_hash(spark.read.parquet(path), exclude).first()
    meta = {"rows": found.n_rows, "xor_hash": found.xor_hash, "sum_hash": int(found.sum_hash), "exclude": list(exclude), "columns": {f.name: f.dataType.simpleString() for f in df.schema}}
    _write_text(spark, f"{path}/_meta.json", json.dumps(meta, sort_keys=True))
    return meta


def verify_table(spark: SparkSession, path: str) -> dict:
    """What differs between a table and its ``_meta.json``: empty if it is as it was written."""
    meta = json.loads(_read_text(spark, f"{path}/_meta.json"))
    df = spark.read.parquet(path)
    found = content_hash(df, meta["exclude"]).first()
    now = {"rows": found.n_rows, "xor_hash": found.xor_hash, "sum_hash": int(found.sum_hash), "columns": {f.name: f.dataType.simpleString() for f in df.schema}}
    return {k: (meta[k], v) for k, v in now.items() if meta[k] != v}


def export_package(tables: dict[str, DataFrame], folder: str, sort_keys: dict[str, Sequence[str]], sample: int = 25) -> dict:
    """Writes all tables, a sample of each as JSON, and ``manifest.json``; returns the manifest."""
    manifest = {}
    for name, df in tables.items():
        manifest[name] = write_table(df, f"{folder}/{name}", sort_keys.get(name, ()))
        df.orderBy(*sort_keys.get(name, df.columns[:1])).limit(sample).coalesce(1).write.mode("overwrite").json(f"{folder}/samples/{name}")
    _write_text(next(iter(tables.values())).sparkSession, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def load_package(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a package, each verified against the manifest; raises if one differs or is missing."""
    manifest = json.loads(_read_text(spark, f"{folder}/manifest.json"))
    wrong = {name: diff for name in manifest if (diff := verify_table(spark, f"{folder}/{name}"))}
    if wrong:
        raise ValueError(f"tables differ from the manifest: {wrong}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in manifest}


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    """Rows of all parts; columns that a part lacks are NULL."""
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts")
    return out


def with_json(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nested columns as JSON text, for tables with one schema whatever they hold."""
    return df.withColumns({c: F.to_json(c) for c in columns})


def from_json(df: DataFrame, schemas: dict[str, T.DataType | str]) -> DataFrame:
    return df.withColumns({c: F.from_json(c, s) for c, s in schemas.items()})


def write_shards(df: DataFrame, folder: str, append: bool = False) -> None:
    """JSON lines, compressed; ``append`` adds shards."""
    df.write.mode("append" if append else "overwrite").option("compression", "gzip").json(folder)


def read_shards(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All shards of a folder with the name of the shard that each row is from."""
    return spark.read.schema(schema).json(folder).withColumn("shard", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def missing_keys(wanted: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Tombstones (``key``, is_missing) of wanted records that no answer holds."""
    return wanted.select(key).dropna().distinct().join(got, key, "left_anti").withColumn("is_missing", F.lit(True))


def map_concurrent(df: DataFrame, fn: Callable[[str], str], column: str, key: str) -> DataFrame:
    """(``key``, result, error) of ``fn`` on each value: what fails is a row, not an end."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("result", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            results, errors = [], []
            for value in batch.column(1).to_pylist():
                try:
                    results.append(fn(value))
                    errors.append(None)
                except Exception as e:
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(target.field(0).type), pa.array(results, pa.string()), pa.array(errors, pa.string())], schema=target)

    return df.select(key, column).mapInArrow(run, schema)


#: Fields of a record of ``git log``, parted by unit separators; records end with a record separator.
LOG_FIELDS = ["commit_sha", "tree_sha", "parent_shas", "author_name", "author_email", "authored_at", "committer_name", "committer_email", "committed_at", "subject", "body", "refs"]


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits from the output of ``git log`` with ``LOG_FIELDS``; parents as an array, times as instants."""
    fields = F.split(F.col("value"), "\x1f")
    rows = spark.read.option("lineSep", "\x1e").text(path).filter(F.size(fields) >= len(LOG_FIELDS) - 1)
    named = rows.select(*[F.get(fields, i).alias(n) for i, n in enumerate(LOG_FIELDS)]).withColumn("commit_sha", F.trim(F.regexp_replace("commit_sha", r"\s", "")))
    return named.withColumns({"parent_shas": F.filter(F.split("parent_shas", " "), lambda p: p != ""), **{c: F.col(c).try_cast("timestamp") for c in ("authored_at", "committed_at")}})


_CHANGES = T.StructType(
    [T.StructField("commit_sha", T.StringType()), T.StructField("change_status", T.StringType()), T.StructField("path", T.StringType()), T.StructField("previous_path", T.StringType()), T.StructField("additions", T.LongType()), T.StructField("deletions", T.LongType()), T.StructField("is_binary", T.BooleanType())]
)


def parse_changes(stream: str) -> list[tuple]:
    """The files of a commit from NUL-parted raw and numstat output: its sha, then ``:`` records with one path (two if renamed), then counts a path; binary files have no counts."""
    parts = stream.split("\0")
    sha, files, i = parts[0].strip(), {}, 1
    while i < len(parts):
        head = parts[i].lstrip("\n")
        if head.startswith(":"):
            status = head.split(" ")[-1][:1]
            renamed = status in ("R", "C")
            old, new = (parts[i + 1], parts[i + 2]) if renamed else (None, parts[i + 1])
            files[new] = [sha, status, new, old, None, None, False]
            i += 3 if renamed else 2
        elif head.count("\t") == 2:
            added, removed, path = head.split("\t")
            if not path:
                path, i = parts[i + 2], i + 2
            if path in files:
                binary = added == "-"
                files[path][4:] = [None if binary else int(added), None if binary else int(removed), binary]
            i += 1
        else:
            i += 1
    return [tuple(f) for f in files.values()]


def read_git_changes(spark: SparkSession, path: str) -> DataFrame:
    """(commit_sha, change_status, path, previous_path, additions, deletions, is_binary) from files of such records, parted by record separators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(_CHANGES)
        for batch in batches:
            rows = [f for text in batch.column(0).to_pylist() if text and text.strip() for f in parse_changes(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)

    return spark.read.option("lineSep", "\x1e").text(path).mapInArrow(run, _CHANGES)


def read_sources(spark: SparkSession, folder: str, pattern: str = "*.{py,ts,tsx,js,jsx}", most_bytes: int = 2_000_000, skip: Sequence[str] = ("node_modules", ".git", "dist", "build")) -> DataFrame:
    """(path, content, status) of source files below ``folder``: too large ones are named but not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    path = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), f"^{folder.rstrip('/')}/", "")
    named = raw.select(path.alias("path"), "length", "content").filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in skip])))
    small = F.col("length") <= most_bytes
    return named.select("path", F.when(small, F.col("content").cast("string")).alias("content"), F.when(small, "ok").otherwise("too_large").alias("status"))
