"""Spark session and lineage helpers."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "strataloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, adaptive execution, Arrow.

    Settings of a running session or of the cluster are kept; ``conf`` wins over the defaults here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The folder is spark.checkpoint.dir of the session. Only a local session without one gets a
    temporary folder: on a cluster a machine's own folder would be lost with the machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="strataloom-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the files of shuffles and checkpoints that nothing refers to any more deleted now, and not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_slices(rows: DataFrame, by: str, slices: int, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fn`` of all ``rows``, one slice of the values of ``by`` after the other, so that only one slice's shuffles are on disk at a time.

    No result of ``fn`` may rest on rows with different values of ``by``.
    """
    if slices <= 1:
        return fn(rows)
    out = None
    for k in range(slices):
        part = cut_lineage(fn(rows.filter(F.pmod(F.xxhash64(by), F.lit(slices)) == k)))
        out = part if out is None else out.unionByName(part)
        release(rows.sparkSession)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
