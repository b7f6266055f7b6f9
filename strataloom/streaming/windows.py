"""Windows over events, the same for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(events: DataFrame, at: str, late: str | None) -> DataFrame:
    return events.withWatermark(at, late) if late and events.isStreaming else events


def window_counts(events: DataFrame, at: str, keys: list[str], value: str, length: str, slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """(window_start, ``keys``, n_events, total) per tumbling (or sliding) window; in a stream events later than ``late`` are left out."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    grouped = _watermarked(events, at, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n_events", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str | None = "1 hour") -> DataFrame:
    """(``key``, session_start, session_end, n_events): runs of events without a pause of ``gap``; the end is the last event plus the gap."""
    grouped = _watermarked(events, at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return grouped.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def first_seen(events: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each event once: in a stream repeats within ``late`` are left out, in a batch all repeats."""
    if events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
