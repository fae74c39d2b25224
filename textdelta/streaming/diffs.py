"""Diffs of streams of pairs: every row-wise stage runs on a stream as it does on a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import DiffConfig
from ..plans.engine import compute_diff


def diff_stream(pairs: DataFrame, config: DiffConfig | None = None) -> DataFrame:
    """A stream of diffs from a stream of pairs (pair_id, original, modified and any columns)."""
    return compute_diff(pairs, config)


def windowed_statistics(diffs: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and mean similarity in windows of event time; later rows than ``late`` are dropped by the watermark."""
    return (
        diffs.withWatermark(time, late)
        .groupBy(F.window(time, width))
        .agg(F.count("*").alias("diff_count"), F.sum("edit_distance").alias("total_changes"), F.avg("semantic_similarity").alias("avg_similarity"))
        .select("window.start", "window.end", "diff_count", "total_changes", "avg_similarity")
    )


def each_batch(diffs: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Group analyzers on each micro-batch."""
    return diffs.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).start()
