"""Calibration and operating counts over event-time windows of a stream of predictions.

Only sums that merge are streamed. AUROC, average precision and resampling need a whole group's order and stay batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.calibration import BINS, bin_index


def windowed_bins(stream: DataFrame, time: str, keys: list[str], width: str, late: str, bins: int = BINS) -> DataFrame:
    """window, keys, bin and its sums; a window is final once the watermark passes it."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("window"), *keys, bin_index(F.col("p"), bins).alias("bin"))
        .agg(F.count("*").alias("n"), F.sum("y").alias("sum_y"), F.sum("p").alias("sum_p"))
    )


def windowed_confusion(stream: DataFrame, time: str, keys: list[str], width: str, late: str, threshold: float) -> DataFrame:
    flag, pos = F.col("p") >= threshold, F.col("y") == 1
    return (
        stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *keys)
        .agg(F.count_if(flag & pos).alias("tp"), F.count_if(flag & ~pos).alias("fp"), F.count_if(~flag & ~pos).alias("tn"), F.count_if(~flag & pos).alias("fn"))
    )
