"""Window summaries of a signal: mean, minimum, maximum, deviation, and combinations of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pyramid import bins, interval_bins, mean, std

#: Summaries by mode, in the order in which an encoder interleaves them.
MODES = {"mean": ("mean",), "min": ("min",), "max": ("max",), "std": ("std",), "minMax": ("min", "max"), "whisker": ("min", "max", "mean", "std")}


def summarise(states: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """bin and the columns of a mode; the deviation is that of the population."""
    column = {"mean": mean(), "std": std(), "min": F.col("min"), "max": F.col("max")}
    return states.select(*keys, "bin", *(column[c].alias(c) for c in MODES[mode]))


def window_summary(df: DataFrame, pos: str, value: str, width: int, mode: str = "mean", keys: tuple[str, ...] = ()) -> DataFrame:
    return summarise(bins(df, pos, value, width, keys), mode, keys)


def interval_summary(df: DataFrame, start: str, end: str, value: str, width: int, mode: str = "mean", keys: tuple[str, ...] = ()) -> DataFrame:
    return summarise(interval_bins(df, start, end, value, width, keys), mode, keys)


def interleaved(summary: DataFrame, mode: str, n_bins: int) -> DataFrame:
    """position, value: the mode's columns of bins 0 .. n_bins - 1 side by side; bins without a row are null."""
    names = MODES[mode]
    spark = summary.sparkSession
    grid = spark.range(n_bins).withColumnRenamed("id", "bin")
    full = grid.join(summary, "bin", "left")
    item = F.posexplode(F.array(*names)).alias("k", "value")
    return full.select("bin", item).select((F.col("bin") * len(names) + F.col("k")).alias("position"), "value")
