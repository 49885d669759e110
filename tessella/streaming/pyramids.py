"""Streaming pyramids: windows per zoom level close as the watermark passes, and tiles append.

The batch form needs input sorted by position; here rows may be late by the watermark's delay, and
later ones are dropped. Position is event time, so a tile at zoom z is a window of its width.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.policies import missing


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Timestamps without a zone are read as UTC, since watermarks need an instant."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def level(df: DataFrame, time: str, value: str, width: str, delay: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """start, end, n, sum, min, max of tumbling windows of one level; appends a window when it is closed."""
    v = missing(F.col(value))
    grouped = event_time(df, time).withWatermark(time, delay).groupBy(*keys, F.window(time, width))
    out = grouped.agg(F.count("*").alias("n"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "sum", "min", "max")


def pyramid(df: DataFrame, time: str, value: str, base_seconds: int, levels: int, delay: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """All levels in one aggregation: each row goes to its bin at every level, and each bin closes when the watermark passes its own end.

    z = levels is the finest, of base_seconds; z = 0 has 2^levels of them.
    """
    timed = event_time(df, time).withWatermark(time, delay)
    seconds = F.unix_seconds(time)
    up = timed.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    width = F.lit(base_seconds) * F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(levels) - F.col("z"))
    start = seconds - F.pmod(seconds, width)
    v = missing(F.col(value))
    # the end of a bin is an event time under the watermark of the rows, so the state of a bin goes with its end
    end = F.timestamp_seconds(start + width).alias("end", metadata={"spark.watermarkDelayMs": 0})
    sent = up.select(*keys, "z", F.timestamp_seconds(start).alias("start"), end, v.alias("_v"))
    out = sent.groupBy(*keys, "z", "start", "end").agg(F.count("*").alias("n"), F.sum("_v").alias("sum"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    return out.select(*keys, "z", "start", "n", "sum", "min", "max")


def sliding(df: DataFrame, time: str, value: str, width: str, slide: str, delay: str, keys: tuple[str, ...] = ()) -> DataFrame:
    out = event_time(df, time).withWatermark(time, delay).groupBy(*keys, F.window(time, width, slide)).agg(F.count("*").alias("n"), F.sum(value).alias("sum"))
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "sum")


def sessions(df: DataFrame, time: str, value: str, gap: str, delay: str, keys: tuple[str, ...]) -> DataFrame:
    out = event_time(df, time).withWatermark(time, delay).groupBy(*keys, F.session_window(time, gap)).agg(F.count("*").alias("n"), F.sum(value).alias("sum"))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "sum")


def running_counts(df: DataFrame, key: str) -> DataFrame:
    """Counts by key so far, for update or complete mode."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def closed_tiles(df: DataFrame, time: str, value: str, key: str, width_seconds: int, delay: str) -> DataFrame:
    """A stateful tiler: per key it holds open bins and emits those whose end the watermark has passed.

    Rows within the delay count, however far a key's other rows are ahead; Spark drops rows behind
    the watermark. A timer wakes a key when its earliest open bin ends, so silent keys close too and
    are forgotten once they hold no bin.
    """
    out_schema = f"{key} string, start long, n long, sum double"

    def update(keys, frames, state):
        bins = dict(zip(state.get[0], zip(state.get[1], state.get[2]))) if state.exists else {}
        if not state.hasTimedOut:
            for pdf in frames:
                at = (pdf["_s"] // width_seconds * width_seconds).astype("int64")
                for s, own in pdf.groupby(at):
                    n, t = bins.get(int(s), (0, 0.0))
                    bins[int(s)] = (n + len(own), t + float(own["_v"].sum()))
        passed = state.getCurrentWatermarkMs()
        done = sorted(s for s in bins if (s + width_seconds) * 1000 <= passed)
        rows = [(keys[0], s, int(bins[s][0]), float(bins[s][1])) for s in done]
        for s in done:
            del bins[s]
        if bins:
            state.update((list(bins), [int(v[0]) for v in bins.values()], [float(v[1]) for v in bins.values()]))
            state.setTimeoutTimestamp((min(bins) + width_seconds) * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=[key, "start", "n", "sum"])

    timed = event_time(df, time).withWatermark(time, delay).select(time, F.col(key).cast("string").alias(key), F.unix_seconds(time).alias("_s"), F.col(value).cast("double").alias("_v"))
    return timed.groupBy(key).applyInPandasWithState(update, out_schema, "starts array<long>, counts array<long>, sums array<double>", "append", "EventTimeTimeout")


def write_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Each micro-batch to a writer; Spark's own back-pressure stands in for a queue of savers."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
