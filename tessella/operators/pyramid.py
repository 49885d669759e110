"""Binned pyramids: algebraic states per bin, and every coarser level from a finer one.

A state keeps count, missing count, sum, sum of squares, minimum and maximum, so any level follows
from any finer level and means are never averaged. Levels are computed from the base bins, which
are far fewer than the rows, in one pass: each base bin is sent to its bin at every level, with
map-side combining, instead of a chain of jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import floor_div
from ..functions.policies import POLICIES, missing

STATE = ("n", "n_missing", "sum", "sumsq", "min", "max")


def base_state(value: Column) -> list[Column]:
    v = missing(value)
    return [F.count("*").alias("n"), F.count_if(v.isNull()).alias("n_missing"), F.sum(v).alias("sum"), F.sum(v * v).alias("sumsq"), F.min(v).alias("min"), F.max(v).alias("max")]


def merged_state() -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing"), F.sum("sum").alias("sum"), F.sum("sumsq").alias("sumsq"), F.min("min").alias("min"), F.max("max").alias("max")]


def mean() -> Column:
    """Mean of the values that aren't missing."""
    return F.col("sum") / F.nullif(F.col("n") - F.col("n_missing"), F.lit(0))


def std() -> Column:
    """Population deviation of the values that aren't missing."""
    n = F.nullif(F.col("n") - F.col("n_missing"), F.lit(0))
    return F.sqrt(F.greatest(F.col("sumsq") / n - F.pow(F.col("sum") / n, F.lit(2)), F.lit(0.0)))


def shifted(v: Column, bits: Column) -> Column:
    """v shifted right by a column of bits: floor division by a power of two, also of negatives."""
    return F.call_function("shiftright", v, bits.cast("int"))


def bins(df: DataFrame, pos: str, value: str, width: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """State of every non-empty bin of `width` positions."""
    return df.groupBy(*keys, floor_div(F.col(pos), width).alias("bin")).agg(*base_state(F.col(value)))


def coarsen(level: DataFrame, factor: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """A level `factor` times coarser."""
    return level.groupBy(*keys, floor_div(F.col("bin"), factor).alias("bin")).agg(*merged_state())


def pyramid(base: DataFrame, deepest: int, step: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """z, bin and state of the levels deepest, deepest - step, ... 0 (always included) over base bins."""
    levels = sorted({0, *range(deepest, -1, -step)})
    up = F.explode(F.array(*map(F.lit, levels))).alias("z")
    sent = base.select("*", up)
    return sent.groupBy(*keys, "z", shifted(F.col("bin"), F.lit(deepest) - F.col("z")).alias("bin")).agg(*merged_state())


def stored_level(z: int, stored: list[int]) -> int:
    """The coarsest stored level that is at least as fine as z."""
    return min((s for s in stored if s >= z), default=max(stored))


def read_level(levels: DataFrame, z: int, stored: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """Level z, from the nearest finer stored one; stored is the driver's list of levels."""
    s = stored_level(z, stored)
    own = levels.where(F.col("z") == s).drop("z")
    return (own if s <= z else coarsen(own, 1 << (s - z), keys)).withColumn("z", F.lit(z))


def tile(levels: DataFrame, z: int, x: int, tile_bins: int, stored: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """Bins of tile x at zoom level z of a pyramid, numbered from 0; empty bins have no row."""
    lo = x * tile_bins
    s = stored_level(z, stored)
    near = levels.where((F.col("z") == s) & (F.col("bin") >= lo << (s - z)) & (F.col("bin") < (lo + tile_bins) << (s - z)))
    return read_level(near, z, [s], keys).withColumn("bin", F.col("bin") - lo)


def tiles(levels: DataFrame, requests: DataFrame, tile_bins: int, stored: list[int]) -> DataFrame:
    """tile_id, bin (from 0) and state of all requested tiles (tile_id, z, x), in one scan of the levels they need."""
    zs = sorted(r.z for r in requests.select("z").distinct().collect())
    if not zs:
        return levels.select(F.lit("").alias("tile_id"), "bin", *STATE).limit(0)
    pairs = F.array(*(F.struct(F.lit(z).alias("z"), F.lit(stored_level(z, stored)).alias("s")) for z in zs))
    near = levels.where(F.col("z").isin([stored_level(z, stored) for z in zs]))
    near = near.withColumn("_l", F.explode(F.filter(pairs, lambda p: p.s == F.col("z"))))
    near = near.withColumn("_b", shifted(F.col("bin"), F.greatest(F.col("_l.s") - F.col("_l.z"), F.lit(0))))
    asked = requests.select("tile_id", F.col("z").alias("_z"), F.col("x").alias("_x"))
    hit = near.withColumn("_z", F.col("_l.z")).withColumn("_x", floor_div(F.col("_b"), tile_bins)).join(asked, ["_z", "_x"])
    return hit.groupBy("tile_id", (F.col("_b") - F.col("_x") * tile_bins).alias("bin")).agg(*merged_state())


def summed(df: DataFrame, pos: str, value: str, width: int, policy: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """bin, value under one of the missing-value policies."""
    return df.groupBy(*keys, floor_div(F.col(pos), width).alias("bin")).agg(POLICIES[policy](missing(F.col(value))).alias("value"))


def interval_bins(df: DataFrame, start: str, end: str, value: str, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """State of bins over interval values [start, end): each position of an interval has its value.

    An interval is clipped to its bins, one row a bin, never to its positions.
    """
    clipped = df.where(F.col(end) > F.col(start)).withColumn("bin", F.explode(F.sequence(floor_div(F.col(start), width), floor_div(F.col(end) - 1, width))))
    size = F.least(F.col(end), (F.col("bin") + 1) * width) - F.greatest(F.col(start), F.col("bin") * width)
    v = missing(F.col(value))
    there = F.when(v.isNotNull(), size).otherwise(0)
    return clipped.groupBy(*keys, "bin").agg(
        F.sum(size).alias("n"), F.sum(size - there).alias("n_missing"), F.sum(v * size).alias("sum"),
        F.sum(v * v * size).alias("sumsq"), F.min(v).alias("min"), F.max(v).alias("max"),
    )


def matrix_pyramid(cells: DataFrame, levels: int, policy: str = "zero") -> DataFrame:
    """z, i, j, value of a sparse matrix (i, j, value): level z has blocks of 2^(levels - z) cells a side."""
    up = cells.select("i", "j", missing(F.col("value")).alias("value"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("z"))
    shift = F.lit(levels) - F.col("z")
    return up.groupBy("z", shifted(F.col("i"), shift).alias("i"), shifted(F.col("j"), shift).alias("j")).agg(POLICIES[policy](F.col("value")).alias("value"))


def sparse_bins(df: DataFrame, positions: list[str], values: list[str], widths: list[int], bins_: int) -> DataFrame:
    """Sums of vector values per tile and bin of any number of dimensions."""
    tiles = [floor_div(F.col(p), w).alias(f"tile_{p}") for p, w in zip(positions, widths)]
    inner = [F.pmod(floor_div(F.col(p) * bins_, w), F.lit(bins_)).alias(f"bin_{p}") for p, w in zip(positions, widths)]
    return df.groupBy(*tiles, *inner).agg(*(F.sum(v).alias(v) for v in values))


def extent(df: DataFrame, *columns: str) -> DataFrame:
    """Minimum and maximum of columns, in one row."""
    return df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))
