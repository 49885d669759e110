"""Coordinates: segments with offsets, absolute positions, zoom levels, tiles, Mercator, bins.

Positions are longs and levels integers that the driver computes exactly (floating logarithms are
off by one at some powers of two). Zoom 0 is the coarsest level: one tile over everything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a segment table up to which it is a broadcast side and an array literal.
SEGMENT_LIMIT = 200_000


def max_zoom(length: int, tile_size: int) -> int:
    """Levels below 0 that a length needs: the least z with tile_size * 2^z >= length."""
    return max(0, (-(-length // tile_size) - 1).bit_length())


def tile_width(z: int, tile_size: int, deepest: int) -> int:
    return tile_size << (deepest - z)


def quadtree_depth(sizes: list[int], tile_size: int) -> int:
    return max_zoom(sum(sizes), tile_size)


def zoom_resolutions(deepest: int, base: int = 1) -> list[int]:
    """Bin width at each zoom level, coarsest first."""
    return [base << (deepest - z) for z in range(deepest + 1)]


def floor_div(a: Column, b: int | Column) -> Column:
    """Floor division, also of negatives (div truncates)."""
    return F.floor(a / b).cast("long")


def segments(spark: SparkSession, sizes: list[tuple[str, int]]) -> DataFrame:
    """ord, chrom, size, offset of an ordered axis of labelled segments."""
    rows, offset = [], 0
    for k, (name, size) in enumerate(sizes):
        rows.append((k, name, int(size), offset))
        offset += int(size)
    return spark.createDataFrame(rows, "ord int, chrom string, size long, offset long")


def with_offsets(sizes: DataFrame) -> DataFrame:
    """Adds offset to a segment table (ord, chrom, size): the sizes before it, in order."""
    rows = sizes.select("ord", "chrom", "size").orderBy("ord").limit(SEGMENT_LIMIT + 1).collect()
    if len(rows) > SEGMENT_LIMIT:
        raise ValueError(f"more than {SEGMENT_LIMIT} segments")
    return segments(sizes.sparkSession, [(r.chrom, r["size"]) for r in rows])


def total_length(sizes: DataFrame) -> int:
    return sizes.agg(F.sum("size")).first()[0] or 0


def to_absolute(df: DataFrame, sizes: DataFrame, chrom: str = "chrom", **positions: str) -> DataFrame:
    """Adds new=offset(chrom)+old for each new=old; rows of unknown segments drop (see unknown_segments)."""
    own = F.broadcast(sizes.select(F.col("chrom").alias("_chrom"), F.col("offset").alias("_offset")))
    out = df.join(own, F.col(chrom) == F.col("_chrom"))
    return out.select(*df.columns, *((F.col("_offset") + F.col(old)).alias(new) for new, old in positions.items()))


def unknown_segments(df: DataFrame, sizes: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Names that the segment table lacks, and their rows."""
    return df.groupBy(chrom).agg(F.count("*").alias("n_rows")).join(F.broadcast(sizes.select(F.col("chrom").alias(chrom))), chrom, "left_anti")


def absolute_to_segments(df: DataFrame, sizes: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per segment that [start, end) touches: ord, chrom, seg_start, seg_end (local, end exclusive).

    The part beyond the last segment belongs to the last one.
    """
    rows = sizes.orderBy("ord").limit(SEGMENT_LIMIT + 1).collect()
    if len(rows) > SEGMENT_LIMIT:
        raise ValueError(f"more than {SEGMENT_LIMIT} segments")
    if not rows:
        return df.select(*df.columns, F.lit(0).alias("ord"), F.lit("").alias("chrom"), F.lit(0).cast("long").alias("seg_start"), F.lit(0).cast("long").alias("seg_end")).limit(0)
    # segments and intervals meet in buckets of about a segment's mean length, and count in the first that both touch
    far = (1 << 62) - 1
    total = rows[-1].offset + rows[-1]["size"]
    width = max(1, total // len(rows))
    last = max(0, (total - 1) // width)
    bounds = [(r.ord, r.chrom, r.offset, far if k == len(rows) - 1 else r.offset + r["size"], min(r.offset // width, last), last if k == len(rows) - 1 else min(max(r.offset, r.offset + r["size"] - 1) // width, last)) for k, r in enumerate(rows)]
    table = df.sparkSession.createDataFrame(bounds, "ord int, chrom string, _a long, _b long, _p long, _q long").select("ord", "chrom", "_a", "_b", "_p", F.explode(F.sequence("_p", "_q")).alias("_bucket"))
    bucket = lambda v: F.least(F.greatest(F.floor(v / width).cast("long"), F.lit(0)), F.lit(last)).cast("long")
    own = df.select("*", bucket(F.col(start)).alias("_s")).withColumn("_bucket", F.explode(F.sequence(F.col("_s"), F.greatest(F.col("_s"), bucket(F.col(end) - 1)))))
    out = own.join(F.broadcast(table), "_bucket").where((F.col("_a") < F.col(end)) & (F.col("_b") > F.col(start)) & (F.col("_bucket") == F.greatest("_s", "_p")))
    return out.select(
        *(own[c] for c in df.columns), "ord", "chrom",
        (F.greatest(F.col(start), F.col("_a")) - F.col("_a")).alias("seg_start"),
        (F.least(F.col(end), F.col("_b")) - F.col("_a")).alias("seg_end"),
    )


def natural_key(name: Column) -> Column:
    """Sort key: numbered segments by number, then X, Y, M, then other names; names with `_` last."""
    bare = F.lower(F.regexp_replace(name, "^(?i)chr", ""))
    kind = F.when(bare.rlike("^[0-9]+$"), 0).when(bare == "x", 1).when(bare == "y", 2).when(bare.isin("m", "mt"), 3).otherwise(4)
    return F.struct(name.contains("_").cast("int").alias("contig"), kind.alias("kind"), F.coalesce(F.regexp_extract(bare, "^([0-9]{1,18})", 1).try_cast("long"), F.lit(0)).alias("number"), bare.alias("name"))


def bin_in_tile(pos: Column, width: int, bins: int) -> Column:
    """Bin of a position inside its tile of `width` positions."""
    return F.pmod(floor_div(pos, max(1, width // bins)), F.lit(bins))


def parent_bin(tile: Column, bin_: Column, bins: int) -> Column:
    """Bin of the parent tile that holds a bin."""
    return F.pmod(floor_div(bins * F.pmod(tile, F.lit(2)) + bin_, 2), F.lit(bins))


def mercator(lng: Column, lat: Column, z: int | Column) -> tuple[Column, Column]:
    """Fractional tile coordinates of a longitude and latitude in degrees."""
    n = F.pow(F.lit(2.0), F.lit(z) if isinstance(z, int) else z)
    y = F.lit(math.pi) - F.log(F.tan((F.radians(lat) + math.pi / 2) / 2))
    return n * (lng + 180) / 360, n * y / (2 * math.pi)


def inverse_mercator(x: Column, y: Column, z: int | Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of fractional tile coordinates."""
    n = F.pow(F.lit(2.0), F.lit(z) if isinstance(z, int) else z)
    lat = 2 * F.atan(F.exp(F.lit(math.pi) - 2 * math.pi * y / n)) - math.pi / 2
    return x / n * 360 - 180, F.degrees(lat)


def tile_box(x: int, y: int, z: int) -> tuple[float, float, float, float]:
    """minLng, minLat, maxLng, maxLat of a Mercator tile."""
    n = 1 << z
    lat = lambda v: math.degrees(2 * math.atan(math.exp(math.pi - 2 * math.pi * v / n)) - math.pi / 2)
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


#: First bin and log2 of the bin width at each level of the binning index.
BIN_LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))


def region_bins(start: Column, end: Column, within: bool = False) -> Column:
    """All index bins that [start, end) may overlap; within: without numbers past a level's last, which are the next level's."""
    last = end - 1
    beyond = [first for first, _ in BIN_LEVELS[1:]] + [None]

    def level(first: int, bits: int, limit: int | None) -> Column:
        a, b = F.lit(first) + F.shiftright(start, bits), F.lit(first) + F.shiftright(last, bits)
        if not within or limit is None:
            return F.sequence(a, b)
        return F.when(a < limit, F.sequence(a, F.least(b, F.lit(limit - 1)))).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.array(*(level(*x, limit) for x, limit in zip(BIN_LEVELS, beyond))))


def row_uid(*columns: str) -> Column:
    """A deterministic identifier of a row's values."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def hashed_importance(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the row's values and the seed only, not on partitioning."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def size_importance(*sides: tuple[str, str]) -> Column:
    """Longest side, whichever end comes first."""
    spans = [F.abs(F.col(b) - F.col(a)) for a, b in sides]
    return (spans[0] if len(spans) == 1 else F.greatest(*spans)).cast("double")

