"""Tiles joined with intervals, rectangles and features by exploding tile numbers into equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import floor_div, inverse_mercator, mercator

#: Requested tiles up to which the requests are broadcast.
REQUEST_LIMIT = 100_000


def _levels(requests: DataFrame, *axes: str) -> tuple[list, DataFrame]:
    """Extent of the requests at each level, in one job; the requests, to be broadcast if they are few."""
    rows = requests.groupBy("z").agg(F.count("*").alias("n"), *(f(c).alias(f"{m}_{c}") for c in axes for m, f in (("lo", F.min), ("hi", F.max)))).collect()
    few = sum(r.n for r in rows) <= REQUEST_LIMIT
    asked = requests.select("tile_id", F.col("z").alias("_z"), *(F.col(c).alias(f"_{c}") for c in axes))
    return sorted(rows, key=lambda r: r.z), F.broadcast(asked) if few else asked


def _per_level(rows: list, max_width: int, *axes: str) -> Column:
    """Array of (z, width, and lo and hi by axis) of the requested levels."""
    fields = [f"{m}_{c}" for c in axes for m in ("lo", "hi")]
    return F.array(*(F.struct(F.lit(r.z).alias("z"), F.lit(max_width >> r.z).cast("long").alias("w"), *(F.lit(r[f]).cast("long").alias(f) for f in fields)) for r in rows))


def _cut(start: Column, end: Column, axis: str) -> Column:
    """Tile numbers of an interval at the level _l, cut to the extent of its requests."""
    w = F.col("_l.w")
    return F.sequence(F.greatest(floor_div(start, w), F.col(f"_l.lo_{axis}")), F.least(floor_div(end, w), F.col(f"_l.hi_{axis}")))


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """An interval touches [lo, hi): it starts before hi and ends at or after lo."""
    return (start < hi) & (end >= lo)


def tiles_of(start: Column, end: Column, width: int | Column) -> Column:
    """Numbers of all tiles that an interval touches, both ends included."""
    return F.sequence(floor_div(start, width), F.greatest(floor_div(start, width), floor_div(end, width)))


def walked_tiles(start: Column, end: Column, width: int) -> Column:
    """Tiles met when stepping by tile widths from the start; a zero-length interval meets none."""
    first = floor_div(start, width)
    n = F.ceil((end - start) / width).cast("long")
    return F.when(n > 0, F.sequence(first, first + F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<bigint>"))


def tile_intervals(items: DataFrame, requests: DataFrame, max_width: int, start: str = "startPos", end: str = "endPos", zoom: str | None = "zoomLevel") -> DataFrame:
    """tile_id and the items of each requested 1-D tile (tile_id, z, x), in one scan for all levels.

    An item is cut to the extent of a level's requests before it is exploded, so a long item makes
    rows for asked tiles only. With `zoom`, an item shows from its level on.
    """
    rows, asked = _levels(requests, "x")
    if not rows:
        return items.select(F.lit("").alias("tile_id"), *items.columns).limit(0)

    def shows(v: Column) -> Column:
        near = overlaps(F.col(start), F.col(end), v.lo_x * v.w, (v.hi_x + 1) * v.w)
        return near & (F.col(zoom) <= v.z) if zoom else near

    at = items.withColumn("_l", F.explode(F.filter(_per_level(rows, max_width, "x"), shows)))
    at = at.withColumn("_x", F.explode(_cut(F.col(start), F.col(end), "x"))).withColumn("_z", F.col("_l.z"))
    return at.join(asked, ["_z", "_x"]).select("tile_id", *items.columns)


def tile_rectangles(items: DataFrame, requests: DataFrame, max_width: int, zoom: str | None = "zoomLevel", names: tuple[str, str, str, str] = ("fromX", "toX", "fromY", "toY")) -> DataFrame:
    """tile_id and the rectangles of each requested 2-D tile (tile_id, z, x, y), in one scan for all levels."""
    rows, asked = _levels(requests, "x", "y")
    if not rows:
        return items.select(F.lit("").alias("tile_id"), *items.columns).limit(0)
    x0, x1, y0, y1 = (F.col(n) for n in names)

    def shows(v: Column) -> Column:
        near = overlaps(x0, x1, v.lo_x * v.w, (v.hi_x + 1) * v.w) & overlaps(y0, y1, v.lo_y * v.w, (v.hi_y + 1) * v.w)
        return near & (F.col(zoom) <= v.z) if zoom else near

    at = items.withColumn("_l", F.explode(F.filter(_per_level(rows, max_width, "x", "y"), shows)))
    at = at.withColumn("_x", F.explode(_cut(x0, x1, "x"))).withColumn("_y", F.explode(_cut(y0, y1, "y"))).withColumn("_z", F.col("_l.z"))
    return at.join(asked, ["_z", "_x", "_y"]).select("tile_id", *items.columns)


def tile_features(items: DataFrame, requests: DataFrame, zoom: str | None = "zoomLevel") -> DataFrame:
    """tile_id and the features (minLng, maxLng, minLat, maxLat) of Mercator tiles; latitude grows upwards."""
    rows, asked = _levels(requests, "x", "y")
    if not rows:
        return items.select(F.lit("").alias("tile_id"), *items.columns).limit(0)
    left, top = mercator(F.col("minLng"), F.col("maxLat"), 0)
    right, bottom = mercator(F.col("maxLng"), F.col("minLat"), 0)
    tile = lambda v, z: F.floor(v * F.pow(F.lit(2.0), z)).cast("long")

    def shows(v: Column) -> Column:
        near = (tile(F.col("_a"), v.z) <= v.hi_x) & (tile(F.col("_b"), v.z) >= v.lo_x) & (tile(F.col("_c"), v.z) <= v.hi_y) & (tile(F.col("_d"), v.z) >= v.lo_y)
        return near & (F.col(zoom) <= v.z) if zoom else near

    side = lambda p, q, axis: F.explode(F.sequence(F.greatest(tile(F.col(p), F.col("_l.z")), F.col(f"_l.lo_{axis}")), F.least(tile(F.col(q), F.col("_l.z")), F.col(f"_l.hi_{axis}"))))
    at = items.withColumns({"_a": left, "_b": right, "_c": top, "_d": bottom}).withColumn("_l", F.explode(F.filter(_per_level(rows, 1, "x", "y"), shows)))
    at = at.withColumn("_x", side("_a", "_b", "x")).withColumn("_y", side("_c", "_d", "y")).withColumn("_z", F.col("_l.z"))
    return at.join(asked, ["_z", "_x", "_y"]).select("tile_id", *items.columns)


def list_items(items: DataFrame, lo: int, hi: int, most: int | None = None, start: str = "startPos", end: str = "endPos", order: tuple[str, ...] = ("startPos", "uid")) -> DataFrame:
    """Items in [lo, hi); the first `most` of them in a total order, if given."""
    found = items.where(overlaps(F.col(start), F.col(end), F.lit(lo), F.lit(hi)))
    return found.orderBy(*order).limit(most) if most else found


def either_axis(items: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rectangles of which one side lies in [lo, hi); one that both sides match counts once."""
    x = items.where(overlaps(F.col("fromX"), F.col("toX"), F.lit(lo), F.lit(hi)))
    y = items.where(overlaps(F.col("fromY"), F.col("toY"), F.lit(lo), F.lit(hi)))
    return x.union(y).distinct()


def _either_tiles(items: DataFrame, requests: DataFrame, max_width: int, deeper: int, zoom: str | None) -> DataFrame:
    """tile_id, subtile and the rectangles of which a side lies in it; subtiles are 2^deeper to a tile (tile_id, z, x)."""
    rows, asked = _levels(requests, "x")
    if not rows:
        return items.select(F.lit("").alias("tile_id"), F.lit(0).cast("long").alias("subtile"), *items.columns).limit(0)
    sides = (("fromX", "toX"), ("fromY", "toY"))

    def shows(v: Column) -> Column:
        lo, hi = v.lo_x * v.w, (v.hi_x + 1) * v.w
        near = overlaps(F.col("fromX"), F.col("toX"), lo, hi) | overlaps(F.col("fromY"), F.col("toY"), lo, hi)
        return near & (F.col(zoom) <= v.z + deeper) if zoom else near

    def cut(a: str, b: str) -> Column:
        first, last, w = F.shiftleft(F.col("_l.lo_x"), deeper), F.shiftleft(F.col("_l.hi_x") + 1, deeper) - 1, F.shiftright(F.col("_l.w"), deeper)
        met = F.sequence(F.greatest(floor_div(F.col(a), w), first), F.least(floor_div(F.col(b), w), last))
        return F.when(overlaps(F.col(a), F.col(b), first * w, (last + 1) * w), met).otherwise(F.array().cast("array<bigint>"))

    at = items.withColumn("_l", F.explode(F.filter(_per_level(rows, max_width, "x"), shows)))
    at = at.withColumn("subtile", F.explode(F.array_distinct(F.concat(*(cut(a, b) for a, b in sides)))))
    at = at.withColumn("_z", F.col("_l.z")).withColumn("_x", F.shiftright("subtile", deeper))
    return at.join(asked, ["_z", "_x"]).select("tile_id", "subtile", *items.columns)


def tile_either(items: DataFrame, requests: DataFrame, max_width: int, zoom: str | None = "zoomLevel") -> DataFrame:
    """tile_id and the rectangles with either side in each requested 1-D tile, in one scan; each counts once."""
    return _either_tiles(items, requests, max_width, 0, zoom).drop("subtile")


def tile_arcs(items: DataFrame, requests: DataFrame, max_width: int, most: int = 25, deeper: int = 3, zoom: str | None = "zoomLevel") -> DataFrame:
    """tile_id, subtile, rank and the arcs of all requested tiles, in one scan: what `arcs` gives tile by tile."""
    once = _either_tiles(items, requests, max_width, deeper, zoom).dropDuplicates(["tile_id", "subtile", "uid"])
    rank = F.row_number().over(Window.partitionBy("tile_id", "subtile").orderBy(F.desc("importance"), "uid"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most)


def arcs(items: DataFrame, x: int, z: int, max_width: int, most: int = 25, deeper: int = 3) -> DataFrame:
    """Arcs with an end in tile x: for each of its 2^deeper sub-tiles the `most` important, each uid once a sub-tile."""
    width = max_width >> (z + deeper)
    first, last = x << deeper, ((x + 1) << deeper) - 1
    sides = []
    for a, b in (("fromX", "toX"), ("fromY", "toY")):
        near = items.where(overlaps(F.col(a), F.col(b), F.lit(first * width), F.lit((last + 1) * width)))
        cut = F.sequence(F.greatest(floor_div(F.col(a), width), F.lit(first)), F.least(floor_div(F.col(b), width), F.lit(last)))
        sides.append(near.withColumn("subtile", F.explode(cut)))
    both = sides[0].union(sides[1])
    once = both.dropDuplicates(["subtile", "uid"])
    rank = F.row_number().over(Window.partitionBy("subtile").orderBy(F.desc("importance"), "uid"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most)


def canonical_pair(a: str, b: str) -> tuple[Column, Column]:
    """The lesser and the greater of two coordinates: one triangle for symmetric data."""
    return F.least(a, b).alias(a), F.greatest(a, b).alias(b)


def nonzero(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is neither 0 nor missing."""
    return df.where(F.col(value).isNotNull() & (F.col(value) != 0))


def starting_rows(rows: DataFrame, lo: int, hi: int, start: str = "start") -> DataFrame:
    """Rows that start in [lo, hi], both ends included; on sorted files the scan skips row groups."""
    return rows.where((F.col(start) >= lo) & (F.col(start) <= hi))


def genome_sorted(df: DataFrame, sizes: DataFrame, chrom: str = "chrom", start: str = "start") -> DataFrame:
    """Rows by absolute position: a range sort, so each partition is one stretch of the axis."""
    from ..functions.coords import to_absolute

    return to_absolute(df, sizes, chrom, abs_start=start).sort("abs_start")


def merged_islands(items: DataFrame, keys: tuple[str, ...], start: str, end: str) -> DataFrame:
    """Numbers the groups of overlapping intervals of each key: running maximum of ends, then a running count of gaps."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    return items.withColumn("_gap", gap).withColumn("island", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


__all__ = ["arcs", "either_axis", "inverse_mercator", "list_items", "merged_islands", "overlaps", "tile_arcs", "tile_either", "tile_features", "tile_intervals", "tile_rectangles", "tiles_of", "walked_tiles"]
