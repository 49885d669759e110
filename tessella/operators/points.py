"""Point clouds and labels: density histograms, capped points, label sampling, thresholds, autocomplete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def square_extent(points: DataFrame) -> tuple[float, float, float]:
    """min x, min y and the longer side of a point cloud."""
    r = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    return (0.0, 0.0, 1.0) if r.x0 is None else (r.x0, r.y0, max(r.x1 - r.x0, r.y1 - r.y0))


def tile_bounds(extent: tuple[float, float, float], z: int, x: int, y: int) -> tuple[float, float, float, float]:
    x0, y0, side = extent
    w = side / (1 << z)
    return x0 + x * w, x0 + (x + 1) * w, y0 + y * w, y0 + (y + 1) * w


def inside(a: float, b: float, c: float, d: float) -> Column:
    """Strictly inside on all four sides."""
    return (F.col("x") > a) & (F.col("x") < b) & (F.col("y") > c) & (F.col("y") < d)


def density(points: DataFrame, bins: int = 256, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """bx, by, n: a histogram over the points' own extent, or over given bounds; empty cells have no row.

    The last edge is closed, as in numpy's histograms.
    """
    if bounds is None:
        r = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        bounds = tuple(r) if r[0] is not None else (0.0, 1.0, 0.0, 1.0)

    def cell(v: str, lo: float, hi: float) -> Column:
        if hi <= lo:
            return F.lit(bins // 2)
        return F.least(F.floor((F.col(v) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")

    a, b, c, d = bounds
    return points.groupBy(cell("x", a, b).alias("bx"), cell("y", c, d).alias("by")).agg(F.count("*").alias("n"))


def density_tile(points: DataFrame, extent: tuple[float, float, float], z: int, x: int, y: int, bins: int = 256, over: str = "data") -> DataFrame:
    """The histogram of one tile; over="data" spans the points in the tile, over="tile" the tile itself."""
    box = tile_bounds(extent, z, x, y)
    return density(points.where(inside(*box)), bins, None if over == "data" else box)


def in_tiles(points: DataFrame, requests: DataFrame, extent: tuple[float, float, float]) -> DataFrame:
    """tile_id and the points strictly inside each requested tile (tile_id, z, x, y), in one scan."""
    x0, y0, side = extent
    zs = sorted(r.z for r in requests.select("z").distinct().collect())
    level = F.explode(F.array(*(F.struct(F.lit(z).alias("z"), F.lit(side / (1 << z)).alias("w")) for z in zs)) if zs else F.array().cast("array<struct<z:int,w:double>>")).alias("_l")
    w = F.col("_l.w")

    def tile(v: str, o: float) -> Column:
        """Number of the tile by its own bounds, whatever rounding the division does."""
        k = F.floor((F.col(v) - o) / w).cast("long")
        return F.when(F.col(v) < o + k * w, k - 1).when(F.col(v) >= o + (k + 1) * w, k + 1).otherwise(k)

    at = points.where(F.lit(side > 0)).select("*", level).select("*", F.col("_l.z").alias("_z"), tile("x", x0).alias("_x"), tile("y", y0).alias("_y"))
    at = at.where((F.col("x") > x0 + F.col("_x") * w) & (F.col("y") > y0 + F.col("_y") * w))
    asked = requests.select("tile_id", F.col("z").alias("_z"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    return at.join(asked, ["_z", "_x", "_y"]).select("tile_id", *points.columns)


def density_tiles(points: DataFrame, requests: DataFrame, extent: tuple[float, float, float], bins: int = 256) -> DataFrame:
    """tile_id, bx, by, n: the histograms of all requested tiles, each over the extent of its own points."""
    near = in_tiles(points.select("x", "y"), requests, extent)
    box = near.groupBy("tile_id").agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))

    def cell(v: str) -> Column:
        lo, hi = F.col(f"_{v}0"), F.col(f"_{v}1")
        return F.when(hi > lo, F.least(F.floor((F.col(v) - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(bins // 2).cast("int")

    return near.join(box, "tile_id").groupBy("tile_id", cell("x").alias("bx"), cell("y").alias("by")).agg(F.count("*").alias("n"))


def capped_points(points: DataFrame, extent: tuple[float, float, float], z: int, x: int, y: int, order: tuple[str, ...], most: int = 30) -> DataFrame:
    """The first `most` points of a tile in a total order."""
    return points.where(inside(*tile_bounds(extent, z, x, y))).orderBy(*order).limit(most)


def top_labels(labels: DataFrame, lo: int, hi: int, most: int) -> DataFrame:
    """The most important labels (idx, label, importance) of [lo, hi)."""
    near = labels.where((F.col("idx") >= lo) & (F.col("idx") < hi))
    return near.orderBy(F.desc("importance"), "idx").limit(most)


def even_labels(labels: DataFrame, lo: int, hi: int, most: int) -> DataFrame:
    """Labels at `most` evenly spaced indices from lo to hi - 1, both ends included."""
    return labels.where(F.col("idx").isin(even_marks(lo, hi, most)))


def even_marks(lo: int, hi: int, most: int) -> list[int]:
    """At most `most` evenly spaced indices from lo to hi - 1."""
    n = max(1, most - 1)
    return sorted({lo + k * (hi - 1 - lo) // n for k in range(most)}) if hi > lo else []


def score_threshold(items: DataFrame, keys: tuple[str, ...], score: str, most: int) -> DataFrame:
    """Items at or above their group's score quantile 1 - most/n; groups of at most `most` items stay whole."""
    # the exact quantile with linear interpolation comes from counts by distinct score, not from a sorted group
    sizes = items.groupBy(*keys).agg(F.count("*").alias("_n"))
    counts = items.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, 0))
    steps = counts.withColumn("_hi", upto).withColumn("_lo", F.col("_hi") - F.col("_c")).join(sizes, list(keys))
    at = (1 - F.lit(float(most)) / F.col("_n")) * (F.col("_n") - 1)
    below, above = F.floor(at), F.ceil(at)
    value = lambda k: F.max(F.when((F.col("_lo") <= k) & (k < F.col("_hi")), F.col(score)))
    cut = steps.where(F.col("_n") > most).groupBy(*keys).agg(value(below).alias("_a"), value(above).alias("_b"), F.first(at - below).alias("_f"))
    cut = cut.select(*keys, F.expr("CAST(_a + (_b - _a) * _f AS bigint)").alias("_cut"))
    return items.join(cut, list(keys), "left").where(F.col("_cut").isNull() | (F.col(score) >= F.col("_cut"))).drop("_cut")


def sampled(items: DataFrame, keys: tuple[str, ...], uid: tuple[str, ...], most: int, seed: int = 0) -> DataFrame:
    """At most `most` items of each group without replacement, the same ones in every run."""
    order = F.xxhash64(F.lit(seed), *uid)
    return items.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order, *uid))).where(F.col("_r") <= most).drop("_r")


def autocomplete(entries: DataFrame, name: str, importance: str, most: int = 10, longest: int = 0) -> DataFrame:
    """substring, name, importance, rank: the most important entries for every substring of their names."""
    low = F.lower(F.regexp_replace(name, "[ ./]", "_"))
    n = F.length(low)
    size = F.least(n, F.lit(longest)) if longest else n
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(size, n - i + 1)), lambda k: F.substring(low, i, k)))))
    each = entries.where(F.length(name) > 0).select(F.explode(parts).alias("substring"), F.col(name).alias("name"), F.col(importance).alias("importance"))
    best = each.groupBy("substring", "name").agg(F.max("importance").alias("importance"))
    rank = F.row_number().over(Window.partitionBy("substring").orderBy(F.desc("importance"), "name"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most)


def dictionary_codes(df: DataFrame, column: str) -> DataFrame:
    """Distinct values and their codes from 0, in order: numbered within ranges, then shifted by the ranges before."""
    values = written(df.select(column).distinct().repartitionByRange(column).withColumn("_p", F.spark_partition_id()), "values")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    shifts = values.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(column))
    return values.withColumn("_k", place).join(F.broadcast(shifts), "_p").select(column, (F.col("_k") - 1 + F.col("_s")).cast("long").alias("code"))
