"""Sparse matrices: coarsening, tiles, balanced contacts. A missing cell is a missing row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policies import POLICIES, missing

#: Rows of a bins table up to which it is broadcast.
BROADCAST_BINS = 2_000_000


def coarsen(cells: DataFrame, factor: int = 2, policy: str = "zero") -> DataFrame:
    """Blocks of factor x factor cells of (i, j, value)."""
    return cells.groupBy(F.floor(F.col("i") / factor).cast("long").alias("i"), F.floor(F.col("j") / factor).cast("long").alias("j")).agg(POLICIES[policy](missing(F.col("value"))).alias("value"))


def block_tile(cells: DataFrame, z: int, x: int, y: int, deepest: int, tile_cells: int = 256, policy: str = "zero_to_missing") -> DataFrame:
    """Cells (i, j, value) of tile (x, y) at level z, summed on the fly and numbered from 0; x runs over j."""
    k = 1 << (deepest - z)
    lo_i, lo_j = y * tile_cells * k, x * tile_cells * k
    near = cells.where((F.col("i") >= lo_i) & (F.col("i") < lo_i + tile_cells * k) & (F.col("j") >= lo_j) & (F.col("j") < lo_j + tile_cells * k))
    return coarsen(near.withColumn("i", F.col("i") - lo_i).withColumn("j", F.col("j") - lo_j), k, policy)


def block_tiles(cells: DataFrame, requests: DataFrame, deepest: int, tile_cells: int = 256, policy: str = "zero_to_missing") -> DataFrame:
    """tile_id, i, j, value of all requested tiles (tile_id, z, x, y), in one scan; tile by tile it is block_tile."""
    zs = [r.z for r in requests.select("z").distinct().collect()]
    at = cells.select("i", "j", "value", F.explode(F.array(*map(F.lit, zs)).cast("array<int>")).alias("_z"))
    up = lambda c: F.call_function("shiftright", F.col(c), F.lit(deepest) - F.col("_z"))
    at = at.withColumn("_i", up("i")).withColumn("_j", up("j")).withColumn("_x", F.floor(F.col("_j") / tile_cells).cast("long")).withColumn("_y", F.floor(F.col("_i") / tile_cells).cast("long"))
    asked = requests.select("tile_id", F.col("z").alias("_z"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    near = at.join(asked, ["_z", "_x", "_y"])
    place = lambda c, t: (F.col(c) - F.col(t) * tile_cells).alias(c[1])
    return near.groupBy("tile_id", place("_i", "_y"), place("_j", "_x")).agg(POLICIES[policy](missing(F.col("value"))).alias("value"))


def normalised_tile(cells: DataFrame, counts: DataFrame, *tile: int, **options) -> DataFrame:
    """A block tile divided by the same tile of a matrix of valid-cell counts."""
    a, b = block_tile(cells, *tile, **options), block_tile(counts, *tile, **options).withColumnRenamed("value", "n")
    return a.join(b, ["i", "j"]).withColumn("value", F.col("value") / F.nullif("n", F.lit(0.0))).drop("n")


def vector_blocks(values: DataFrame, factor: int, compat: bool = False) -> DataFrame:
    """Means of blocks of an indexed vector (idx, value); compat divides by one more than the count."""
    v = missing(F.col("value"))
    return values.groupBy(F.floor(F.col("idx") / factor).cast("long").alias("bin")).agg((F.sum(v) / (F.count(v) + (1 if compat else 0))).alias("value"))


def _bins_side(bins: DataFrame) -> DataFrame:
    return F.broadcast(bins) if bins.limit(BROADCAST_BINS + 1).count() <= BROADCAST_BINS else bins


def annotated(pixels: DataFrame, bins: DataFrame, *columns: str) -> DataFrame:
    """pixels (bin1, bin2, count) with columns of both bins, suffixed 1 and 2; bins has bin_id."""
    out = pixels
    for k in ("1", "2"):
        side = bins.select(F.col("bin_id").alias(f"bin{k}"), *(F.col(c).alias(f"{c}{k}") for c in columns))
        out = out.join(_bins_side(side), f"bin{k}")
    return out


#: How a balancing vector acts on a count, by transform.
MULTIPLIED, DIVIDED = ("weight",), ("KR", "VC", "VC_SQRT")


def balanced(pixels: DataFrame, bins: DataFrame, transform: str = "default") -> DataFrame:
    """bin1, bin2, value: counts times the weights of both bins, or divided by KR, VC or VC_SQRT."""
    name = {"default": "weight", "ICE": "weight"}.get(transform, transform)
    if name == "none":
        return pixels.select("bin1", "bin2", F.col("count").cast("double").alias("value"))
    both = annotated(pixels, bins, name)
    a, b = F.col(f"{name}1"), F.col(f"{name}2")
    value = F.col("count") * a * b if name in MULTIPLIED else F.col("count") / a / b
    return both.select("bin1", "bin2", value.alias("value"))


def mirrored(cells: DataFrame, i: str = "bin1", j: str = "bin2") -> DataFrame:
    """Both triangles of a symmetric matrix that is stored as its upper one."""
    rest = [c for c in cells.columns if c not in (i, j)]
    other = cells.where(F.col(i) != F.col(j)).select(F.col(j).alias(i), F.col(i).alias(j), *rest)
    return cells.select(i, j, *rest).unionByName(other)


def masked_axis(bins: DataFrame, transform: str, lo: int, hi: int) -> DataFrame:
    """Positions 0 .. hi - lo - 1 whose row and column a dense tile leaves empty: no weight, or past the last bin."""
    grid = bins.sparkSession.range(lo, hi).withColumnRenamed("id", "bin_id")
    return grid.join(bins.select("bin_id", transform), "bin_id", "left").where(F.isnull(transform)).select((F.col("bin_id") - lo).alias("position"))


def contact_tile(pixels: DataFrame, bins: DataFrame, x: int, y: int, side: int = 256, transform: str = "default") -> DataFrame:
    """i, j, value of tile (x, y) of one resolution; x runs over columns j, y over rows i, both triangles."""
    both = mirrored(balanced(pixels, bins, transform))
    near = both.where((F.col("bin1") >= y * side) & (F.col("bin1") < (y + 1) * side) & (F.col("bin2") >= x * side) & (F.col("bin2") < (x + 1) * side))
    return near.select((F.col("bin1") - y * side).alias("i"), (F.col("bin2") - x * side).alias("j"), "value")


def contact_tiles(pixels: DataFrame, bins: DataFrame, requests: DataFrame, side: int = 256, transform: str = "default") -> DataFrame:
    """tile_id, i, j, value of the requested tiles (tile_id, x, y) of one resolution; only pixels of asked rows and columns are balanced."""
    asked = requests.select("tile_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    at = lambda c: F.floor(F.col(c) / side).cast("long")
    pair = pixels.withColumn("_o", F.explode(F.when(F.col("bin1") == F.col("bin2"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    pair = pair.withColumn("_i", F.when(F.col("_o") == 0, F.col("bin1")).otherwise(F.col("bin2"))).withColumn("_j", F.when(F.col("_o") == 0, F.col("bin2")).otherwise(F.col("bin1")))
    near = pair.withColumn("_x", at("_j")).withColumn("_y", at("_i")).join(asked, ["_x", "_y"])
    near = near.select(F.col("_i").alias("bin1"), F.col("_j").alias("bin2"), "count", "tile_id", "_x", "_y")
    name = {"default": "weight", "ICE": "weight"}.get(transform, transform)
    if name == "none":
        value = F.col("count").cast("double")
    else:
        near = annotated(near, bins, name)
        a, b = F.col(f"{name}1"), F.col(f"{name}2")
        value = F.col("count") * a * b if name in MULTIPLIED else F.col("count") / a / b
    return near.select("tile_id", (F.col("bin1") - F.col("_y") * side).alias("i"), (F.col("bin2") - F.col("_x") * side).alias("j"), value.alias("value"))


def masked_tiles(bins: DataFrame, requests: DataFrame, transform: str, side: int = 256) -> DataFrame:
    """tile_id, rows, columns: positions of each requested tile (tile_id, x, y) that stay empty, as masked_axis says.

    transform "none" leaves out only what lies past the last bin.
    """
    name = {"default": "weight", "ICE": "weight"}.get(transform, transform)
    known = bins.select("bin_id", (F.lit(1.0) if name == "none" else F.nanvl(F.col(name).cast("double"), F.lit(None))).alias("_w")).where("_w IS NOT NULL")
    long = requests.select("tile_id", F.explode(F.array(F.struct(F.lit("rows").alias("axis"), F.col("y").alias("t")), F.struct(F.lit("columns").alias("axis"), F.col("x").alias("t")))).alias("a")).select("tile_id", "a.axis", "a.t")
    grid = long.select("tile_id", "axis", F.explode(F.sequence(F.col("t") * side, F.col("t") * side + (side - 1))).alias("bin_id"), (F.col("t") * side).alias("_first"))
    empty = grid.join(known.select(F.col("bin_id").cast("long").alias("bin_id")), "bin_id", "left_anti")
    gone = lambda axis: F.collect_list(F.when(F.col("axis") == axis, (F.col("bin_id") - F.col("_first")).cast("int"))).alias(axis)  # noqa: E731  at most `side` each
    return empty.groupBy("tile_id").agg(gone("rows"), gone("columns"))


def common_transforms(tables: list[DataFrame], candidates: tuple[str, ...] = ("weight", "KR", "VC", "VC_SQRT")) -> list[str]:
    """Balancing vectors that every resolution has; a property of schemas, so no data is read."""
    return [c for c in candidates if all(c in t.columns for t in tables)]


def region_pixels(pixels: DataFrame, bins: DataFrame, first: tuple[str, int, int], second: tuple[str, int, int]) -> DataFrame:
    """Annotated pixels whose bins overlap two regions (chrom, start, end), in either order of storage."""
    def side(k: str, r: tuple[str, int, int]) -> DataFrame:
        """The bins of a region, found before any pixel is read."""
        own = bins.where((F.col("chrom") == r[0]) & (F.col("start") < r[2]) & (F.col("end") > r[1]))
        return _bins_side(own.select(F.col("bin_id").alias(f"bin{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("chrom", "start", "end"))))

    rest = [c for c in pixels.columns if c not in ("bin1", "bin2")]
    other = pixels.where("bin1 <> bin2").select(F.col("bin2").alias("bin1"), F.col("bin1").alias("bin2"), *rest)
    found = [p.join(side("1", first), "bin1").join(side("2", second), "bin2") for p in (pixels.select("bin1", "bin2", *rest), other)]
    return found[0].unionByName(found[1])


def filled_tiles(cells: DataFrame, deepest: int, side: int = 256) -> DataFrame:
    """z, x, y, n of every non-empty tile of a matrix (i, j): what a crawl down the quad-tree visits."""
    up = cells.select("i", "j", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("z"))
    width = F.lit(side) * F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(deepest) - F.col("z"))
    return up.groupBy("z", F.floor(F.col("j") / width).cast("long").alias("x"), F.floor(F.col("i") / width).cast("long").alias("y")).agg(F.count("*").alias("n"))


def children(tiles: DataFrame, filled: Column) -> DataFrame:
    """The four children of each non-empty tile (z, x, y): one step of a crawl down a quad-tree."""
    grid = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    down = tiles.where(filled).select("z", "x", "y", F.explode(grid).alias("g"))
    return down.select((F.col("z") + 1).alias("z"), (2 * F.col("x") + F.col("g.a")).alias("x"), (2 * F.col("y") + F.col("g.b")).alias("y"))
