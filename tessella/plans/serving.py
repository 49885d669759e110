"""Tile requests by kind of tileset: `tiles(kind, data, info, tile_ids)` is one plan and one scan for all tiles.

Every asked tile comes back, an empty one with no entries or with fill values; ids that don't
exist at their level give no row. No ids give no rows. The tables of requests are as long as the
list of ids; they are broadcast up to REQUEST_LIMIT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tileid
from ..functions.encode import dense_array, packed
from ..operators import intervals, matrix, multivec, points, pyramid, sequences
from ..operators.intervals import REQUEST_LIMIT
from ..sources.tilesets import Info


def asked(spark: SparkSession, tile_ids: list[str], dims: int = 1) -> DataFrame:
    """tile_id, z, x, y, mode of a request; a repeated id is asked once."""
    ids = list(dict.fromkeys(tile_ids))
    out = tileid.requests(spark, ids, dims)
    return F.broadcast(out) if len(ids) <= REQUEST_LIMIT else out


def _within(tile_ids: list[str], dims: int, deepest: int | None = None) -> list[str]:
    """The ids whose positions exist at their level."""
    out = []
    for t in tile_ids:
        p = tileid.parse(t, dims)
        if p.z >= 0 and all(0 <= v < 1 << p.z for v in (p.x, p.y or 0)) and (deepest is None or p.z <= deepest):
            out.append(t)
    return out


def entries(found: DataFrame, requests: DataFrame, columns: list[str], most: int | None = None) -> DataFrame:
    """tile_id, items, error: the entries of a tile in a fixed order; a tile of more than `most` has an error and none."""
    if most is not None:
        # no more than one beyond the limit is gathered
        found = found.withColumn("_r", F.row_number().over(Window.partitionBy("tile_id").orderBy(*columns[:1]))).where(F.col("_r") <= most + 1)
    items = found.groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("items"))
    out = requests.select("tile_id").join(items, "tile_id", "left").withColumn("items", F.coalesce("items", F.array().cast(items.schema["items"].dataType)))
    over = F.size("items") > (most if most is not None else (1 << 31) - 1)
    error = F.when(over, F.lit(f"Too many values in tile, more than {most}"))
    return out.select("tile_id", F.when(~over, F.col("items")).alias("items"), error.alias("error"))


def _narrow(info: Info, tile_ids: list[str], widest: int | None, dims: int = 1) -> tuple[list[str], list[tuple[str, int]]]:
    """Ids of tiles that are narrow enough, and the others with their widths."""
    width = {t: info.max_width >> tileid.parse(t, dims).z for t in tile_ids}
    wide = [(t, w) for t, w in width.items() if widest is not None and w > widest]
    return [t for t in tile_ids if t not in dict(wide)], wide


def _with_errors(out: DataFrame, wide: list[tuple[str, int]]) -> DataFrame:
    if not wide:
        return out
    spark = out.sparkSession
    errors = spark.createDataFrame([(t, f"Tile too wide: {w}") for t, w in wide], "tile_id string, error string")
    return out.unionByName(errors.select("tile_id", F.lit(None).cast(out.schema["items"].dataType).alias("items"), "error"))


def interval_tiles(data: DataFrame, info: Info, tile_ids: list[str], widest: int | None = None, most: int | None = None) -> DataFrame:
    """1-D tiles of placed intervals. widest, most: guards on a tile's width and on its entries."""
    good, wide = _narrow(info, tile_ids, widest)
    requests = asked(data.sparkSession, good)
    found = intervals.tile_intervals(data, requests, info.max_width)
    return _with_errors(entries(found, requests, ["startPos", "endPos", "uid", "importance", "chrOffset", "name", "fields"], most), wide)


def rectangle_tiles(data: DataFrame, info: Info, tile_ids: list[str]) -> DataFrame:
    """2-D tiles; an id with one position asks for rectangles with either side in it."""
    spark, columns = data.sparkSession, ["fromX", "toX", "fromY", "toY", "uid", "importance", "chrOffset", "fields"]
    flat = [t for t in tile_ids if len(t.split("|")[0].split(".")) == 3]
    square, line = asked(spark, [t for t in tile_ids if t not in flat], 2), asked(spark, flat)
    both = entries(intervals.tile_rectangles(data, square, info.max_width), square, columns)
    return both.unionByName(entries(intervals.tile_either(data, line, info.max_width), line, columns))


def arc_tiles(data: DataFrame, info: Info, tile_ids: list[str], most: int = 25) -> DataFrame:
    requests = asked(data.sparkSession, tile_ids)
    found = intervals.tile_arcs(data, requests, info.max_width, most)
    return entries(found, requests, ["subtile", "rank", "fromX", "toX", "fromY", "toY", "uid", "importance"])


def feature_tiles(data: DataFrame, info: Info, tile_ids: list[str]) -> DataFrame:
    requests = asked(data.sparkSession, tile_ids, 2)
    return entries(intervals.tile_features(data, requests), requests, ["minLng", "maxLng", "minLat", "maxLat", "uid", "importance", "geometry", "properties"])


def scored_tiles(data: DataFrame, info: Info, tile_ids: list[str], most: int = 200, seed: int = 0) -> DataFrame:
    """1-D tiles of scored intervals (chrom, startPos, endPos, uid, score): per segment piece those above the
    score's quantile, and of them at most `most`, drawn by hash."""
    requests = asked(data.sparkSession, tile_ids)
    found = intervals.tile_intervals(data, requests, info.max_width, zoom=None).withColumn("score", F.col("score").cast("long"))
    keys = ("tile_id", "chrom")
    capped = points.sampled(points.score_threshold(found, keys, "score", most), keys, ("uid",), most, seed)
    return entries(capped, requests, ["startPos", "endPos", "chrom", "uid", "score"])


def read_tiles(reads: DataFrame, info: Info, tile_ids: list[str], widest: int | None = None) -> DataFrame:
    """1-D tiles of alignments (id, from, to, strand, cigars, variants) in absolute positions."""
    good, wide = _narrow(info, tile_ids, None if widest is None else widest - 1)
    requests = asked(reads.sparkSession, good)
    found = intervals.tile_intervals(reads, requests, info.max_width, "from", "to", None)
    return _with_errors(entries(found, requests, ["from", "to", "id", "chrom", "strand", "mapq", "cigars", "variants"]), wide)


def sequence_tiles(chunks: DataFrame, info: Info, tile_ids: list[str], sizes: DataFrame, width: int = sequences.CHUNK, widest: int | None = None) -> DataFrame:
    """tile_id, sequence, error; a tile wider than `widest` has an error."""
    good, wide = _narrow(info, tile_ids, widest)
    w = F.lit(info.max_width).cast("long")
    requests = asked(chunks.sparkSession, good).withColumn("_w", F.call_function("shiftright", w, F.col("z")))
    spans = requests.select(F.col("tile_id").alias("tile"), (F.col("x") * F.col("_w")).alias("start"), ((F.col("x") + 1) * F.col("_w")).alias("end"))
    found = sequences.sequence_tiles(chunks, sizes, spans, width).withColumnRenamed("tile", "tile_id")
    out = requests.select("tile_id").join(found, "tile_id", "left").select("tile_id", F.coalesce("sequence", F.lit("")).alias("sequence"), F.lit(None).cast("string").alias("error"))
    errors = chunks.sparkSession.createDataFrame([(t, None, f"Tile too wide: {x}") for t, x in wide], "tile_id string, sequence string, error string")
    return out.unionByName(errors)


def image_tiles(data: DataFrame, info: Info, tile_ids: list[str]) -> DataFrame:
    """tile_id, image of a table of image tiles (z, x, y, image); one that isn't there is null."""
    requests = asked(data.sparkSession, tile_ids, 2)
    return requests.select("tile_id", "z", "x", "y").join(data.select("z", "x", "y", "image"), ["z", "x", "y"], "left").select("tile_id", "image")


def _dense(found: DataFrame, requests: DataFrame, n: int, fill: float | None = None, names: tuple[str, ...] = ("value",), encoded: bool = True) -> DataFrame:
    """Arrays of n values for each asked tile from rows (tile_id, bin, names), packed unless encoded is false.

    The first name's fields are dense, dtype, size, min_value and max_value; of others only the data.
    """
    one = found.groupBy("tile_id").agg(F.collect_list(F.struct("bin", *names)).alias("_v"))
    whole = requests.select("tile_id").join(one, "tile_id", "left").withColumn("_v", F.coalesce("_v", F.array().cast(one.schema["_v"].dataType)))
    column = lambda c: F.transform("_v", lambda s: F.struct(s["bin"].alias("bin"), s[c].alias("value")))
    out = whole.select("tile_id", *(dense_array(column(c), n, fill).alias(c) for c in names))
    if not encoded:
        return out
    out = out.select("tile_id", *(packed(c).alias(c) for c in names))
    return out.select("tile_id", f"{names[0]}.*", *(F.col(f"{c}.dense").alias(c) for c in names[1:]))


def signal_tiles(data: DataFrame, info: Info, tile_ids: list[str], mode: str = "mean", encoded: bool = True) -> DataFrame:
    """Dense tiles of a pyramid: mean, sum, min, max or std; `triple` adds mins and maxs to the means."""
    value = {"mean": pyramid.mean(), "std": pyramid.std(), "sum": F.col("sum"), "min": F.col("min"), "max": F.col("max"), "triple": pyramid.mean()}
    requests = asked(data.sparkSession, _within(tile_ids, 1, info.max_zoom))
    states = pyramid.tiles(data, requests, info.tile_size, info.stored or list(range(info.max_zoom + 1)))
    if mode == "triple":
        return _dense(states.select("tile_id", "bin", value[mode].alias("value"), F.col("min").alias("mins"), F.col("max").alias("maxs")), requests, info.tile_size, names=("value", "mins", "maxs"), encoded=encoded)
    chosen = requests.select("tile_id", F.when(F.col("mode").isin(*value), F.col("mode")).otherwise(mode).alias("_mode"))
    own = value[mode]
    for k, v in value.items():
        own = F.when(F.col("_mode") == k, v).otherwise(own)
    return _dense(states.join(F.broadcast(chosen), "tile_id").select("tile_id", "bin", own.alias("value")), requests, info.tile_size, encoded=encoded)


def vector_tiles(data: DataFrame, info: Info, tile_ids: list[str], sizes: DataFrame, base: int = 1, encoded: bool = True) -> DataFrame:
    """Dense rows x columns of a multivec tile, row after row; columns past the end are 0."""
    n_rows = max(1, len(info.row_infos))
    requests = asked(data.sparkSession, _within(tile_ids, 1, info.max_zoom))
    found = multivec.tiles(data, sizes, requests, info.max_zoom, base, info.tile_size)
    found = found.select("tile_id", (F.col("row") * info.tile_size + F.col("column")).alias("bin"), "value")
    return _dense(found, requests, n_rows * info.tile_size, 0.0, encoded=encoded)


def matrix_tiles(data: DataFrame, info: Info, tile_ids: list[str], encoded: bool = True) -> DataFrame:
    """Dense tiles of a stored matrix pyramid (z, i, j, value); raises beyond the deepest level."""
    for t in tile_ids:
        if tileid.parse(t, 2).z > info.max_zoom:
            raise ValueError(f"zoom level of {t} is beyond {info.max_zoom}")
    n, requests = info.tile_size, asked(data.sparkSession, tile_ids, 2)
    own = requests.select("tile_id", "z", F.col("x").alias("_x"), F.col("y").alias("_y"))
    near = data.withColumn("_x", F.floor(F.col("j") / n).cast("long")).withColumn("_y", F.floor(F.col("i") / n).cast("long")).join(own, ["z", "_x", "_y"])
    return _dense(near.select("tile_id", ((F.col("i") - F.col("_y") * n) * n + F.col("j") - F.col("_x") * n).alias("bin"), "value"), requests, n * n, encoded=encoded)


def array_tiles(data: DataFrame, info: Info, tile_ids: list[str], encoded: bool = True) -> DataFrame:
    """Tiles summed on the fly from a raw matrix (i, j, value)."""
    requests = asked(data.sparkSession, _within(tile_ids, 2, info.max_zoom), 2)
    found = matrix.block_tiles(data, requests, info.max_zoom, info.tile_size)
    return _dense(found.select("tile_id", (F.col("i") * info.tile_size + F.col("j")).alias("bin"), "value"), requests, info.tile_size**2, encoded=encoded)


def values_tiles(data: DataFrame, info: Info, tile_ids: list[str], compat: bool = False, encoded: bool = True) -> DataFrame:
    """Tiles of a raw vector (idx, value): means of blocks; compat divides by one more than the count."""
    spark, deepest, n = data.sparkSession, info.max_zoom, info.tile_size
    good = _within(tile_ids, 1, deepest)
    requests = asked(spark, good)
    zs = sorted({tileid.parse(t).z for t in good})
    at = data.withColumn("_z", F.explode(F.array(*map(F.lit, zs)).cast("array<int>"))).withColumn("_b", F.call_function("shiftright", F.col("idx"), F.lit(deepest) - F.col("_z")))
    near = at.withColumn("_x", F.floor(F.col("_b") / n).cast("long")).join(requests.select("tile_id", F.col("z").alias("_z"), F.col("x").alias("_x")), ["_z", "_x"])
    v = F.nanvl(F.col("value").cast("double"), F.lit(None))
    found = near.groupBy("tile_id", (F.col("_b") - F.col("_x") * n).alias("bin")).agg((F.sum(v) / F.nullif(F.count(v) + int(compat), F.lit(0))).alias("value"))
    return _dense(found, requests, n, encoded=encoded)


def contact_tiles(data: dict[int, DataFrame], info: Info, tile_ids: list[str], bins: dict[int, DataFrame], encoded: bool = True) -> DataFrame:
    """Dense tiles of contacts by resolution, coarsest level 0; rows and columns of bins without a weight, or past the end, are missing."""
    spark = next(iter(data.values())).sparkSession
    shared, out, n = set(matrix.common_transforms(list(bins.values()))), None, info.tile_size
    groups = tileid.by_zoom_and_mode(tile_ids, 2)
    for (z, mode), ids in sorted(groups.items()):
        if z >= len(info.resolutions):
            continue
        r, requests = info.resolutions[z], asked(spark, ids, 2)
        mode = mode if {"default": "weight", "ICE": "weight"}.get(mode, mode) in shared else "none"
        found = matrix.contact_tiles(data[r], bins[r], requests, n, mode).select("tile_id", (F.col("i") * n + F.col("j")).alias("bin"), "value")
        full = _dense(found, requests, n * n, 0.0, encoded=False).join(matrix.masked_tiles(bins[r], requests, mode, n), "tile_id", "left")
        gone = lambda axis, at: F.array_contains(F.coalesce(F.col(axis), F.array().cast("array<int>")), at.cast("int"))
        kept = F.transform("value", lambda v, k: F.when(gone("rows", F.floor(k / n)) | gone("columns", k % n), F.lit(None).cast("double")).otherwise(F.nanvl(F.coalesce(v, F.lit(0.0)), F.lit(0.0))))
        own = full.select("tile_id", kept.alias("value"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = spark.createDataFrame([], "tile_id string, value array<double>")
    return out.select("tile_id", packed("value").alias("t")).select("tile_id", "t.*") if encoded else out


def _square(info: Info) -> tuple[float, float, float]:
    return info.min_pos[0], info.min_pos[1], max(b - a for a, b in zip(info.min_pos, info.max_pos))


def density_tiles(data: DataFrame, info: Info, tile_ids: list[str], encoded: bool = True) -> DataFrame:
    requests = asked(data.sparkSession, _within(tile_ids, 2), 2)
    found = points.density_tiles(data, requests, _square(info), info.tile_size)
    return _dense(found.select("tile_id", (F.col("by") * info.tile_size + F.col("bx")).alias("bin"), F.col("n").cast("double").alias("value")), requests, info.tile_size**2, 0.0, encoded=encoded)


def point_tiles(data: DataFrame, info: Info, tile_ids: list[str], order: tuple[str, ...] = ("x", "y"), most: int = 30) -> DataFrame:
    requests = asked(data.sparkSession, _within(tile_ids, 2), 2)
    near = points.in_tiles(data, requests, _square(info))
    rank = F.row_number().over(Window.partitionBy("tile_id").orderBy(*order))
    return entries(near.withColumn("_rank", rank).where(F.col("_rank") <= most), requests, list(data.columns))


def label_tiles(data: DataFrame, info: Info, tile_ids: list[str], by_importance: bool = False) -> DataFrame:
    """Labels of index ranges: the most important ones, or evenly spaced ones."""
    spark, n = data.sparkSession, info.tile_size
    requests = asked(spark, tile_ids)
    spans = []
    for t in dict.fromkeys(tile_ids):
        p = tileid.parse(t)
        width = info.max_width >> p.z
        spans.append((t, p.z, p.x, p.x * width, min((p.x + 1) * width, int(info.max_pos[0]))))
    if by_importance:
        zs = sorted({s[1] for s in spans})
        level = F.explode(F.array(*(F.struct(F.lit(z).alias("_z"), F.lit(info.max_width >> z).cast("long").alias("_w")) for z in zs)) if zs else F.array().cast("array<struct<_z:int,_w:bigint>>")).alias("_l")
        near = data.select("*", level).where(F.col("idx") < int(info.max_pos[0]))
        near = near.withColumn("_z", F.col("_l._z")).withColumn("_x", F.floor(F.col("idx") / F.col("_l._w")).cast("long"))
        near = near.join(requests.select("tile_id", F.col("z").alias("_z"), F.col("x").alias("_x")), ["_z", "_x"])
        found = near.withColumn("_r", F.row_number().over(Window.partitionBy("tile_id").orderBy(F.desc("importance"), "idx"))).where(F.col("_r") <= n)
    else:
        marks = [(t, k) for t, _, _, lo, hi in spans for k in points.even_marks(lo, hi, n)]
        found = data.join(F.broadcast(spark.createDataFrame(marks, "tile_id string, idx long")) if len(marks) <= REQUEST_LIMIT else spark.createDataFrame(marks, "tile_id string, idx long"), "idx")
    return entries(found, requests, ["idx", "label", "importance"])


TILES: dict[str, Callable[..., DataFrame]] = {
    "beddb": interval_tiles, "bed2ddb": rectangle_tiles, "arcs": arc_tiles, "gjdb": feature_tiles, "hitile": signal_tiles, "multivec": vector_tiles,
    "mrmatrix": matrix_tiles, "npmatrix": array_tiles, "npvector": values_tiles, "density": density_tiles, "points": point_tiles, "nplabels": label_tiles,
    "bigbed": scored_tiles, "cooler": contact_tiles, "bam": read_tiles, "fasta": sequence_tiles, "imtiles": image_tiles,
}


def tiles(kind: str, data: DataFrame | dict, info: Info, tile_ids: list[str], **options) -> DataFrame:
    """Tiles of a tileset by their ids, in one plan."""
    return TILES[kind](data, info, tile_ids, **options)

