"""Vector-valued tracks: one row per (segment, bin, row), any number of rows a bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import absolute_to_segments
from ..scratch import written
from .pyramid import shifted

KEYS = ("chrom", "bin", "row")


def default_vector(fields: Column, first: int, missing: str = "NA") -> Column:
    """Values of the columns from number `first` (1-based) on; the missing token is null."""
    cut = F.slice(fields, first, F.greatest(F.size(fields) - (first - 1), F.lit(0)))
    return F.transform(cut, lambda v: F.when(v != missing, v.try_cast("double")))


def epilogos_vector(line: Column) -> Column:
    """Scores of `...:[[score,index],...]` in the order of their indices."""
    pairs = F.from_json(F.regexp_extract(line, r"(\[\[.*\]\])[^\[\]]*$", 1), "array<array<double>>")
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(1)).alias("k"), F.get(p, F.lit(0)).alias("v"))))
    return F.transform(ordered, lambda s: s.v)


def one_hot(df: DataFrame, state: str, states: list[str]) -> DataFrame:
    """row, value for each state name in order: 1 for the row's own state, else 0."""
    rows = F.transform(F.array(*map(F.lit, states)), lambda s, i: F.struct(i.alias("row"), F.when(s == F.col(state), 1.0).otherwise(0.0).alias("value")))
    rest = [c for c in df.columns if c not in ("row", "value")]
    return df.select(*rest, F.explode(rows).alias("_r")).select(*rest, "_r.row", "_r.value")


def exploded(df: DataFrame, vector: str) -> DataFrame:
    """One row per vector element, as row and value."""
    rest = [c for c in df.columns if c != vector]
    return df.select(*rest, F.posexplode(vector).alias("row", "value"))


def zipped(files: list[DataFrame]) -> DataFrame:
    """Vectors of several files side by side, by (chrom, start, end); a file without the interval gives nulls.

    Each frame has chrom, start, end, value. Rows are tagged and grouped once, not joined in a chain.
    """
    tagged = None
    for k, df in enumerate(files):
        own = df.select("chrom", "start", "end", F.lit(k).alias("row"), "value")
        tagged = own if tagged is None else tagged.unionByName(own)
    return tagged.groupBy("chrom", "start", "end").pivot("row", list(range(len(files)))).agg(F.first("value")).select(
        "chrom", "start", "end", F.array(*(F.col(str(k)) for k in range(len(files)))).alias("vector"))


def binned(df: DataFrame, resolution: int) -> DataFrame:
    """(chrom, bin, row, value) from vectors that start at multiples of the resolution; others raise."""
    aligned = F.assert_true(F.col("start") % resolution == 0, F.lit(f"starts must be multiples of {resolution}"))
    return df.withColumn("_ok", aligned).where(F.col("_ok").isNull()).select("chrom", F.floor(F.col("start") / resolution).cast("long").alias("bin"), "row", "value")


def _up(base: DataFrame, levels: int) -> DataFrame:
    return base.select("chrom", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("k"), "bin", "row", "value").withColumn("bin", shifted(F.col("bin"), F.col("k")))


def _logsumexp(base: DataFrame, levels: int) -> DataFrame:
    """Base bins from their maximum and rest, then each level from the one below: of two values the maximum and minimum say all."""
    v = base.where(F.col("value").isNotNull())
    top = v.groupBy(*KEYS).agg(F.max("value").alias("_m"))
    level = v.join(top, list(KEYS)).groupBy(*KEYS).agg((F.first("_m") + F.log(F.sum(F.exp(F.col("value") - F.col("_m"))))).alias("value"))
    level = written(level, "level")
    out = level.select(F.lit(0).alias("k"), *KEYS, "value")
    for k in range(1, levels + 1):
        pair = level.groupBy("chrom", shifted(F.col("bin"), F.lit(1)).alias("bin"), "row").agg(F.max("value").alias("_a"), F.min("value").alias("_b"), F.count("*").alias("_n"))
        level = written(pair.select(*KEYS, (F.col("_a") + F.when(F.col("_n") == 2, F.log1p(F.exp(F.col("_b") - F.col("_a")))).otherwise(0.0)).alias("value")), "level")
        out = out.unionByName(level.select(F.lit(k).alias("k"), *KEYS, "value"))
    return out


def halving(base: DataFrame, levels: int, agg: str = "nansum") -> DataFrame:
    """k, chrom, bin, row, value: bins of 2^k base bins. agg: nansum, sum (a missing value makes it missing) or logsumexp."""
    if agg == "logsumexp":
        return _logsumexp(base, levels)
    keys = ("k", *KEYS)
    up = _up(base, levels)
    value = F.coalesce(F.sum("value"), F.lit(0.0)) if agg == "nansum" else F.when(F.count_if(F.col("value").isNull()) == 0, F.sum("value"))
    return up.groupBy(*keys).agg(value.alias("value"))


def tiles(levels: DataFrame, sizes: DataFrame, requests: DataFrame, deepest: int, base: int, tile_bins: int) -> DataFrame:
    """tile_id, column, chrom, bin, row, value of all requested tiles (tile_id, z, x), in one scan.

    Columns run over the segments one after another; those past the end of the axis have no rows,
    and an encoder pads them with zeros.
    """
    k = F.lit(deepest) - F.col("z")
    width = F.lit(base).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), k)
    spans = requests.select("tile_id", k.alias("k"), width.alias("_w"), (F.col("x") * width * tile_bins).alias("start"), ((F.col("x") + 1) * width * tile_bins).alias("end"))
    parts = absolute_to_segments(spans, sizes).join(F.broadcast(sizes.select("chrom", "size")), "chrom").withColumn("seg_end", F.least("seg_end", "size")).where("seg_start < seg_end")
    parts = parts.withColumn("_first", F.expr("seg_start div _w")).withColumn("_last", F.expr("(seg_end + _w - 1) div _w"))
    before = Window.partitionBy("tile_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)  # segments of a tile
    parts = parts.withColumn("_at", F.coalesce(F.sum(F.col("_last") - F.col("_first")).over(before), F.lit(0)))
    block = F.explode(F.sequence(F.expr(f"_first div {tile_bins}"), F.expr(f"(_last - 1) div {tile_bins}"))).alias("_block")
    parts = parts.select("tile_id", "k", "chrom", "_first", "_last", "_at", block)
    own = levels.withColumn("_block", F.expr(f"bin div {tile_bins}")).join(parts, ["k", "chrom", "_block"]).where("bin >= _first AND bin < _last")
    return own.select("tile_id", (F.col("bin") - F.col("_first") + F.col("_at")).alias("column"), "chrom", "bin", "row", "value").where(F.col("column") < tile_bins)


def tile(levels: DataFrame, sizes: DataFrame, k: int, base: int, x: int, tile_bins: int) -> DataFrame:
    """column, chrom, bin, row, value of tile x of the level of 2^k base bins."""
    asked = levels.sparkSession.createDataFrame([("", 0, x)], "tile_id string, z int, x long")
    return tiles(levels, sizes, asked, k, base, tile_bins).drop("tile_id")


def stacked(files: list[DataFrame], widths: list[int] | None = None) -> DataFrame:
    """Vector rows (chrom, start, end, row, value) of several files, rows numbered file after file.

    widths: rows of each file; unless given they are counted, in one job.
    """
    tagged = None
    for n, df in enumerate(files):
        own = df.select("chrom", "start", "end", "row", "value", F.lit(n).alias("_file"))
        tagged = own if tagged is None else tagged.unionByName(own)
    if widths is None:
        most = {r["_file"]: r.n for r in tagged.groupBy("_file").agg((F.max("row") + 1).alias("n")).collect()}  # a row a file
        widths = [most.get(n, 0) for n in range(len(files))]
    before = F.array(*(F.lit(sum(widths[:n])) for n in range(len(files))))
    return tagged.select("chrom", "start", "end", (F.col("row") + F.get(before, F.col("_file"))).alias("row"), "value")
