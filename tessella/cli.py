"""Command line: aggregate interval lists, signals, vectors and features into tilesets; convert vectors."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.coords import max_zoom
from .operators import multivec, placement, pyramid
from .session import session
from .sources import text
from .sources.tilesets import Info, describe, write_description, write_tileset


def _axis(spark: SparkSession, path: str | None) -> tuple[DataFrame, list[tuple[str, int]]]:
    if not path:
        sys.exit("--chromsizes is needed: a file of names and sizes")
    sizes = text.read_chromsizes(spark, path)
    return sizes, [(r.chrom, r["size"]) for r in sizes.orderBy("ord").collect()]


def _info(kind: str, names: list[tuple[str, int]], tile_size: int, length: int, **more) -> Info:
    deepest = max_zoom(length, tile_size)
    return Info(kind, tile_size, deepest, tile_size << deepest, [0], [length - 1], [n for n, _ in names], [s for _, s in names], **more)


def bedfile(spark: SparkSession, a: argparse.Namespace) -> None:
    sizes, names = _axis(spark, a.chromsizes)
    items = text.read_bed(spark, a.input, sizes, importance=a.importance, delimiter=a.delimiter, header=a.has_header, offset=a.offset, chromosome=a.chromosome)
    info = _info("beddb", names, a.tile_size, sum(s for _, s in names) + 1)
    placed, _ = placement.place_intervals(items, a.tile_size, info.max_zoom, a.max_per_tile)
    write_tileset(placed, a.output, info)


def bedpe(spark: SparkSession, a: argparse.Namespace) -> None:
    sizes, names = _axis(spark, a.chromsizes)
    items = text.read_bedpe(spark, a.input, sizes, importance=a.importance, delimiter=a.delimiter, header=a.has_header, chromosome=a.chromosome)
    info = _info("bed2ddb", names, a.tile_size, sum(s for _, s in names) + 1)
    placed, _ = placement.place_rectangles(items, a.tile_size, info.max_zoom, a.max_per_tile)
    write_tileset(placed, a.output, info)


def bedgraph(spark: SparkSession, a: argparse.Namespace) -> None:
    sizes, names = _axis(spark, a.chromsizes)
    signal = text.read_bedgraph(spark, a.input, sizes, missing=a.nan_value, exp2=a.transform == "exp2", closed=a.closed_interval, delimiter=a.delimiter, header=a.has_header, chromosome=a.chromosome)
    length = sum(s for _, s in names)
    info = _info("hitile", names, a.tile_size, length)
    info.stored = sorted({0, *range(info.max_zoom, -1, -a.zoom_step)})
    levels = pyramid.pyramid(pyramid.interval_bins(signal, "start", "end", "value", 1), info.max_zoom, a.zoom_step)
    write_tileset(levels, a.output, info)


def geojson(spark: SparkSession, a: argparse.Namespace) -> None:
    items = text.read_geojson(spark, a.input, a.importance if a.importance != "size" else "area")
    placed, _ = placement.place_features(items, a.max_zoom, a.max_per_tile)
    write_tileset(placed, a.output, Info("gjdb", a.tile_size, a.max_zoom, 360, [-180, -90], [180, 90]))


def vectors(spark: SparkSession, a: argparse.Namespace) -> None:
    sizes, names = _axis(spark, a.chromsizes)
    states = [r.value.strip() for r in spark.read.text(a.row_infos).collect()] if a.row_infos else None
    if a.format == "states" and not states:
        sys.exit("--row-infos is needed for states")
    files = a.input.split(",")
    parts = [text.read_vectors(spark, p, a.format, states=states, delimiter=a.delimiter, header=a.has_header) for p in files]
    rows = states or []
    if len(files) > 1:  # one vector of all files' values, file after file
        parts = [multivec.stacked(parts, [len(states)] * len(files) if a.format == "states" else None)]
        rows = rows * len(files) if a.format == "states" else rows
    known = spark.createDataFrame(names, "chrom string, size long")
    data = parts[0].join(F.broadcast(known), "chrom")
    _write_vectors(a, names, multivec.binned(data, a.resolution), rows)


def signals(spark: SparkSession, a: argparse.Namespace) -> None:
    """Several interval signals as rows of a vector track: sums of values over the positions of each bin."""
    sizes, names = _axis(spark, a.chromsizes)
    rows = [r.value.strip() for r in spark.read.text(a.row_infos).collect()] if a.row_infos else a.input.split(",")
    local = sizes.withColumn("offset", F.lit(0).cast("long"))
    base = None
    for n, path in enumerate(a.input.split(",")):
        signal = text.read_bedgraph(spark, path, local, missing=a.nan_value, origin=0, delimiter=a.delimiter, header=a.has_header, chromosome=a.chromosome)
        own = pyramid.interval_bins(signal, "start", "end", "value", a.resolution, ("chrom",)).select("chrom", "bin", F.lit(n).alias("row"), F.col("sum").alias("value"))
        base = own if base is None else base.unionByName(own)
    _write_vectors(a, names, base, rows)


def _write_vectors(a: argparse.Namespace, names: list[tuple[str, int]], base: DataFrame, rows: list[str]) -> None:
    length = sum(s for _, s in names)
    rows = rows or [str(k) for k in range((base.agg(F.max("row")).first()[0] or 0) + 1)]
    deepest = max_zoom(length, a.tile_size * a.resolution)
    info = _info("multivec", names, a.tile_size, length, row_infos=rows, resolutions=[a.resolution << (deepest - z) for z in range(deepest + 1)])
    info.max_zoom = deepest
    write_tileset(multivec.halving(base, deepest, a.method), a.output, info)


def dense_matrix(spark: SparkSession, a: argparse.Namespace) -> None:
    cells, labels = text.read_matrix(spark, a.input, a.delimiter or "\t")
    n = labels.count()
    levels = max_zoom(n, a.tile_size)
    info = Info("mrmatrix", a.tile_size, levels, a.tile_size << levels, [0, 0], [n, n], row_infos=[r.label for r in labels.orderBy("idx").collect()])
    write_tileset(pyramid.matrix_pyramid(cells, levels), a.output, info)


COMMANDS = {"bedfile": bedfile, "bedpe": bedpe, "bedgraph": bedgraph, "geojson": geojson, "multivec": vectors, "bedfile_to_multivec": vectors, "bigwigs_to_multivec": signals, "tsv_to_mrmatrix": dense_matrix}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("input")
    p.add_argument("output")
    for name, kind, default in (("chromsizes", str, None), ("importance", str, "random"), ("delimiter", str, None), ("chromosome", str, None), ("nan-value", str, None), ("transform", str, "none"), ("format", str, "default"), ("row-infos", str, None), ("method", str, "nansum"), ("tile-size", int, 1024), ("max-per-tile", int, 100), ("offset", int, 0), ("zoom-step", int, 8), ("resolution", int, 1), ("max-zoom", int, 12)):
        p.add_argument(f"--{name}", type=kind, default=default)
    for flag in ("has-header", "closed-interval"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session()
    COMMANDS[a.command](spark, a)
    write_description(spark, describe(a.output, a.command, a.input.split(",")), f"{a.output}/provenance")


if __name__ == "__main__":
    main()

