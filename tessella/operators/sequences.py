"""Sequences in fixed-width chunks, their tiles, and guards on what a request may read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alignments import UNMAPPED, flag_is, mismatches, read_id, reference_length, strand, substitutions
from ..functions.coords import absolute_to_segments, region_bins

CHUNK = 1 << 16


def chunked(sequences: DataFrame, width: int = CHUNK) -> DataFrame:
    """chrom, chunk, seq: rows of `width` letters, so that no tile reads a whole segment."""
    n = F.ceil(F.length("seq") / width).cast("int")
    return sequences.where(F.length("seq") > 0).select("chrom", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"), "seq").select("chrom", "chunk", F.substring("seq", F.col("chunk") * width + 1, F.lit(width)).alias("seq"))


def sequence_sizes(sequences: DataFrame) -> DataFrame:
    """Letters per segment."""
    return sequences.groupBy("chrom").agg(F.sum(F.length("seq")).cast("long").alias("size"))


def sequence_tiles(chunks: DataFrame, sizes: DataFrame, requests: DataFrame, width: int = CHUNK) -> DataFrame:
    """tile, sequence of requested spans (tile, start, end) in absolute positions; parts past the end are absent."""
    parts = absolute_to_segments(requests, sizes)
    pieces = parts.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("seg_start") / width), F.floor((F.col("seg_end") - 1) / width)).cast("array<int>")))
    hit = pieces.join(chunks, ["chrom", "chunk"])
    low = F.greatest(F.col("seg_start") - F.col("chunk") * width, F.lit(0))
    high = F.least(F.col("seg_end") - F.col("chunk") * width, F.lit(width))
    hit = hit.withColumn("part", F.substring("seq", (low + 1).cast("int"), (high - low).cast("int")))
    listed = F.array_sort(F.collect_list(F.struct("ord", "chunk", "part")))
    return hit.groupBy("tile").agg(listed.alias("_p")).select("tile", F.array_join(F.transform("_p", lambda p: p.part), "").alias("sequence"))


def alignments(reads: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Mapped reads with id, from, to (0-based, end exclusive), strand, cigars and variants."""
    mapped = reads.where(~flag_is(F.col("flag"), UNMAPPED) & (F.col("cigar") != "*"))
    out = mapped.select(
        read_id(F.col("qname"), F.col("flag")).alias("id"), "qname", F.col("rname").alias("chrom"), "mapq",
        (F.col("pos") - 1).alias("from"), (F.col("pos") - 1 + reference_length(F.col("cigar"))).alias("to"),
        strand(F.col("flag")).alias("strand"), substitutions(F.col("cigar"), F.col("pos")).alias("cigars"),
        mismatches(F.coalesce("md", F.lit("")), F.col("pos")).alias("variants"), "tags",
    )
    if sizes is None:
        return out
    own = F.broadcast(sizes.select("chrom", F.col("offset").alias("_o")))
    return out.join(own, "chrom").withColumn("from", F.col("from") + F.col("_o")).withColumn("to", F.col("to") + F.col("_o")).drop("_o")


def query_size(regions: DataFrame, chunks: DataFrame) -> DataFrame:
    """region, n_bytes: what an index says a region's bins hold; chunks has chrom, bin, n_bytes.

    Positions from 2^29 on have bins of the finest level only: the numbers that coarser levels would
    give them are those of bins elsewhere.
    """
    asked = regions.withColumn("bin", F.explode(region_bins(F.col("start"), F.col("end"), within=True)))
    return asked.join(chunks, ["chrom", "bin"], "left").groupBy("region").agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))


def guarded(width: Column, most: int, inclusive: bool = False) -> Column:
    """Null, or the error of a tile that is wider than it may be."""
    over = width >= most if inclusive else width > most
    return F.when(over, F.concat(F.lit("Tile too large: "), width.cast("string")))


def limited(found: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """keys, n, error: result counts, and an error where there are more than `most`."""
    return found.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("error", F.when(F.col("n") > most, F.lit("Too many results")))
