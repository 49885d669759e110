"""Gene-annotation joins: importances by key, citation counts, exon unions, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .intervals import merged_islands


def replaced_importance(items: DataFrame, importances: DataFrame, key: str, default: float = 0.0) -> DataFrame:
    """items with the importance that a table (key, importance) gives their key, else a default."""
    own = importances.groupBy(key).agg(F.max("importance").alias("_new"))
    return items.drop("importance").join(own, key, "left").withColumn("importance", F.coalesce("_new", F.lit(default))).drop("_new")


def citation_counts(genes: DataFrame, citations: DataFrame, key: str = "gene_id") -> DataFrame:
    """genes with the number of distinct citations of their key; genes without one have 0."""
    counts = citations.distinct().groupBy(key).agg(F.count("*").alias("citations"))
    return genes.distinct().join(counts, key, "left").withColumn("citations", F.coalesce("citations", F.lit(0)))


def exon_unions(transcripts: DataFrame, keys: tuple[str, ...], start: str = "txStart", end: str = "txEnd", exon_starts: str = "exonStarts", exon_ends: str = "exonEnds") -> DataFrame:
    """One row per island of overlapping transcripts of a key: its span and the union of its exons.

    Positions are compared as numbers. Exons of an island merge where they overlap.
    """
    islands = merged_islands(transcripts, keys, start, end)
    whole = islands.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_transcripts"))
    exons = islands.select(*keys, "island", F.explode(F.arrays_zip(F.col(exon_starts).alias("s"), F.col(exon_ends).alias("e"))).alias("x")).select(*keys, "island", F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e")).distinct()
    joined = merged_islands(exons.withColumnRenamed("island", "_island"), (*keys, "_island"), "s", "e")
    spans = joined.groupBy(*keys, "_island", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island").withColumnRenamed("_island", "island")
    lists = spans.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_x"))
    out = whole.join(lists, [*keys, "island"], "left")
    return out.withColumn(exon_starts, F.transform("_x", lambda x: x.s)).withColumn(exon_ends, F.transform("_x", lambda x: x.e)).drop("_x")


def gene_predictions(records: DataFrame) -> DataFrame:
    """Transcripts with their exons from GFF rows (chrom, type, start, end, strand, attrs map)."""
    attr = lambda k: F.try_element_at("attrs", F.lit(k))
    genes = records.where(F.col("type") == "gene").select(attr("ID").alias("gene_id"), F.coalesce(attr("Name"), attr("ID")).alias("gene_name"), attr("description").alias("description"))
    made = records.where(F.col("type").isin("mRNA", "transcript")).select(attr("ID").alias("id"), attr("Parent").alias("gene_id"), "chrom", F.col("start").alias("txStart"), F.col("end").alias("txEnd"), "strand")
    part = lambda kind: records.where(F.col("type") == kind).select(F.explode(F.split(attr("Parent"), ",")).alias("id"), "start", "end")
    exons = part("exon").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_x"))
    coding = part("CDS").groupBy("id").agg(F.min("start").alias("cdsStart"), F.max("end").alias("cdsEnd"))
    out = made.join(exons, "id", "left").join(coding, "id", "left").join(genes, "gene_id", "left")
    return out.select("chrom", "txStart", "txEnd", "gene_name", "strand", F.coalesce("cdsStart", "txEnd").alias("cdsStart"), F.coalesce("cdsEnd", "txEnd").alias("cdsEnd"), "gene_id", "id", "description", F.transform("_x", lambda x: x.start).alias("exonStarts"), F.transform("_x", lambda x: x.end).alias("exonEnds"))


def unsorted_rows(rows: DataFrame, order: tuple[str, ...], pos: tuple[str, ...]) -> DataFrame:
    """Rows whose positions come before those of the row above them in a given order.

    Rows are range-sorted and compared within their range; only each range's first row is compared
    with the last one of the range before, so no task sees more than its range.
    """
    columns = rows.columns
    ranged = written(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).withColumn("_o", F.struct(*order)).withColumn("_v", F.struct(*pos)), "ranges")
    inside = Window.partitionBy("_p").orderBy("_o")
    own = ranged.withColumn("_b", F.lag("_v").over(inside))
    edges = ranged.groupBy("_p").agg(F.min("_o").alias("_o"), F.max_by("_v", "_o").alias("_last"))
    before = edges.select("_p", "_o", F.lag("_last").over(Window.orderBy("_p")).alias("_edge"))  # a row a range
    joined = own.join(F.broadcast(before), ["_p", "_o"], "left")
    return joined.where(F.coalesce("_b", "_edge") > F.col("_v")).select(columns)


def below_diagonal(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of a supposedly upper-triangular list that lie below its diagonal."""
    return rows.where(F.col(a) > F.col(b))
