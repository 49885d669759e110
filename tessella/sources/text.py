"""Text formats as DataFrames: interval lists, signals, matrices, features, sequences, alignments.

Readers take paths that Spark resolves (gzip included). Columns are addressed by 1-based numbers.
Lines that can't be parsed are dropped by default; with corrupt=True they come back with `_line`.
Containers that need native libraries (HDF5, bigWig, bigBed, BAM, cooler) aren't read; their data
models are Parquet layouts (see tilesets).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords
from ..functions.coords import hashed_importance, row_uid, size_importance, to_absolute

#: Extensions by file type, and the data type that a file type serves.
FILE_TYPES = {
    ".bam": "bam", ".beddb": "beddb", ".bed2ddb": "bed2ddb", ".bigbed": "bigbed", ".bb": "bigbed", ".bigwig": "bigwig", ".bw": "bigwig",
    ".cool": "cooler", ".mcool": "cooler", ".fa": "fasta", ".fna": "fasta", ".fasta": "fasta", ".hitile": "hitile", ".htime": "time-interval-json",
    ".imtiles": "imtiles", ".multires.mv5": "multivec", ".mv5": "multivec", ".gjdb": "geodb",
}
DATA_TYPES = {
    "bam": "reads", "beddb": "bedlike", "bed2ddb": "2d-rectangle-domains", "bigbed": "bedlike", "bigwig": "vector", "cooler": "matrix", "fasta": "sequence",
    "geodb": "geo-json", "hitile": "vector", "imtiles": "image", "multivec": "multivec", "time-interval-json": "time-interval",
}


def infer_filetype(name: str) -> str | None:
    low = name.lower()
    return next((v for k, v in sorted(FILE_TYPES.items(), key=lambda x: -len(x[0])) if low.endswith(k)), None)


def infer_datatype(filetype: str) -> str | None:
    return DATA_TYPES.get(filetype)


def fields(spark: SparkSession, path: str | list[str], delimiter: str | None = None, header: bool = False) -> DataFrame:
    """_line and _f (its fields) of a text file; the delimiter is any run of blanks unless given.

    header: the first line of each file is left out, found as the line at the file's start.
    """
    lines = spark.read.text(path)
    if header:
        lines = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at")).withColumn("_n", F.monotonically_increasing_id())
        first = lines.where("_at = 0").groupBy("_file").agg(F.min("_n").alias("_n"))  # a row a file
        lines = lines.join(first, ["_file", "_n"], "left_anti")
    split = F.split(F.trim("value"), r"\s+") if delimiter is None else F.split(F.rtrim("value"), f"\\Q{delimiter}\\E")
    return lines.where(F.length(F.trim("value")) > 0).select(F.col("value").alias("_line"), split.alias("_f"))


def field(number: int) -> Column:
    """Field by its 1-based number; null if the line is shorter."""
    return F.get("_f", F.lit(number - 1))


def _kept(df: DataFrame, needed: list[str], corrupt: bool) -> DataFrame:
    good = F.lit(True)
    for c in needed:
        good = good & F.col(c).isNotNull()
    return df.withColumn("_corrupt", ~good) if corrupt else df.where(good)


def _importance(kind: str | int, uid: list[str], sides: list[tuple[str, str]], seed: int = 3) -> Column:
    if kind == "size":
        return size_importance(*sides)
    return hashed_importance(seed, *uid) if kind == "random" else field(int(kind)).try_cast("double")


def read_bed(spark: SparkSession, path: str, sizes: DataFrame | None = None, chrom: int = 1, start: int = 2, end: int = 3, name: int | None = None, importance: str | int = "random", delimiter: str | None = None, header: bool = False, offset: int = 0, chromosome: str | None = None, corrupt: bool = False) -> DataFrame:
    """Intervals: chrom, start, end (swapped if reversed), importance, uid, name, fields; with sizes, absolute startPos, endPos, chrOffset.

    importance: "random" (a hash of the line), "size", or a column number.
    """
    df = fields(spark, path, delimiter, header)
    df = df.select("_line", "_f", field(chrom).alias("chrom"), field(start).try_cast("long").alias("_a"), field(end).try_cast("long").alias("_b"))
    df = df.select("*", F.least("_a", "_b").alias("start"), F.greatest("_a", "_b").alias("end"), row_uid("_line").alias("uid"))
    df = df.withColumn("importance", _importance(importance, ["_line"], [("start", "end")])).withColumn("name", field(name) if name else F.lit(""))
    df = _kept(df, ["_a", "_b", "importance"], corrupt)
    if chromosome:
        df = df.where(F.col("chrom") == chromosome)
    out = df.select("chrom", "start", "end", "importance", "uid", "name", F.col("_f").alias("fields"), *(["_line", "_corrupt"] if corrupt else []))
    if sizes is None:
        return out
    out = to_absolute(out, sizes, "chrom", startPos="start", endPos="end").withColumn("chrOffset", F.col("startPos") - F.col("start"))
    return out.withColumn("startPos", F.col("startPos") + offset).withColumn("endPos", F.col("endPos") + offset)


def read_bedpe(spark: SparkSession, path: str, sizes: DataFrame, columns: tuple[int, ...] = (1, 2, 3, 4, 5, 6), importance: str | int = "random", delimiter: str | None = None, header: bool = False, chromosome: str | None = None) -> DataFrame:
    """Rectangles: fromX, toX, fromY, toY (absolute, ordered), chrOffset, importance, uid, fields.

    columns: chrom1, start1, end1, chrom2, start2, end2. A chromosome filter keeps rows with either side on it.
    """
    c1, s1, e1, c2, s2, e2 = columns
    df = fields(spark, path, delimiter, header)
    df = df.select("_line", "_f", field(c1).alias("chrom1"), field(c2).alias("chrom2"), *(field(k).try_cast("long").alias(n) for k, n in ((s1, "s1"), (e1, "e1"), (s2, "s2"), (e2, "e2"))))
    df = df.where("s1 IS NOT NULL AND e1 IS NOT NULL AND s2 IS NOT NULL AND e2 IS NOT NULL")
    if chromosome:
        df = df.where((F.col("chrom1") == chromosome) | (F.col("chrom2") == chromosome))
    df = to_absolute(df, sizes, "chrom1", _x1="s1", _x2="e1")
    df = to_absolute(df, sizes, "chrom2", _y1="s2", _y2="e2")
    df = df.select("*", F.least("_x1", "_x2").alias("fromX"), F.greatest("_x1", "_x2").alias("toX"), F.least("_y1", "_y2").alias("fromY"), F.greatest("_y1", "_y2").alias("toY"))
    value = _importance(importance, ["_line"], [("fromX", "toX"), ("fromY", "toY")])
    return df.select("chrom1", "chrom2", "fromX", "toX", "fromY", "toY", (F.col("_x1") - F.col("s1")).alias("chrOffset"), value.alias("importance"), row_uid("_line").alias("uid"), F.col("_f").alias("fields"))


def read_bedgraph(spark: SparkSession, path: str, sizes: DataFrame, chrom: int = 1, start: int = 2, end: int = 3, value: int = 4, missing: str | None = None, exp2: bool = False, closed: bool = False, origin: int = 1, delimiter: str | None = None, header: bool = False, chromosome: str | None = None) -> DataFrame:
    """Interval values: start, end (absolute, end exclusive, first position 0), value.

    origin: the number of an axis's first position in the file. closed: ends are inclusive.
    missing: the token of a missing value. exp2: values are base-2 logarithms.
    """
    df = fields(spark, path, delimiter, header)
    df = df.select(field(chrom).alias("chrom"), field(start).try_cast("long").alias("_s"), field(end).try_cast("long").alias("_e"), field(value).alias("_v"))
    df = df.where("_s IS NOT NULL AND _e IS NOT NULL")
    if chromosome:
        df = df.where(F.col("chrom") == chromosome)
    v = F.when(F.col("_v") != missing, F.col("_v").try_cast("double")) if missing is not None else F.col("_v").try_cast("double")
    df = df.withColumn("value", F.pow(F.lit(2.0), v) if exp2 else v).withColumn("_a", F.greatest(F.col("_s") - origin, F.lit(0))).withColumn("_b", F.col("_e") - origin + (1 if closed else 0))
    return to_absolute(df, sizes, "chrom", start="_a", end="_b").select("chrom", "start", "end", "value")


def read_geojson(spark: SparkSession, path: str, importance: str = "area", lines: bool = False) -> DataFrame:
    """Features with bounds, area (shoelace formula on the outer ring), importance, geometry and properties as JSON.

    lines: each line is a feature, so files can be split; else a file is one collection, held in one row.
    """
    if lines:
        feats = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.col("value").alias("feature"))
    else:
        doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "features array<string>").alias("d"))
        feats = doc.select(F.explode("d.features").alias("feature"))
    kind = F.get_json_object("feature", "$.geometry.type")
    coords = F.get_json_object("feature", "$.geometry.coordinates")
    point = F.array(F.from_json(coords, "array<double>"))
    line = F.from_json(coords, "array<array<double>>")
    rings = F.from_json(coords, "array<array<array<double>>>")
    polygons = F.from_json(coords, "array<array<array<array<double>>>>")
    many, area = kind == "MultiPolygon", kind.isin("Polygon", "MultiLineString")
    out = feats.select(
        "feature",
        F.when(kind == "Point", point).when(many, F.flatten(F.flatten(polygons))).when(area, F.flatten(rings)).otherwise(line).alias("_p"),
        F.when(many, F.transform(polygons, lambda p: F.get(p, F.lit(0)))).when(kind == "Polygon", F.slice(rings, 1, 1)).otherwise(F.array().cast("array<array<array<double>>>")).alias("_outer"),
    )
    x = lambda p: F.get(p, F.lit(0))
    y = lambda p: F.get(p, F.lit(1))
    out = out.withColumn("minLng", F.array_min(F.transform("_p", x))).withColumn("maxLng", F.array_max(F.transform("_p", x))).withColumn("minLat", F.array_min(F.transform("_p", y))).withColumn("maxLat", F.array_max(F.transform("_p", y)))
    out = out.withColumn("area", F.aggregate("_outer", F.lit(0.0), lambda a, r: a + ring_area(r)))
    chosen = F.col("area") if importance == "area" else hashed_importance(3, "feature") if importance == "random" else F.get_json_object("feature", f"$.properties.{importance}").try_cast("double")
    return out.select("minLng", "maxLng", "minLat", "maxLat", "area", chosen.alias("importance"), row_uid("feature").alias("uid"), F.get_json_object("feature", "$.geometry").alias("geometry"), F.get_json_object("feature", "$.properties").alias("properties"))


def ring_area(ring: Column) -> Column:
    """Area of a ring of [x, y] points by the shoelace formula."""
    n = F.size(ring)
    x = lambda k: F.get(F.get(ring, k), F.lit(0))
    y = lambda k: F.get(F.get(ring, k), F.lit(1))
    twice = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda a, k: a + F.coalesce(x(k) * y((k + 1) % F.greatest(n, F.lit(1))) - x((k + 1) % F.greatest(n, F.lit(1))) * y(k), F.lit(0.0)))
    return F.abs(twice) / 2


def read_matrix(spark: SparkSession, path: str, delimiter: str = "\t", first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells i, j, value; labels idx, label) of a labelled square matrix, one line a row.

    Rows are numbered by the place of their label in the header, so files may be split and unordered.
    """
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith(delimiter)).limit(1).collect()
    names = head[0].value.split(delimiter)[1:] if head else lines.limit(1).collect()[0].value.split(delimiter)[1:]
    top = head[0].value if head else lines.limit(1).collect()[0].value
    names = names[:first] if first else names
    labels = spark.createDataFrame(list(enumerate(names)), "idx long, label string")
    body = lines.where(F.col("value") != top).select(F.split("value", f"\\Q{delimiter}\\E").alias("f"))
    rows = body.select(F.get("f", F.lit(0)).alias("label"), F.posexplode(F.slice("f", 2, len(names))).alias("j", "v"))
    few = len(names) <= coords.SEGMENT_LIMIT
    cells = rows.join(F.broadcast(labels) if few else labels, "label").select(F.col("idx").alias("i"), F.col("j").cast("long").alias("j"), F.nanvl(F.col("v").try_cast("double"), F.lit(None)).alias("value"))
    return cells, labels


def read_points(spark: SparkSession, path: str, x: str = "x", y: str = "y") -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col(x).try_cast("double").alias("x"), F.col(y).try_cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


def read_chromsizes(spark: SparkSession, path: str) -> DataFrame:
    """ord, chrom, size, offset in the file's order."""
    rows = fields(spark, path).select(field(1).alias("c"), field(2).try_cast("long").alias("s")).where("s IS NOT NULL").limit(coords.SEGMENT_LIMIT + 1).collect()
    if len(rows) > coords.SEGMENT_LIMIT:
        raise ValueError(f"more than {coords.SEGMENT_LIMIT} segments")
    return coords.segments(spark, [(r.c, r.s) for r in rows])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom, seq; records are cut at `>` at a line's start."""
    records = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    body = F.regexp_replace("value", "^>", "")
    return records.select(F.regexp_extract(body, r"^(\S*)", 1).alias("chrom"), F.regexp_replace(F.regexp_replace(body, r"^[^\n]*", ""), r"\s", "").alias("seq")).where("chrom <> ''")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Text alignments: qname, flag, rname, pos, mapq, cigar, seq, md, tags."""
    df = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("_f"))
    listed = F.slice("_f", 12, F.greatest(F.size("_f") - 11, F.lit(0)))
    names = F.transform(listed, lambda t: F.substring(t, 1, 2))
    # of a repeated tag the first counts
    first = F.filter(listed, lambda t, k: F.array_position(names, F.substring(t, 1, 2)) == k + 1)
    tags = F.map_from_entries(F.transform(first, lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, F.lit(6), F.length(t)))))
    out = df.where(F.size("_f") >= 11).select(field(1).alias("qname"), field(2).try_cast("int").alias("flag"), field(3).alias("rname"), field(4).try_cast("long").alias("pos"), field(5).try_cast("int").alias("mapq"), field(6).alias("cigar"), field(10).alias("seq"), tags.alias("tags"))
    return out.withColumn("md", F.try_element_at("tags", F.lit("MD")))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """chrom, type, start (0-based), end, strand, attrs."""
    df = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("_f")).where(F.size("_f") >= 9)
    return df.select(field(1).alias("chrom"), field(3).alias("type"), (field(4).try_cast("long") - 1).alias("start"), field(5).try_cast("long").alias("end"), field(7).alias("strand"), F.str_to_map(field(9), F.lit(";"), F.lit("=")).alias("attrs"))


def read_vectors(spark: SparkSession, path: str, kind: str = "default", value: int = 4, states: list[str] | None = None, missing: str = "NA", delimiter: str | None = None, header: bool = False) -> DataFrame:
    """chrom, start, end, row, value of an interval list with vectors: default, epilogos or states; browser and track lines are skipped."""
    from ..operators.multivec import default_vector, epilogos_vector, exploded, one_hot

    df = fields(spark, path, delimiter, header).where(~F.col("_line").rlike("^(browser|track)"))
    df = df.select("_line", "_f", field(1).alias("chrom"), field(2).try_cast("long").alias("start"), field(3).try_cast("long").alias("end")).where("start IS NOT NULL AND end IS NOT NULL")
    if kind == "states":
        return one_hot(df.withColumn("state", field(value)), "state", states or []).select("chrom", "start", "end", "row", "value")
    vector = epilogos_vector(F.col("_line")) if kind == "epilogos" else default_vector(F.col("_f"), value, missing)
    return exploded(df.select("chrom", "start", "end", vector.alias("vector")), "vector")


def read_time_interval(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("len long, start string, end string").option("multiLine", True).json(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder of part files."""
    return spark.read.text(path)
