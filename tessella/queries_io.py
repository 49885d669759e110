"""Named queries over readers, sinks and tile requests: each writes a table in a format, and reads or serves it.

The files lie in the shared scratch folder. The SQL computes the same rows from the tables alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import encode, tileid
from .functions.coords import segments
from .operators import matrix, multivec, pyramid, sequences
from .plans import serving
from .queries import _CELLS, _PIX, _PTS, _WGT, boxes, cloud, events, nation_axis, nation_cells, nation_contacts, order_intervals, order_rectangles, part_labels, query, rounded, state_vectors, table
from .scratch import folder
from .sources import text, tilesets
from .sources.tilesets import Info

_CHROMS = [("chr1", 1_000_000), ("chr2", 500_000), ("chr3", 250_000)]
_SIZES = "(VALUES ('chr1', 1000000, 0), ('chr2', 500000, 1000000), ('chr3', 250000, 1500000)) AS z(chrom, size, offs)"


def s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def lines(df: DataFrame, tag: str, *parts: Column | str, by: str = "\t") -> str:
    """The folder of a text file with a line per row."""
    path = folder(df.sparkSession, tag)
    df.select(F.concat_ws(by, *parts).alias("value")).write.text(path)
    return path


def chrom_of(k: Column) -> Column:
    return F.concat(F.lit("chr"), s(k % 3 + 1))


# ---- readers

_BED = "SELECT o_orderkey, 'chr' || (o_custkey % 3 + 1) AS chrom, o_orderkey % 9000 AS a, o_orderkey % 9000 + o_custkey % 50 AS b, o_totalprice AS v FROM orders"


def order_lines(spark, sf):
    o = table(spark, sf, "orders")
    a = F.col("o_orderkey") % 9000
    return o.select("o_orderkey", chrom_of(F.col("o_custkey")).alias("chrom"), a.alias("a"), (a + F.col("o_custkey") % 50).alias("b"), F.col("o_totalprice").alias("v"))


@query("read_bed", f'SELECT CAST(o_orderkey AS VARCHAR) AS name, a + offs AS "startPos", b + offs AS "endPos", CAST(v AS DOUBLE) AS importance, offs AS "chrOffset" FROM ({_BED}) t JOIN {_SIZES} ON t.chrom = z.chrom')
def read_bed(spark, sf):
    path = lines(order_lines(spark, sf), "bed", "chrom", s("b"), s("a"), s("o_orderkey"), s("v"))  # ends first: they are put in order
    return text.read_bed(spark, path, segments(spark, _CHROMS), name=4, importance=5, delimiter="\t").select("name", "startPos", "endPos", "importance", "chrOffset")


@query("read_bedpe", f'SELECT a + x.offs AS "fromX", b + x.offs AS "toX", a + 10 + 1000000 AS "fromY", b + 20 + 1000000 AS "toY", CAST(b - a + 10 AS DOUBLE) AS importance FROM ({_BED}) t JOIN {_SIZES.replace("z(", "x(")} ON t.chrom = x.chrom')
def read_bedpe(spark, sf):
    path = lines(order_lines(spark, sf), "bedpe", "chrom", s("a"), s("b"), F.lit("chr2"), s(F.col("b") + 20), s(F.col("a") + 10))
    return text.read_bedpe(spark, path, segments(spark, _CHROMS), importance="size").select("fromX", "toX", "fromY", "toY", "importance")


@query("read_bedgraph", f"SELECT t.chrom, a + offs - 1 AS start, b + offs AS \"end\", CASE WHEN o_orderkey % 5 <> 0 THEN pow(2.0, o_orderkey % 8) END AS value FROM ({_BED}) t JOIN {_SIZES} ON t.chrom = z.chrom WHERE a > 0")
def read_bedgraph(spark, sf):
    df = order_lines(spark, sf).where("a > 0")
    path = lines(df, "bedgraph", "chrom", s("a"), s("b"), F.when(F.col("o_orderkey") % 5 == 0, "none").otherwise(s(F.col("o_orderkey") % 8)))
    return text.read_bedgraph(spark, path, segments(spark, _CHROMS), missing="none", exp2=True, closed=True)


@query("read_geojson", "SELECT round(x0, 6) AS \"minLng\", round(x1, 6) AS \"maxLng\", round(y0, 6) AS \"minLat\", round(y1, 6) AS \"maxLat\", round((x1 - x0) * (y1 - y0), 6) AS area, CAST(c_custkey AS DOUBLE) AS importance FROM (SELECT c_custkey, CAST(c_custkey % 340 - 170 AS DOUBLE) AS x0, CAST(c_custkey % 340 - 170 + c_custkey % 9 AS DOUBLE) AS x1, CAST(c_custkey % 150 - 75 AS DOUBLE) AS y0, CAST(c_custkey % 150 - 75 + c_custkey % 7 AS DOUBLE) AS y1 FROM customer)")
def read_geojson(spark, sf):
    point = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(point("minLng", "minLat"), point("maxLng", "minLat"), point("maxLng", "maxLat"), point("minLng", "maxLat"), point("minLng", "minLat"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("uid").alias("rank")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")))
    path = lines(boxes(spark, sf), "geojson", feature)
    return rounded(text.read_geojson(spark, path, "rank", lines=True).select("minLng", "maxLng", "minLat", "maxLat", "area", "importance"), "area", digits=6)


@query("read_matrix", f"SELECT i, j, coalesce(value, 0) AS value FROM (SELECT x.n_nationkey AS i, y.n_nationkey AS j FROM nation x, nation y) LEFT JOIN {_CELLS} USING (i, j)")
def read_matrix(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    names = [r.n_name for r in nation.orderBy("k").collect()]  # 25 rows
    row = nation_cells(spark, sf).groupBy("i").pivot("j", list(range(len(names)))).agg(F.first("value"))
    full = nation.join(row, F.col("k") == F.col("i"), "left").select("n_name", *(s(F.coalesce(F.col(str(k)), F.lit(0.0))).alias(f"v{k}") for k in range(len(names))))
    top = spark.createDataFrame([("\t".join(["", *names]),)], "value string")
    path = folder(spark, "matrix")
    full.select(F.concat_ws("\t", *full.columns).alias("value")).unionByName(top).write.text(path)
    return text.read_matrix(spark, path)[0]


@query("read_points", f"SELECT x, y FROM {_PTS} WHERE x IS NOT NULL AND y IS NOT NULL")
def read_points(spark, sf):
    path = folder(spark, "points")
    cloud(spark, sf).select("x", "y").write.option("header", True).csv(path)
    return text.read_points(spark, path)


@query("read_chromsizes", 'SELECT ord, chrom, size, offs AS "offset" FROM (SELECT n_nationkey AS ord, replace(n_name, \' \', \'_\') AS chrom, CAST(length(n_name) * 100 AS BIGINT) AS size, CAST(coalesce(sum(length(n_name) * 100) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offs FROM nation)')
def read_chromsizes(spark, sf):
    path = lines(nation_axis(spark, sf).orderBy("ord").coalesce(1), "sizes", F.replace("chrom", F.lit(" "), F.lit("_")), s("size"))
    return text.read_chromsizes(spark, path)


@query("read_fasta", "SELECT 'd' || doc_id AS chrom, regexp_replace(text, '[^a-z]', '', 'g') AS seq FROM documents WHERE regexp_replace(text, '[^a-z]', '', 'g') <> ''")
def read_fasta(spark, sf):
    seq = F.regexp_replace("text", "[^a-z]", "")
    docs = table(spark, sf, "documents").where(seq != "")
    path = lines(docs, "fasta", F.concat(F.lit(">d"), s("doc_id"), F.lit(" some words")), F.regexp_replace(seq, "(.{60})", "$1\n"), by="\n")
    return text.read_fasta(spark, path)


@query("read_sam", "SELECT 'r' || o_orderkey AS qname, CAST(o_orderkey % 256 AS INT) AS flag, o_custkey AS pos, '10A' || (o_orderkey % 9) AS md, CAST(o_custkey AS VARCHAR) AS nm FROM orders")
def read_sam(spark, sf):
    o = table(spark, sf, "orders")
    tags = (F.concat(F.lit("NM:i:"), s("o_custkey")), F.concat(F.lit("MD:Z:10A"), s(F.col("o_orderkey") % 9)), F.lit("NM:i:-1"))  # of a repeated tag the first counts
    path = lines(o, "sam", F.concat(F.lit("r"), s("o_orderkey")), s(F.col("o_orderkey") % 256), F.lit("chr1"), s("o_custkey"), F.lit("60"), F.lit("20M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("*"), *tags)
    return text.read_sam(spark, path).select("qname", "flag", "pos", "md", F.try_element_at("tags", F.lit("NM")).alias("nm"))


@query("read_gff", "SELECT p_brand AS chrom, 'gene' AS type, CAST(p_partkey * 10 AS BIGINT) AS start, CAST(p_partkey * 10 + 5 AS BIGINT) AS \"end\", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'g' || p_partkey AS id FROM part")
def read_gff(spark, sf):
    k = F.col("p_partkey")
    path = lines(table(spark, sf, "part"), "gff", "p_brand", F.lit("src"), F.lit("gene"), s(k * 10 + 1), s(k * 10 + 5), F.lit("."), F.when(k % 2 == 0, "+").otherwise("-"), F.lit("."), F.concat(F.lit("ID=g"), s(k), F.lit(";Name=x")))
    return text.read_gff(spark, path).select("chrom", "type", "start", "end", "strand", F.try_element_at("attrs", F.lit("ID")).alias("id"))


_THREE = "SELECT t.chrom, t.a * 50 AS start, r.row, CASE r.row WHEN 0 THEN CAST(t.k AS DOUBLE) WHEN 1 THEN CAST(t.k % 7 AS DOUBLE) WHEN 2 THEN CAST(t.k % 11 AS DOUBLE) END AS value FROM (SELECT DISTINCT 'chr' || (c_custkey % 3 + 1) AS chrom, c_custkey AS a, c_custkey AS k FROM customer) t, (VALUES (0), (1), (2)) AS r(row)"


@query("read_stacked_vectors", _THREE)
def read_stacked_vectors(spark, sf):
    c = table(spark, sf, "customer").select(chrom_of(F.col("c_custkey")).alias("chrom"), (F.col("c_custkey") * 50).alias("a"), F.col("c_custkey").alias("k"))
    at = ("chrom", s("a"), s(F.col("a") + 50))
    two = text.read_vectors(spark, lines(c, "vectors", *at, s("k"), s(F.col("k") % 7)))
    one = text.read_vectors(spark, lines(c, "vectors", *at, s(F.col("k") % 11)))
    return multivec.stacked([two, one]).select("chrom", "start", "row", "value")


@query("read_time_intervals", "SELECT p_partkey AS len, p_name AS start, p_brand AS \"end\" FROM part")
def read_time_intervals(spark, sf):
    path = folder(spark, "times")
    table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("len"), F.col("p_name").alias("start"), F.col("p_brand").alias("end")).write.json(path)
    return spark.read.schema("len long, start string, end string").json(path)


@query("read_parts", "SELECT n_name AS value FROM nation")
def read_parts(spark, sf):
    return text.read_parts(spark, lines(table(spark, sf, "nation").repartition(3), "parts", "n_name"))


# ---- tilesets and other sinks


def stored(df: DataFrame, info: Info) -> tuple[DataFrame, Info]:
    """A tileset written and read again, with its own description."""
    spark, path = df.sparkSession, folder(df.sparkSession, info.kind)
    tilesets.write_tileset(df, path, info)
    return tilesets.read_tileset(spark, path), tilesets.tileset_info(spark, path)


def interval_set(spark, sf) -> tuple[DataFrame, Info]:
    df = order_intervals(spark, sf).withColumns({"chrOffset": F.lit(0).cast("long"), "name": s("uid"), "fields": F.array(s("startPos"), s("endPos"))})
    return stored(df, Info("beddb", 1024, 7, 32768, [0], [32768]))


def rectangle_set(spark, sf) -> tuple[DataFrame, Info]:
    df = order_rectangles(spark, sf).withColumns({"chrOffset": F.lit(0).cast("long"), "fields": F.array(s("fromX"))})
    return stored(df, Info("bed2ddb", 1024, 7, 32768, [0, 0], [32768, 32768]))


def uids(tiles_: DataFrame) -> DataFrame:
    return tiles_.select("tile_id", F.explode("items").alias("i")).select("tile_id", "i.uid")


_OI = "(SELECT o_orderkey AS uid, o_custkey AS a, o_custkey + o_orderkey % 97 AS b, o_orderkey % 4 AS zl FROM orders)"
_OR = "(SELECT o_orderkey AS uid, o_custkey AS a, o_custkey + o_orderkey % 97 AS b, o_orderkey % 1500 AS c, o_orderkey % 1500 + o_orderkey % 61 AS d, o_orderkey % 4 AS zl, o_totalprice AS importance FROM orders)"
_ZX = "(SELECT z, x, 32768 // (1 << z) AS w FROM (VALUES {}) AS t(z, x))"


@query("serve_beddb", f"SELECT 't.' || z || '.' || x AS tile_id, uid FROM {_OI} JOIN {_ZX.format('(2, 0), (5, 1), (7, 3)')} ON a < (x + 1) * w AND b >= x * w AND zl <= z")
def serve_beddb(spark, sf):
    return uids(serving.tiles("beddb", *interval_set(spark, sf), ["t.2.0", "t.5.1", "t.7.3"]))


@query("serve_beddb_guarded", f"SELECT 't.' || z || '.' || x AS tile_id, CASE WHEN z < 3 THEN 'Tile too wide: ' || w WHEN n > 20 THEN 'Too many values in tile, more than 20' END AS error, CASE WHEN z >= 3 AND n <= 20 THEN n ELSE -1 END AS n FROM (SELECT z, x, w, (SELECT count(*) FROM {_OI} WHERE a < (x + 1) * w AND b >= x * w AND zl <= z) AS n FROM {_ZX.format('(2, 0), (6, 1), (7, 200), (7, 3)')})")
def serve_beddb_guarded(spark, sf):
    out = serving.tiles("beddb", *interval_set(spark, sf), ["t.2.0", "t.6.1", "t.7.200", "t.7.3"], widest=4096, most=20)
    return out.select("tile_id", "error", F.coalesce(F.size("items"), F.lit(-1)).cast("long").alias("n"))


@query("serve_bed2ddb", f"SELECT 't.' || z || '.' || x || '.' || y AS tile_id, uid FROM {_OR} JOIN (SELECT z, x, y, 32768 // (1 << z) AS w FROM (VALUES (5, 0, 0), (7, 2, 3)) AS t(z, x, y)) ON a < (x + 1) * w AND b >= x * w AND c < (y + 1) * w AND d >= y * w AND zl <= z UNION ALL SELECT 't.' || z || '.' || x, uid FROM {_OR} JOIN {_ZX.format('(5, 1), (7, 2)')} ON zl <= z AND ((a < (x + 1) * w AND b >= x * w) OR (c < (x + 1) * w AND d >= x * w))")
def serve_bed2ddb(spark, sf):
    return uids(serving.tiles("bed2ddb", *rectangle_set(spark, sf), ["t.5.0.0", "t.7.2.3", "t.5.1", "t.7.2"]))


@query(
    "serve_arcs",
    f"WITH t AS (SELECT z, x, (32768 // (1 << z)) // 8 AS w FROM (VALUES (4, 0), (5, 1)) AS t(z, x)), s AS (SELECT z, x, uid, importance, unnest(list_distinct(list_concat(CASE WHEN a < (x + 1) * 8 * w AND b >= x * 8 * w THEN range(greatest(a // w, x * 8), least(b // w, x * 8 + 7) + 1) ELSE [] END, CASE WHEN c < (x + 1) * 8 * w AND d >= x * 8 * w THEN range(greatest(c // w, x * 8), least(d // w, x * 8 + 7) + 1) ELSE [] END))) AS subtile FROM {_OR}, t WHERE zl <= z + 3), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY z, subtile ORDER BY importance DESC, uid) AS rank FROM s) SELECT 't.' || z || '.' || x AS tile_id, subtile, uid, rank FROM k WHERE rank <= 25",
)
def serve_arcs(spark, sf):
    out = serving.tiles("arcs", *rectangle_set(spark, sf), ["t.4.0", "t.5.1"])
    return out.select("tile_id", F.explode("items").alias("i")).select("tile_id", "i.subtile", "i.uid", F.col("i.rank").cast("long").alias("rank"))


_MX = lambda v: f"floor(8 * ({v} + 180) / 360)"
_MY = lambda v: f"floor(8 * (pi() - ln(tan((radians({v}) + pi() / 2) / 2))) / (2 * pi()))"
_BOX = "(SELECT c_custkey AS uid, CAST(c_custkey % 340 - 170 AS DOUBLE) AS x0, CAST(c_custkey % 340 - 170 + c_custkey % 9 AS DOUBLE) AS x1, CAST(c_custkey % 150 - 75 AS DOUBLE) AS y0, CAST(c_custkey % 150 - 75 + c_custkey % 7 AS DOUBLE) AS y1 FROM customer)"


@query("serve_geo", f"SELECT 't.3.' || tx || '.' || ty AS tile_id, uid FROM {_BOX} JOIN (VALUES (2, 3), (4, 4)) AS t(tx, ty) ON {_MX('x0')} <= tx AND {_MX('x1')} >= tx AND {_MY('y1')} <= ty AND {_MY('y0')} >= ty")
def serve_geo(spark, sf):
    df = boxes(spark, sf).withColumns({"importance": F.lit(1.0), "geometry": F.lit("{}"), "properties": F.lit("{}")})
    return uids(serving.tiles("gjdb", *stored(df, Info("gjdb", 256, 3, 360, [-180, -90], [180, 90])), ["t.3.2.3", "t.3.4.4"]))


_E = "(SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 AS pos FROM events)"


@query("serve_hitile", f"SELECT 't.' || z || '.' || x AS tile_id, g.bin AS bin, round(s / n, 6) AS mean, lo AS mins, hi AS maxs FROM (SELECT z, x, bin FROM (VALUES (2, 0), (4, 3), (4, 15)) AS t(z, x), (SELECT unnest(range(0, 32)) AS bin)) g LEFT JOIN (SELECT z, pos // (1024 * (1 << CAST(6 - z AS INT))) // 32 AS x, pos // (1024 * (1 << CAST(6 - z AS INT))) % 32 AS bin, sum(value) AS s, count(value) AS n, min(value) AS lo, max(value) AS hi FROM {_E}, (VALUES (2), (4)) AS v(z) GROUP BY ALL) USING (z, x, bin)")
def serve_hitile(spark, sf):
    levels = pyramid.pyramid(pyramid.bins(events(spark, sf), "pos", "value", 1024), 6, 3)
    info = Info("hitile", 32, 6, 1024 * 32 << 6, [0], [1024 * 32 << 6], stored=[0, 3, 6])
    out = serving.tiles("hitile", *stored(levels, info), ["t.2.0", "t.4.3", "t.4.15"], mode="triple", encoded=False)
    out = out.select("tile_id", F.posexplode(F.arrays_zip("value", "mins", "maxs")).alias("bin", "v")).select("tile_id", F.col("bin").cast("long").alias("bin"), F.round("v.value", 6).alias("mean"), "v.mins", "v.maxs")
    return out


@query("serve_multivec", "SELECT 't.' || z || '.' || x AS tile_id, row, g.col AS \"column\", coalesce(v, 0) AS value FROM (SELECT z, x, row, col FROM (VALUES (0, 0), (2, 1)) AS t(z, x), (SELECT unnest(range(0, 5)) AS row), (SELECT unnest(range(0, 64)) AS col)) g LEFT JOIN (SELECT z, pos // 3600 // (1 << CAST(4 - z AS INT)) // 64 AS x, pos // 3600 // (1 << CAST(4 - z AS INT)) % 64 AS col, row, CAST(count(*) AS DOUBLE) AS v FROM " + _E + " JOIN (VALUES ('click', 0), ('view', 1), ('purchase', 2), ('signup', 3), ('logout', 4)) AS s(event_type, row) USING (event_type), (VALUES (0), (2)) AS zz(z) GROUP BY ALL) USING (z, x, row, col)")
def serve_multivec(spark, sf):
    base = state_vectors(spark, sf).groupBy("chrom", "bin", "row").agg(F.sum("value").alias("value"))
    sizes = segments(spark, [("all", 64 << 4)])
    info = Info("multivec", 64, 4, 64 << 4, [0], [64 << 4], row_infos=["a", "b", "c", "d", "e"])
    out = serving.tiles("multivec", *stored(multivec.halving(base, 4), info), ["t.0.0", "t.2.1"], sizes=sizes, encoded=False)
    out = out.select("tile_id", F.posexplode("value").alias("k", "value"))
    return out.select("tile_id", F.floor(F.col("k") / 64).alias("row"), (F.col("k") % 64).cast("long").alias("column"), "value")


def _square_sql(tiles_: str, source: str, n: int = 8) -> str:
    return f"SELECT 't.' || z || '.' || x || '.' || y AS tile_id, CAST(k AS BIGINT) AS cell, value FROM (SELECT z, x, y, k FROM (VALUES {tiles_}) AS t(z, x, y), (SELECT unnest(range(0, {n * n})) AS k)) g LEFT JOIN ({source}) USING (z, x, y, k)"


def cells_of(tiles_: DataFrame) -> DataFrame:
    return tiles_.select("tile_id", F.posexplode("value").alias("cell", "value")).withColumn("cell", F.col("cell").cast("long"))


_LEVELS = "SELECT z, (j // q) // 8 AS x, (i // q) // 8 AS y, (i // q) % 8 * 8 + (j // q) % 8 AS k, {} AS value FROM (SELECT *, 1 << CAST(2 - z AS INT) AS q FROM " + _CELLS + ", (VALUES (0), (1), (2)) AS v(z)) GROUP BY ALL"


@query("serve_mrmatrix", _square_sql("(0, 0, 0), (1, 1, 0), (2, 3, 3)", _LEVELS.format("sum(value)")))
def serve_mrmatrix(spark, sf):
    info = Info("mrmatrix", 8, 2, 32, [0, 0], [25, 25])
    return cells_of(serving.tiles("mrmatrix", *stored(pyramid.matrix_pyramid(nation_cells(spark, sf), 2), info), ["t.0.0.0", "t.1.1.0", "t.2.3.3"], encoded=False))


@query("serve_npmatrix", _square_sql("(0, 0, 0), (1, 1, 0), (2, 3, 3)", _LEVELS.format("nullif(sum(value), 0)")))
def serve_npmatrix(spark, sf):
    return cells_of(serving.tiles("npmatrix", nation_cells(spark, sf), Info("npmatrix", 8, 2, 32, [0, 0], [25, 25]), ["t.0.0.0", "t.1.1.0", "t.2.3.3"], encoded=False))


@query("serve_npvector", "SELECT 't.' || z || '.' || x AS tile_id, k AS bin, value FROM (SELECT z, x, k FROM (VALUES (0, 0), (3, 1)) AS t(z, x), (SELECT unnest(range(0, 64)) AS k)) g LEFT JOIN (SELECT z, p_partkey // (1 << CAST(5 - z AS INT)) // 64 AS x, p_partkey // (1 << CAST(5 - z AS INT)) % 64 AS k, round(avg(p_retailprice), 6) AS value FROM part, (VALUES (0), (3)) AS v(z) GROUP BY ALL) USING (z, x, k)")
def serve_npvector(spark, sf):
    values = table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("value"))
    out = serving.tiles("npvector", values, Info("npvector", 64, 5, 2048, [0], [2048]), ["t.0.0", "t.3.1"], encoded=False)
    return out.select("tile_id", F.posexplode("value").alias("bin", "value")).select("tile_id", F.col("bin").cast("long").alias("bin"), F.round("value", 6).alias("value"))




@query(
    "serve_cooler",
    f"WITH w AS (SELECT g AS b, CASE WHEN g % 6 <> 0 THEN w END AS w FROM (SELECT unnest(range(0, 32)) AS g) LEFT JOIN {_WGT} ON g = b), m AS (SELECT bin1, bin2, c FROM {_PIX} UNION ALL SELECT bin2, bin1, c FROM {_PIX} WHERE bin1 <> bin2) "
    "SELECT 't.0.' || x || '.' || y AS tile_id, CAST(k AS BIGINT) AS cell, CASE WHEN p.w IS NULL OR q.w IS NULL THEN NULL ELSE round(coalesce(c * p.w * q.w, 0), 6) END AS value FROM (SELECT x, y, k, y * 8 + k // 8 AS i, x * 8 + k % 8 AS j FROM (VALUES (0, 1), (3, 3)) AS t(x, y), (SELECT unnest(range(0, 64)) AS k)) g JOIN w p ON p.b = i JOIN w q ON q.b = j LEFT JOIN m ON bin1 = i AND bin2 = j",
)
def serve_cooler(spark, sf):
    pixels, bins = nation_contacts(spark, sf)
    bins = bins.withColumn("weight", F.when(F.col("bin_id") % 6 != 0, F.col("weight")))
    info = Info("cooler", 8, 0, 32, [0, 0], [25, 25], resolutions=[1])
    out = serving.tiles("cooler", {1: pixels}, info, ["t.0.0.1", "t.0.3.3"], bins={1: bins}, encoded=False)
    return cells_of(out).withColumn("value", F.round("value", 6))


_SQUARE = f"(SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) AS side FROM {_PTS})"
_INSIDE = f"(SELECT tile_id, p.vec_id, p.x, p.y FROM {_PTS} p, {_SQUARE} s, (VALUES ('t.1.0.0', 1, 0, 0), ('t.2.1.2', 2, 1, 2)) AS t(tile_id, z, tx, ty) WHERE p.x > x0 + tx * (side / (1 << z)) AND p.x < x0 + (tx + 1) * (side / (1 << z)) AND p.y > y0 + ty * (side / (1 << z)) AND p.y < y0 + (ty + 1) * (side / (1 << z)))"


def point_info(df: DataFrame, n: int) -> Info:
    from .operators.points import square_extent

    x, y, side = square_extent(df)
    return Info("points", n, 4, 1, [x, y], [x + side, y + side])


@query("serve_points", f"SELECT tile_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY vec_id) AS r FROM {_INSIDE}) WHERE r <= 30")
def serve_points(spark, sf):
    df = cloud(spark, sf)
    out = serving.tiles("points", df, point_info(df, 16), ["t.1.0.0", "t.2.1.2"], order=("vec_id",))
    return out.select("tile_id", F.explode("items").alias("i")).select("tile_id", "i.vec_id")


@query("serve_density", f"SELECT b.tile_id, least(CAST(floor((y - y0) / (y1 - y0) * 16) AS INT), 15) * 16 + least(CAST(floor((x - x0) / (x1 - x0) * 16) AS INT), 15) AS cell, CAST(count(*) AS DOUBLE) AS value FROM {_INSIDE} p JOIN (SELECT tile_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {_INSIDE} GROUP BY 1) b ON p.tile_id = b.tile_id GROUP BY ALL")
def serve_density(spark, sf):
    df = cloud(spark, sf)
    out = serving.tiles("density", df, point_info(df, 16), ["t.1.0.0", "t.2.1.2"], encoded=False)
    return cells_of(out).where("value > 0").withColumn("cell", F.col("cell").cast("int"))


@query("serve_labels", "SELECT 't.' || z || '.' || x AS tile_id, idx, label FROM (SELECT z, x, p_partkey AS idx, p_name AS label, row_number() OVER (PARTITION BY z, x ORDER BY p_retailprice DESC, p_partkey) AS r FROM part JOIN (VALUES (1, 0), (4, 2)) AS t(z, x) ON p_partkey // (2048 // (1 << z)) = x) WHERE r <= 16")
def serve_labels(spark, sf):
    info = Info("nplabels", 16, 4, 2048, [0], [1 << 30])
    out = serving.tiles("nplabels", part_labels(spark, sf), info, ["t.1.0", "t.4.2"], by_importance=True)
    return out.select("tile_id", F.explode("items").alias("i")).select("tile_id", "i.idx", "i.label")


@query("serve_labels_even", "SELECT DISTINCT 't.' || z || '.' || x AS tile_id, p_partkey AS idx FROM part JOIN (SELECT z, x, x * w + k * (w - 1) // 15 AS m FROM (SELECT z, x, 2048 // (1 << z) AS w FROM (VALUES (4, 0), (4, 1)) AS t(z, x)), (SELECT unnest(range(0, 16)) AS k)) ON p_partkey = m")
def serve_labels_even(spark, sf):
    out = serving.tiles("nplabels", part_labels(spark, sf), Info("nplabels", 16, 4, 2048, [0], [1 << 30]), ["t.4.0", "t.4.1"])
    return out.select("tile_id", F.explode("items").alias("i")).select("tile_id", "i.idx")


@query(
    "serve_bigbed",
    "WITH s AS (SELECT 't.' || z || '.' || x AS tile_id, o_orderkey % 2 AS chrom, CAST(floor(o_totalprice) AS BIGINT) AS score FROM orders JOIN " + _ZX.format("(3, 0), (7, 1)") + " ON o_custkey < (x + 1) * w AND o_custkey + o_orderkey % 97 >= x * w), "
    "q AS (SELECT tile_id, chrom, count(*) AS n, list(score ORDER BY score) AS l FROM s GROUP BY ALL), p AS (SELECT *, (1 - 20.0::DOUBLE / n) * (n - 1) AS pt FROM q), "
    "c AS (SELECT tile_id, chrom, CASE WHEN n > 20 THEN CAST(floor(l[CAST(floor(pt) AS INT) + 1] + (l[CAST(ceil(pt) AS INT) + 1] - l[CAST(floor(pt) AS INT) + 1]) * (pt - floor(pt))) AS BIGINT) END AS cut FROM p) "
    "SELECT s.tile_id, 'c' || s.chrom AS chrom, least(count(*), 20) AS n FROM s JOIN c ON s.tile_id = c.tile_id AND s.chrom = c.chrom WHERE cut IS NULL OR score >= cut GROUP BY ALL",
)
def serve_bigbed(spark, sf):
    """Per segment piece of a tile: as many items as reach the score's quantile, and at most 20."""
    df = order_intervals(spark, sf).select("uid", "startPos", "endPos", F.concat(F.lit("c"), s(F.col("uid") % 2)).alias("chrom"), F.floor("importance").alias("score"))
    out = serving.tiles("bigbed", df, Info("bigbed", 1024, 7, 32768, [0], [32768]), ["t.3.0", "t.7.1"], most=20)
    return out.select("tile_id", F.explode("items").alias("i")).groupBy("tile_id", "i.chrom").agg(F.count("*").alias("n"))


@query("serve_bam", f"SELECT 't.7.' || x AS tile_id, 'r' || o_orderkey AS id FROM {_ZX.format('(7, 0), (7, 1)')} LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 8 < 4) ON o_custkey - 1 < (x + 1) * w AND o_custkey - 1 + 20 >= x * w UNION ALL SELECT 't.2.0', NULL")
def serve_bam(spark, sf):
    o = table(spark, sf, "orders")
    path = lines(o, "sam", F.concat(F.lit("r"), s("o_orderkey")), s(F.col("o_orderkey") % 8), F.lit("chr1"), s("o_custkey"), F.lit("60"), F.lit("20M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("A"), F.lit("*"))
    reads = sequences.alignments(text.read_sam(spark, path), segments(spark, [("chr1", 32768)]))
    out = serving.tiles("bam", reads, Info("bam", 1024, 7, 32768, [0], [32768]), ["t.7.0", "t.7.1", "t.2.0"], widest=4096)
    return out.select("tile_id", F.explode_outer("items").alias("i")).select("tile_id", F.regexp_replace("i.id", "_.*", "").alias("id"))


@query("serve_fasta", "WITH s AS (SELECT string_agg(n_name, '' ORDER BY n_nationkey) AS q FROM nation) SELECT 't.3.' || x AS tile_id, substr(q, CAST(x * 64 + 1 AS INT), 64) AS sequence, NULL AS error FROM s, (VALUES (0), (2)) AS t(x) UNION ALL SELECT 't.0.0', NULL, 'Tile too wide: 512'")
def serve_fasta(spark, sf):
    nation = table(spark, sf, "nation")
    sizes = segments(spark, [(r.n_name, len(r.n_name)) for r in nation.orderBy("n_nationkey").collect()])  # 25 rows
    chunks = sequences.chunked(nation.select(F.col("n_name").alias("chrom"), F.col("n_name").alias("seq")), 4)
    return serving.tiles("fasta", chunks, Info("fasta", 64, 3, 512, [0], [512]), ["t.3.0", "t.3.2", "t.0.0"], sizes=sizes, width=4, widest=128)


@query("serve_imtiles", "SELECT 't.2.' || x || '.' || y AS tile_id, image FROM (VALUES (1, 1), (3, 0), (3, 3)) AS t(x, y) LEFT JOIN (SELECT n_nationkey // 5 AS x, n_nationkey % 5 AS y, n_name AS image FROM nation) USING (x, y)")
def serve_imtiles(spark, sf):
    k = F.col("n_nationkey").cast("long")
    df = table(spark, sf, "nation").select(F.lit(2).alias("z"), F.floor(k / 5).alias("x"), (k % 5).alias("y"), F.col("n_name").alias("image"))
    return serving.tiles("imtiles", *stored(df, Info("imtiles", 256, 2, 1024, [0, 0], [1024, 1024])), ["t.2.1.1", "t.2.3.0", "t.2.3.3"])


@query("normalised_tile", f"SELECT i // 4 AS i, j // 4 AS j, round(sum(value) / count(*), 6) AS value FROM {_CELLS} GROUP BY ALL HAVING sum(value) <> 0")
def normalised_tile(spark, sf):
    cells = nation_cells(spark, sf)
    return rounded(matrix.normalised_tile(cells, cells.withColumn("value", F.lit(1.0)), 0, 0, 0, 2, 8), "value", digits=6)


@query("sparse_runs", "SELECT tile, value, count(*) AS n, string_agg(x, ',' ORDER BY x, y) AS xs, string_agg(y, ',' ORDER BY x, y) AS ys FROM (SELECT o_custkey // 256 AS tile, o_custkey % 16 AS x, o_custkey // 16 % 16 AS y, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY ALL) GROUP BY ALL")
def sparse_runs(spark, sf):
    k = F.col("o_custkey")
    cells = table(spark, sf, "orders").groupBy(F.floor(k / 256).alias("tile"), (k % 16).alias("x"), F.floor(k / 16 % 16).alias("y")).agg(F.count("*").cast("double").alias("value"))
    out = encode.sparse_runs(cells, ("tile",), "value", ("x", "y"))
    return out.select("tile", "value", "n", F.array_join(F.col("x").cast("array<string>"), ",").alias("xs"), F.array_join(F.col("y").cast("array<string>"), ",").alias("ys"))


@query("sink_columns", "SELECT CAST(n_nationkey AS VARCHAR) AS tile_id, '{\"name\":\"' || n_name || '\"}' AS tile FROM nation")
def sink_columns(spark, sf):
    path = folder(spark, "columns")
    tilesets.write_columns(nation_tiles(spark, sf), path)
    return spark.read.text(path).select(F.split_part("value", F.lit("\t"), F.lit(1)).alias("tile_id"), F.split_part("value", F.lit("\t"), F.lit(2)).alias("tile"))


def nation_tiles(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").select(s("n_nationkey").alias("tile_id"), F.to_json(F.struct(F.col("n_name").alias("name"))).alias("tile"), F.lit(1).alias("z"), F.col("n_regionkey").alias("x"))


@query("sink_bulk", "SELECT CAST(n_nationkey AS VARCHAR) AS tile_id, n_name AS name FROM nation")
def sink_bulk(spark, sf):
    path = folder(spark, "bulk")
    tilesets.write_bulk(nation_tiles(spark, sf), path, "tiles")
    found = spark.read.text(path).where(F.col("value").contains("tile_value"))
    return found.select(F.get_json_object("value", "$.tile_id").alias("tile_id"), F.get_json_object("value", "$.tile_value.name").alias("name"))


@query("sink_folders", "SELECT CAST(n_nationkey AS VARCHAR) AS tile_id, 1 AS z, n_regionkey AS x FROM nation")
def sink_folders(spark, sf):
    path = folder(spark, "folders")
    tilesets.write_folders(nation_tiles(spark, sf), path, gzip=True)
    return spark.read.json(path).select("tile_id", "z", F.col("x").cast("long").alias("x"))


@query("tile_ids_by_level", "SELECT CAST(o_custkey % 7 AS INT) AS z, o_custkey % 5 AS x, count(*) AS n FROM orders GROUP BY ALL")
def tile_ids_by_level(spark, sf):
    tid = F.concat_ws(".", F.lit("u"), s(F.col("o_custkey") % 7), s(F.col("o_custkey") % 5))
    return table(spark, sf, "orders").select(tileid.parsed(tid).alias("p")).groupBy("p.z", "p.x").agg(F.count("*").alias("n"))
