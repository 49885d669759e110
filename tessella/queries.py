"""Named queries: each operator over the whole of a standard table, with its DuckDB SQL where SQL can say it.

Stand-ins for genomic axes: events lie at seconds since 2024-01-01, event types are segments or
states; orders are intervals and rectangles on customer and order keys; nations of customers and
suppliers span a matrix; the first embedding components are points; parts are labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import alignments, coords, encode, tileid
from .functions.policies import missing
from .operators import annotations, intervals, matrix, multivec, placement, points, pyramid, sequences, signal
from .scratch import folder
from .streaming import pyramids as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Base bins of the event pyramid: seconds, and levels above them.
BASE, LEVELS = 4096, 6
TYPES = ("click", "view", "purchase", "signup", "logout")


def query(name: str, oracle: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    pos = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return table(spark, sf, "events").select("event_id", "event_type", "user_id", "value", *more, F.floor(pos / 1_000_000).cast("long").alias("pos"))


def r4(c: str | Column) -> Column:
    return F.round(c, 4)


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


_E = "(SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 AS pos FROM events)"
_GAPS = f"(SELECT pos, event_type, event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM {_E})"
_UP = f"SELECT CAST(unnest(range(0, {LEVELS + 1})) AS INT) AS z, * FROM"
_BIN = f"pos // ({BASE} * (1 << CAST({LEVELS} - z AS INT)))"


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))


def event_levels(df: DataFrame, value: str, keys: tuple[str, ...] = (), step: int = 1) -> DataFrame:
    return pyramid.pyramid(pyramid.bins(df, "pos", value, BASE, keys), LEVELS, step, keys)


# ---- pyramids


@query("pyramid_1d_sum", f"SELECT z, {_BIN} AS bin, count(*) AS n, round(sum(value), 4) AS sum FROM ({_UP} {_E}) GROUP BY ALL")
def pyramid_1d_sum(spark, sf):
    return rounded(event_levels(events(spark, sf), "value").select("z", "bin", "n", "sum"), "sum")


@query("pyramid_1d_minmax", f"SELECT z, {_BIN} AS bin, count(*) AS n, min(value) AS min, max(value) AS max FROM ({_UP} {_E}) GROUP BY ALL")
def pyramid_1d_minmax(spark, sf):
    return event_levels(events(spark, sf), "value").select("z", "bin", "n", "min", "max")


@query("pyramid_1d_mean_nan", f"SELECT z, {_BIN} AS bin, count(*) - count(v) AS n_missing, round(round(sum(v), 2) / count(v), 9) AS mean FROM ({_UP} {_GAPS}) GROUP BY ALL")
def pyramid_1d_mean_nan(spark, sf):
    levels = rounded(event_levels(gappy(spark, sf), "v"), "sum", digits=2)  # one sum for one quotient, whatever the order
    return levels.select("z", "bin", "n_missing", F.round(pyramid.mean(), 9).alias("mean"))


for _name, _policy, _sql in (
    ("pyramid_nansum_keep", "keep", "sum(v)"),
    ("pyramid_nansum_zero", "zero", "coalesce(sum(v), 0)"),
    ("pyramid_zero_to_nan", "zero_to_missing", "nullif(sum(v), 0)"),
    ("pyramid_propagate", "propagate", "CASE WHEN bool_or(v IS NULL) THEN NULL ELSE sum(v) END"),
):
    query(_name, f"SELECT event_type, pos // 1800 AS bin, round({_sql}, 4) AS value FROM {_GAPS} GROUP BY ALL")(
        lambda spark, sf, p=_policy: rounded(pyramid.summed(gappy(spark, sf), "pos", "v", 1800, p, ("event_type",)), "value")
    )


@query("pyramid_zoom_step_reaggregate", f"SELECT 2 AS z, pos // ({BASE} * 16) AS bin, count(*) AS n, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM {_E} GROUP BY ALL")
def pyramid_zoom_step_reaggregate(spark, sf):
    stored = event_levels(events(spark, sf), "value", step=3)
    return rounded(pyramid.read_level(stored, 2, [0, 3, 6]).select("z", "bin", "n", "sum", "min", "max"), "sum")


@query("pyramid_tile", f"SELECT pos // ({BASE} * 4) - 32 AS bin, count(*) AS n, round(sum(value), 4) AS sum FROM {_E} WHERE pos // ({BASE} * 4) >= 32 AND pos // ({BASE} * 4) < 64 GROUP BY ALL")
def pyramid_tile(spark, sf):
    return rounded(pyramid.tile(event_levels(events(spark, sf), "value"), 4, 1, 32, list(range(LEVELS + 1))).select("bin", "n", "sum"), "sum")


@query("hitile_triple", f"SELECT event_type, z, {_BIN} AS bin, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM ({_UP} {_E}) GROUP BY ALL")
def hitile_triple(spark, sf):
    return rounded(event_levels(events(spark, sf), "value", ("event_type",)).select("event_type", "z", "bin", "sum", "min", "max"), "sum")


_CLIP = "FROM (SELECT unnest(range(a // 64, (b - 1) // 64 + 1)) AS bin, * FROM (SELECT o_custkey AS a, o_custkey + 50 AS b, o_totalprice AS v FROM orders))"
_LEN = "(least(b, (bin + 1) * 64) - greatest(a, bin * 64))"


@query("bedgraph_interval_bins", f"SELECT bin, CAST(sum({_LEN}) AS BIGINT) AS n, round(sum(v * {_LEN}), 2) AS sum, min(v) AS min, max(v) AS max {_CLIP} GROUP BY ALL")
def bedgraph_interval_bins(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + 50).alias("b"), F.col("o_totalprice").alias("v"))
    return rounded(pyramid.interval_bins(df, "a", "b", "v", 64).select("bin", "n", "sum", "min", "max"), "sum", digits=2)


@query("signal_whisker", f"SELECT event_type, pos // 86400 AS bin, min(value) AS min, max(value) AS max, round(avg(value), 9) AS mean, round(stddev_pop(value), 7) AS std FROM {_E} GROUP BY ALL")
def signal_whisker(spark, sf):
    return rounded(signal.window_summary(events(spark, sf), "pos", "value", 86400, "whisker", ("event_type",)), "mean", digits=9).withColumn("std", F.round("std", 7))


@query("signal_std", f"SELECT pos // 43200 AS bin, round(stddev_pop(value), 7) AS std FROM {_E} GROUP BY ALL")
def signal_std(spark, sf):
    return rounded(signal.window_summary(events(spark, sf), "pos", "value", 43200, "std"), "std", digits=7)


@query("signal_minmax", f"SELECT pos // 43200 AS bin, min(value) AS min, max(value) AS max FROM {_E} GROUP BY ALL")
def signal_minmax(spark, sf):
    return signal.window_summary(events(spark, sf), "pos", "value", 43200, "minMax")


@query(
    "signal_interleaved",
    f"WITH s AS (SELECT pos // 86400 AS bin, min(value) AS lo, max(value) AS hi FROM {_E} GROUP BY ALL), g AS (SELECT unnest(range(0, 32)) AS bin) "
    "SELECT 2 * g.bin AS position, s.lo AS value FROM g LEFT JOIN s USING (bin) UNION ALL SELECT 2 * g.bin + 1, s.hi FROM g LEFT JOIN s USING (bin)",
)
def signal_interleaved(spark, sf):
    return signal.interleaved(signal.window_summary(events(spark, sf), "pos", "value", 86400, "minMax"), "minMax", 32)


@query("value_extent", "SELECT min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice FROM lineitem")
def value_extent(spark, sf):
    return pyramid.extent(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query(
    "sparse_bins_2d",
    "SELECT l_partkey // 256 AS tile_l_partkey, l_suppkey // 64 AS tile_l_suppkey, ((l_partkey * 16) // 256) % 16 AS bin_l_partkey, ((l_suppkey * 16) // 64) % 16 AS bin_l_suppkey, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_tax), 4) AS l_tax FROM lineitem GROUP BY ALL",
)
def sparse_bins_2d(spark, sf):
    df = pyramid.sparse_bins(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], ["l_quantity", "l_tax"], [256, 64], 16)
    return rounded(rounded(df, "l_quantity", digits=2), "l_tax")


# ---- coordinates


def nation_axis(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    return coords.with_offsets(nation.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("chrom"), (F.length("n_name") * 100).cast("long").alias("size")))


_AXIS = "(SELECT n_nationkey AS ord, n_name AS chrom, CAST(length(n_name) * 100 AS BIGINT) AS size, CAST(coalesce(sum(length(n_name) * 100) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offs FROM nation)"


@query("segments_offsets", f'SELECT ord, chrom, size, offs AS "offset" FROM {_AXIS}')
def segments_offsets(spark, sf):
    return nation_axis(spark, sf)


@query("segment_to_absolute", f"SELECT c_custkey, offs + c_custkey % 500 AS abs_pos FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN {_AXIS} a ON a.chrom = n_name")
def segment_to_absolute(spark, sf):
    df = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    df = df.select("c_custkey", F.col("n_name").alias("chrom"), (F.col("c_custkey") % 500).alias("pos"))
    return coords.to_absolute(df, nation_axis(spark, sf), abs_pos="pos").select("c_custkey", "abs_pos")


@query(
    "abs_to_segments",
    f"WITH a AS {_AXIS}, b AS (SELECT *, CASE WHEN ord = (SELECT max(ord) FROM a) THEN 4611686018427387903 ELSE offs + size END AS e FROM a), q AS (SELECT o_orderkey, o_custkey % 20000 AS s, o_custkey % 20000 + 900 AS t FROM orders) "
    "SELECT o_orderkey, ord, chrom, greatest(s, offs) - offs AS seg_start, least(t, e) - offs AS seg_end FROM q JOIN b ON offs < t AND e > s",
)
def abs_to_segments(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 20000).alias("start")).withColumn("end", F.col("start") + 900)
    return coords.absolute_to_segments(df, nation_axis(spark, sf)).select("o_orderkey", "ord", "chrom", "seg_start", "seg_end")


@query("unknown_segments", "SELECT event_type, count(*) AS n_rows FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def unknown_segments(spark, sf):
    return coords.unknown_segments(table(spark, sf, "events"), coords.segments(spark, [("click", 10), ("view", 10)]), "event_type")


@query(
    "natural_sort",
    "WITH t AS (SELECT DISTINCT CASE WHEN o_custkey % 30 < 23 THEN 'chr' || (o_custkey % 30) WHEN o_custkey % 30 = 23 THEN 'chrX' WHEN o_custkey % 30 = 24 THEN 'chrY' WHEN o_custkey % 30 = 25 THEN 'chrM' ELSE 'chrUn_' || (o_custkey % 30) END AS chrom FROM orders) "
    "SELECT chrom, row_number() OVER (ORDER BY chrom LIKE '%\\_%' ESCAPE '\\', CASE lower(substr(chrom, 4)) WHEN 'x' THEN 1 WHEN 'y' THEN 2 WHEN 'm' THEN 3 ELSE CASE WHEN regexp_matches(chrom, '^chr[0-9]+$') THEN 0 ELSE 4 END END, coalesce(try_cast(substr(chrom, 4) AS BIGINT), 0), lower(substr(chrom, 4))) AS place FROM t",
)
def natural_sort(spark, sf):
    from pyspark.sql import Window

    k = F.col("o_custkey") % 30
    chrom = F.when(k < 23, F.concat(F.lit("chr"), k.cast("string"))).when(k == 23, "chrX").when(k == 24, "chrY").when(k == 25, "chrM").otherwise(F.concat(F.lit("chrUn_"), k.cast("string")))
    names = table(spark, sf, "orders").select(chrom.alias("chrom")).distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy(coords.natural_key(F.col("chrom")))).cast("long"))


@query(
    "tile_id_parse",
    "SELECT o_orderkey, 'u' || (o_custkey % 3) AS uuid, CAST(o_custkey % 7 AS INT) AS z, o_custkey % 11 AS x, o_custkey % 13 AS y, CASE WHEN o_custkey % 2 = 0 THEN 'default' ELSE 'KR' END AS mode, CASE WHEN o_custkey % 5 = 0 THEN '1:20' END AS cos FROM orders",
)
def tile_id_parse(spark, sf):
    k = F.col("o_custkey")
    s = lambda c: c.cast("string")
    tid = F.concat(F.lit("u"), s(k % 3), F.when(k % 5 == 0, "|cos:1-20").otherwise(""), F.lit("."), s(k % 7), F.lit("."), s(k % 11), F.lit("."), s(k % 13), F.when(k % 2 == 0, "").otherwise(".KR"))
    p = table(spark, sf, "orders").select("o_orderkey", tileid.parsed(tid, 2).alias("p"))
    return p.select("o_orderkey", "p.uuid", "p.z", "p.x", "p.y", "p.mode", F.replace(F.try_element_at("p.options", F.lit("cos")), F.lit("-"), F.lit(":")).alias("cos"))


_LNG, _LAT = "(o_custkey % 3600) / 10.0 - 180", "(o_orderkey % 1600) / 10.0 - 80"


def places(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", ((F.col("o_custkey") % 3600) / 10.0 - 180).alias("lng"), ((F.col("o_orderkey") % 1600) / 10.0 - 80).alias("lat"))


@query("mercator_tiles", f"SELECT o_orderkey, round(64 * (({_LNG}) + 180) / 360, 6) AS x, round(64 * (pi() - ln(tan((radians({_LAT}) + pi() / 2) / 2))) / (2 * pi()), 6) AS y FROM orders")
def mercator_tiles(spark, sf):
    x, y = coords.mercator(F.col("lng"), F.col("lat"), 6)
    return places(spark, sf).select("o_orderkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("mercator_round_trip", f"SELECT o_orderkey, round({_LNG}, 6) AS lng, round({_LAT}, 6) AS lat FROM orders")
def mercator_round_trip(spark, sf):
    x, y = coords.mercator(F.col("lng"), F.col("lat"), 6)
    lng, lat = coords.inverse_mercator(F.col("x"), F.col("y"), 6)
    return places(spark, sf).withColumns({"x": x, "y": y}).select("o_orderkey", (F.round(lng, 6) + 0.0).alias("lng"), (F.round(lat, 6) + 0.0).alias("lat"))


_RB = " UNION ALL ".join(f"SELECT o_orderkey, unnest(range({a} + (s >> {b}), {a} + ((e - 1) >> {b}) + 1)) AS bin FROM q" for a, b in coords.BIN_LEVELS)


@query("reg2bins", f"WITH q AS (SELECT o_orderkey, o_custkey * 9973 AS s, o_custkey * 9973 + 30000 AS e FROM orders) {_RB}")
def reg2bins(spark, sf):
    q = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") * 9973).alias("s")).withColumn("e", F.col("s") + 30000)
    return q.select("o_orderkey", F.explode(coords.region_bins(F.col("s"), F.col("e"))).alias("bin"))


@query(
    "query_size_guard",
    "WITH c AS (SELECT n_name AS chrom, 4681 + s_suppkey % 200 AS bin, CAST(sum(s_suppkey * 100) AS BIGINT) AS n_bytes FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL), "
    "r AS (SELECT c_custkey AS region, n_name AS chrom, c_custkey * 1000 AS s, c_custkey * 1000 + 50000 AS e FROM customer JOIN nation ON c_nationkey = n_nationkey), "
    "b AS (SELECT region, chrom, unnest(range(4681 + (s >> 14), 4681 + ((e - 1) >> 14) + 1)) AS bin FROM r) "
    "SELECT region, CAST(coalesce(sum(n_bytes), 0) AS BIGINT) AS n_bytes, coalesce(sum(n_bytes), 0) > 5000 AS too_large FROM b LEFT JOIN c USING (chrom, bin) GROUP BY region",
)
def query_size_guard(spark, sf):
    nation = F.broadcast(table(spark, sf, "nation"))
    s = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    chunks = s.groupBy(F.col("n_name").alias("chrom"), (4681 + F.col("s_suppkey") % 200).alias("bin")).agg(F.sum(F.col("s_suppkey") * 100).alias("n_bytes"))
    c = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    regions = c.select(F.col("c_custkey").alias("region"), F.col("n_name").alias("chrom"), (F.col("c_custkey") * 1000).alias("start")).withColumn("end", F.col("start") + 50000)
    return sequences.query_size(regions, chunks).withColumn("too_large", F.col("n_bytes") > 5000)


# ---- intervals and placement


def order_intervals(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("startPos"), (F.col("o_custkey") + F.col("o_orderkey") % 97).alias("endPos"), (F.col("o_orderkey") % 4).cast("int").alias("zoomLevel"), F.col("o_totalprice").alias("importance"))


def order_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("uid"), F.col("o_custkey").alias("fromX"), (F.col("o_custkey") + k % 97).alias("toX"), (k % 1500).alias("fromY"), (k % 1500 + k % 61).alias("toY"), (k % 4).cast("int").alias("zoomLevel"), F.col("o_totalprice").alias("importance"))


_OI = "(SELECT o_orderkey AS uid, o_custkey AS a, o_custkey + o_orderkey % 97 AS b, o_orderkey % 4 AS zl, o_totalprice AS importance FROM orders)"
_OR = "(SELECT o_orderkey AS uid, o_custkey AS a, o_custkey + o_orderkey % 97 AS b, o_orderkey % 1500 AS c, o_orderkey % 1500 + o_orderkey % 61 AS d, o_orderkey % 4 AS zl, o_totalprice AS importance FROM orders)"


@query(
    "tile_intervals_1d",
    f"SELECT 't.' || z || '.' || x AS tile_id, uid FROM {_OI} JOIN (SELECT z, x, 32768 // (1 << z) AS w FROM (VALUES (2, 0), (5, 0), (5, 1), (7, 3), (7, 4)) AS t(z, x)) ON a < (x + 1) * w AND b >= x * w AND zl <= z",
)
def tile_intervals_1d(spark, sf):
    ids = ["t.2.0", "t.5.0", "t.5.1", "t.7.3", "t.7.4"]
    return intervals.tile_intervals(order_intervals(spark, sf), tileid.requests(spark, ids), 32768).select("tile_id", "uid")


@query(
    "tile_rectangles_2d",
    f"SELECT 't.' || z || '.' || x || '.' || y AS tile_id, uid FROM {_OR} JOIN (SELECT z, x, y, 32768 // (1 << z) AS w FROM (VALUES (5, 0, 0), (6, 1, 0), (7, 2, 3)) AS t(z, x, y)) ON a < (x + 1) * w AND b >= x * w AND c < (y + 1) * w AND d >= y * w AND zl <= z",
)
def tile_rectangles_2d(spark, sf):
    ids = ["t.5.0.0", "t.6.1.0", "t.7.2.3"]
    return intervals.tile_rectangles(order_rectangles(spark, sf), tileid.requests(spark, ids, 2), 32768).select("tile_id", "uid")


@query("list_items_topn", f"SELECT uid, a AS \"startPos\", b AS \"endPos\" FROM {_OI} WHERE a < 500 AND b >= 100 ORDER BY a, uid LIMIT 100")
def list_items_topn(spark, sf):
    return intervals.list_items(order_intervals(spark, sf), 100, 500, 100).select("uid", "startPos", "endPos")


@query("interval_1d_over_2d_union", f"SELECT DISTINCT uid, a AS \"fromX\", c AS \"fromY\" FROM {_OR} WHERE (a < 300 AND b >= 200) OR (c < 300 AND d >= 200)")
def interval_1d_over_2d_union(spark, sf):
    return intervals.either_axis(order_rectangles(spark, sf), 200, 300).select("uid", "fromX", "fromY")


@query(
    "arcs_topk",
    f"WITH s AS (SELECT uid, importance, unnest(range(greatest(a // 64, 8), least(b // 64, 15) + 1)) AS subtile FROM {_OR} WHERE a < 1024 AND b >= 512 UNION ALL SELECT uid, importance, unnest(range(greatest(c // 64, 8), least(d // 64, 15) + 1)) FROM {_OR} WHERE c < 1024 AND d >= 512), "
    "u AS (SELECT DISTINCT subtile, uid, importance FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY subtile ORDER BY importance DESC, uid) AS rank FROM u) SELECT subtile, uid, rank FROM k WHERE rank <= 25",
)
def arcs_topk(spark, sf):
    return intervals.arcs(order_rectangles(spark, sf), 1, 0, 512).select("subtile", "uid", F.col("rank").cast("long").alias("rank"))


@query(
    "place_points_levels",
    "WITH r0 AS (SELECT p_partkey, p_retailprice AS imp FROM part), "
    + ", ".join(
        f"a{z} AS (SELECT *, row_number() OVER (PARTITION BY p_partkey // {256 << (3 - z)} ORDER BY imp DESC, p_partkey) AS rk FROM r{z}), r{z + 1} AS (SELECT p_partkey, imp FROM a{z} WHERE rk > 40)"
        for z in range(4)
    )
    + " "
    + " UNION ALL ".join(f'SELECT p_partkey, {z} AS "zoomLevel" FROM a{z} WHERE rk <= 40' for z in range(4)),
)
def place_points_levels(spark, sf):
    items = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("importance"))
    return placement.place_points(items, "p_partkey", 256, 3, 40, ("p_partkey",)).select("p_partkey", "zoomLevel")


def _greedy(source: str, tiles: Callable[[int], str], deepest: int, cap: int) -> str:
    """SQL of the sequential rule, as a fold over the items of each level by falling importance.

    tiles(z): the columns x0, x1, y0, y1 of an item's tiles, at least 0; none if x1 < x0. A tile holds `cap` items.
    """
    steps = [f"r0 AS (SELECT * FROM {source})"]
    for z in range(deepest + 1):
        steps.append(f"t{z} AS (SELECT uid, importance, CAST(x0 AS INT) AS x0, CAST(x1 AS INT) AS x1, CAST(y0 AS INT) AS y0, CAST(y1 AS INT) AS y1 FROM (SELECT uid, importance, {tiles(z)} FROM r{z}))")
        steps.append(f"w{z} AS (SELECT coalesce(greatest(max(x0), max(x1)), 0) + 1 AS w, (coalesce(greatest(max(x0), max(x1)), 0) + 1) * (coalesce(max(y1), 0) + 1) AS n FROM t{z})")
        inside = "((i - 1) % x.w BETWEEN x.x0 AND x.x1 AND (i - 1) // x.w BETWEEN x.y0 AND x.y1)"
        fits = f"len(list_filter(list_transform(s.used, lambda v, i: CASE WHEN {inside} THEN v ELSE 0 END), lambda v: v >= {cap})) = 0"
        step = f"CASE WHEN {fits} THEN {{'used': list_transform(s.used, lambda v, i: CASE WHEN {inside} THEN v + 1 ELSE v END), 'placed': list_append(s.placed, x.uid)}} ELSE s END"
        items = "list({'uid': uid, 'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1, 'w': w} ORDER BY importance DESC, uid)"
        start = "{'used': list_resize([0], CAST(n AS INT), 0), 'placed': []::BIGINT[]}"
        steps.append(f"f{z} AS (SELECT list_reduce(l, lambda s, x: {step}, {start}) AS s FROM (SELECT {items} AS l, any_value(n) AS n FROM t{z}, w{z}) WHERE l IS NOT NULL)")
        steps.append(f"p{z} AS (SELECT unnest(s.placed) AS uid FROM f{z})")
        steps.append(f"r{z + 1} AS (SELECT * FROM r{z} WHERE uid NOT IN (SELECT uid FROM p{z}))")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f'SELECT uid, {z} AS "zoomLevel" FROM p{z}' for z in range(deepest + 1))


@query("place_intervals_greedy", _greedy(_OI, lambda z: f"a // {256 << (4 - z)} AS x0, a // {256 << (4 - z)} + CAST(ceil((b - a) / {float(256 << (4 - z))}) AS BIGINT) - 1 AS x1, 0 AS y0, 0 AS y1", 4, 60))
def place_intervals_greedy(spark, sf):
    placed, _ = placement.place_intervals(order_intervals(spark, sf).drop("zoomLevel"), 256, 4, 60)
    return placed.select("uid", "zoomLevel")


@query("place_rectangles_greedy", _greedy(_OR, lambda z: f"a // {256 << (3 - z)} AS x0, b // {256 << (3 - z)} AS x1, c // {256 << (3 - z)} AS y0, d // {256 << (3 - z)} AS y1", 3, 61))
def place_rectangles_greedy(spark, sf):
    placed, _ = placement.place_rectangles(order_rectangles(spark, sf).drop("zoomLevel"), 256, 3, 60)
    return placed.select("uid", "zoomLevel")


for _name, _reverse, _dir in (("topk_per_tile", False, "DESC"), ("topk_per_tile_reverse", True, "ASC")):
    query(_name, f"WITH k AS (SELECT l_partkey // 100 AS tile, l_suppkey AS s_key, {'min' if _reverse else 'max'}(l_extendedprice) AS importance FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY importance {_dir}, s_key) AS rank FROM k) SELECT tile, s_key, importance, rank FROM r WHERE rank <= 5")(
        lambda spark, sf, r=_reverse: placement.top_per_tile(
            table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").alias("s_key"), F.col("l_extendedprice").alias("importance")), coords.floor_div(F.col("l_partkey"), 100), 5, ("s_key",), reverse=r
        ).withColumn("rank", F.col("rank").cast("long"))
    )


@query("bedlike_size_importance", "SELECT o_orderkey, CAST(greatest(abs(o_orderkey % 97 - 40), abs(o_orderkey % 61)) AS DOUBLE) AS importance FROM orders")
def bedlike_size_importance(spark, sf):
    k = F.col("o_orderkey")
    df = table(spark, sf, "orders").select("o_orderkey", F.lit(40).alias("a"), (k % 97).alias("b"), F.lit(0).alias("c"), (k % 61).alias("d"))
    return df.select("o_orderkey", coords.size_importance(("a", "b"), ("c", "d")).alias("importance"))


@query("chrom_filter", "SELECT event_id, value FROM events WHERE event_type = 'click'")
def chrom_filter(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type") == "click").select("event_id", "value")


@query("range_expansion", "SELECT bin, count(*) AS n FROM (SELECT unnest(range(o_custkey, o_custkey + o_orderkey % 97 + 1)) AS bin FROM orders) GROUP BY 1")
def range_expansion(spark, sf):
    return order_intervals(spark, sf).select(F.explode(intervals.tiles_of(F.col("startPos"), F.col("endPos"), 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("importance_replace_left_join", "SELECT c_custkey, coalesce(s, 0.0) AS importance FROM customer LEFT JOIN (SELECT s_suppkey AS c_custkey, max(s_acctbal) AS s FROM supplier GROUP BY 1) USING (c_custkey)")
def importance_replace_left_join(spark, sf):
    own = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("importance"))
    items = table(spark, sf, "customer").select("c_custkey", F.lit(0.0).alias("importance"))
    return annotations.replaced_importance(items, own, "c_custkey")


@query("citation_counts_join", "SELECT p_partkey, count(DISTINCT l_suppkey) AS citations FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1")
def citation_counts_join(spark, sf):
    cited = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return annotations.citation_counts(table(spark, sf, "part").select("p_partkey"), cited, "p_partkey")


@query(
    "exon_union_islands",
    'WITH t AS (SELECT c_nationkey AS g, o_custkey AS s, o_custkey + o_orderkey % 97 AS e FROM orders JOIN customer ON o_custkey = c_custkey), m AS (SELECT *, max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t), '
    'i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT g, min(s) AS "txStart", max(e) AS "txEnd", count(*) AS n_transcripts FROM i GROUP BY g, k',
)
def exon_union_islands(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    t = o.select(F.col("c_nationkey").alias("g"), F.col("o_custkey").alias("txStart"), (F.col("o_custkey") + F.col("o_orderkey") % 97).alias("txEnd"))
    t = t.withColumn("exonStarts", F.array("txStart")).withColumn("exonEnds", F.array("txEnd"))
    return annotations.exon_unions(t, ("g",)).select("g", "txStart", "txEnd", "n_transcripts")


@query("sortedness_violations", "SELECT event_id FROM (SELECT event_id, user_id, lag(user_id) OVER (ORDER BY event_id) AS b FROM events) WHERE b > user_id")
def sortedness_violations(spark, sf):
    return annotations.unsorted_rows(table(spark, sf, "events").select("event_id", "user_id"), ("event_id",), ("user_id",)).select("event_id")


@query("triangularity_violations", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey > l_partkey")
def triangularity_violations(spark, sf):
    return annotations.below_diagonal(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey").select("l_orderkey", "l_partkey", "l_suppkey")


@query("canonical_pairs", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem GROUP BY ALL")
def canonical_pairs(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return df.select(*intervals.canonical_pair("a", "b")).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("ignore_zero", "SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem WHERE l_discount <> 0")
def ignore_zero(spark, sf):
    return intervals.nonzero(table(spark, sf, "lineitem"), "l_discount").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")


@query("starting_rows", f"SELECT event_id, pos FROM {_E} WHERE pos >= 100000 AND pos <= 200000")
def starting_rows(spark, sf):
    return intervals.starting_rows(events(spark, sf), 100_000, 200_000, "pos").select("event_id", "pos")


@query("genome_sorted", f"SELECT c_custkey, offs + c_custkey % 500 AS abs_start FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN {_AXIS} a ON a.chrom = n_name")
def genome_sorted(spark, sf):
    df = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    df = df.select("c_custkey", F.col("n_name").alias("chrom"), (F.col("c_custkey") % 500).alias("start"))
    return intervals.genome_sorted(df, nation_axis(spark, sf)).select("c_custkey", "abs_start")


# ---- vectors


_HOT = f"(SELECT 'all' AS chrom, pos // 3600 AS bin, k AS row, CAST(event_type = s AS DOUBLE) AS value FROM {_E}, (VALUES " + ", ".join(f"('{s}', {k})" for k, s in enumerate(TYPES)) + ") AS t(s, k))"


def state_vectors(spark: SparkSession, sf: str) -> DataFrame:
    hot = multivec.one_hot(events(spark, sf), "event_type", list(TYPES))
    return hot.select(F.lit("all").alias("chrom"), coords.floor_div(F.col("pos"), 3600).alias("bin"), "row", "value")


@query("multivec_states_onehot", f"SELECT bin, row, sum(value) AS value FROM {_HOT} GROUP BY ALL")
def multivec_states_onehot(spark, sf):
    return state_vectors(spark, sf).groupBy("bin", "row").agg(F.sum("value").alias("value"))


@query("multivec_halving_sum", f"SELECT k, bin // (1 << CAST(k AS INT)) AS bin, row, sum(value) AS value FROM (SELECT CAST(unnest(range(0, 6)) AS INT) AS k, * FROM {_HOT}) GROUP BY ALL")
def multivec_halving_sum(spark, sf):
    return multivec.halving(state_vectors(spark, sf), 5).drop("chrom")


_SIG = f"(SELECT event_type AS chrom, pos // 3600 AS bin, 0 AS row, value / 100 AS value FROM {_E})"


def typed_signal(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(F.col("event_type").alias("chrom"), coords.floor_div(F.col("pos"), 3600).alias("bin"), F.lit(0).alias("row"), (F.col("value") / 100).alias("value"))


@query(
    "multivec_logsumexp",
    f"WITH u AS (SELECT k, chrom, bin // (1 << CAST(k AS INT)) AS bin, row, value FROM (SELECT CAST(unnest(range(0, 4)) AS INT) AS k, * FROM {_SIG})), m AS (SELECT k, chrom, bin, row, max(value) AS m FROM u GROUP BY ALL) SELECT k, chrom, bin, row, round(any_value(m) + ln(sum(exp(value - m))), 6) AS value FROM u JOIN m USING (k, chrom, bin, row) GROUP BY ALL",
)
def multivec_logsumexp(spark, sf):
    return rounded(multivec.halving(typed_signal(spark, sf), 3, "logsumexp"), "value", digits=6)


@query("epilogos_vector", "SELECT event_id, unnest([0, 1]) AS row, unnest([round(value, 4), CAST(event_id % 10 AS DOUBLE)]) AS value FROM events")
def epilogos_vector(spark, sf):
    line = F.format_string("chr1\t0\t200\tid:%d,qcat:[[%d.0,2],[%s,1]]", F.col("event_id"), F.col("event_id") % 10, F.round("value", 4).cast("string"))
    return table(spark, sf, "events").select("event_id", F.posexplode(multivec.epilogos_vector(line)).alias("row", "value"))


@query("default_vector", "SELECT event_id, unnest([0, 1]) AS row, unnest([CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value, 4) END, CAST(user_id AS DOUBLE)]) AS value FROM events")
def default_vector(spark, sf):
    v = F.when(F.col("event_id") % 3 == 0, "NA").otherwise(F.round("value", 4).cast("string"))
    f = F.array(F.lit("chr1"), F.lit("0"), F.lit("10"), v, F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", F.posexplode(multivec.default_vector(f, 4)).alias("row", "value"))


@query("zip_files", "SELECT user_id AS chrom, min(CASE WHEN event_type = 'click' THEN value END) AS v0, min(CASE WHEN event_type = 'view' THEN value END) AS v1 FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def zip_files(spark, sf):
    e = table(spark, sf, "events")
    part = lambda t: e.where(F.col("event_type") == t).groupBy(F.col("user_id").alias("chrom")).agg(F.min("value").alias("value")).select("chrom", F.lit(0).alias("start"), F.lit(1).alias("end"), "value")
    z = multivec.zipped([part("click"), part("view")])
    return z.select("chrom", F.get("vector", F.lit(0)).alias("v0"), F.get("vector", F.lit(1)).alias("v1"))


# ---- matrices


_CELLS = "(SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"


def nation_cells(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n, *c: table(spark, sf, n).select(*c)
    df = t("lineitem", "l_orderkey", "l_suppkey").join(t("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = df.join(t("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return df.groupBy(F.col("c_nationkey").cast("long").alias("i"), F.col("s_nationkey").cast("long").alias("j")).agg(F.count("*").cast("double").alias("value"))


def _weights(cells: DataFrame) -> DataFrame:
    rows = cells.groupBy(F.col("i").alias("bin_id")).agg(F.sum("value").alias("s"))
    return rows.select("bin_id", F.round(1 / F.sqrt("s"), 6).alias("weight"), F.round(F.sqrt("s") / 10, 6).alias("KR"))


_PIX = f"(SELECT i AS bin1, j AS bin2, value AS c FROM {_CELLS} WHERE i <= j)"
_WGT = f"(SELECT i AS b, round(1 / sqrt(sum(value)), 6) AS w, round(sqrt(sum(value)) / 10, 6) AS kr FROM {_CELLS} GROUP BY i)"


def nation_contacts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cells = nation_cells(spark, sf)
    return cells.where("i <= j").select(F.col("i").alias("bin1"), F.col("j").alias("bin2"), F.col("value").alias("count")), _weights(cells)


@query("matrix_coarsen_2x2", f"SELECT i // 2 AS i, j // 2 AS j, sum(value) AS value FROM {_CELLS} GROUP BY ALL")
def matrix_coarsen_2x2(spark, sf):
    return matrix.coarsen(nation_cells(spark, sf))


@query("matrix_pyramid", f"SELECT z, i // (1 << CAST(3 - z AS INT)) AS i, j // (1 << CAST(3 - z AS INT)) AS j, sum(value) AS value FROM (SELECT CAST(unnest(range(0, 4)) AS INT) AS z, * FROM {_CELLS}) GROUP BY ALL")
def matrix_pyramid(spark, sf):
    return pyramid.matrix_pyramid(nation_cells(spark, sf), 3)


@query("matrix_block_tile", f"SELECT (i - 0) // 2 AS i, (j - 16) // 2 AS j, sum(value) AS value FROM {_CELLS} WHERE i < 16 AND j >= 16 AND j < 32 GROUP BY ALL")
def matrix_block_tile(spark, sf):
    return matrix.block_tile(nation_cells(spark, sf), 1, 1, 0, 2, 8)


@query("vector_block_mean", "SELECT l_partkey // 16 AS bin, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1")
def vector_block_mean(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("idx"), F.col("l_quantity").alias("value"))
    return rounded(matrix.vector_blocks(df, 16), "value", digits=6)


@query("contacts_balanced", f"SELECT bin1, bin2, round(c * x.w * y.w, 6) AS value FROM {_PIX} JOIN {_WGT} x ON bin1 = x.b JOIN {_WGT} y ON bin2 = y.b")
def contacts_balanced(spark, sf):
    return rounded(matrix.balanced(*nation_contacts(spark, sf)), "value", digits=6)


@query("contacts_kr", f"SELECT bin1, bin2, round(c / x.kr / y.kr, 6) AS value FROM {_PIX} JOIN {_WGT} x ON bin1 = x.b JOIN {_WGT} y ON bin2 = y.b")
def contacts_kr(spark, sf):
    return rounded(matrix.balanced(*nation_contacts(spark, sf), "KR"), "value", digits=6)


@query("contacts_raw", f"SELECT bin1, bin2, c AS value FROM {_PIX}")
def contacts_raw(spark, sf):
    return matrix.balanced(*nation_contacts(spark, sf), "none")


@query("contacts_tile_mirrored", f"WITH m AS (SELECT bin1, bin2, c FROM {_PIX} UNION ALL SELECT bin2, bin1, c FROM {_PIX} WHERE bin1 <> bin2) SELECT bin1 - 8 AS i, bin2 AS j, c AS value FROM m WHERE bin1 >= 8 AND bin1 < 16 AND bin2 < 8")
def contacts_tile_mirrored(spark, sf):
    return matrix.contact_tile(*nation_contacts(spark, sf), 0, 1, 8, "none")


@query("masked_axis", f"SELECT CAST(g - 16 AS BIGINT) AS position FROM (SELECT unnest(range(16, 32)) AS g) LEFT JOIN {_WGT} ON g = b WHERE w IS NULL")
def masked_axis(spark, sf):
    return matrix.masked_axis(nation_contacts(spark, sf)[1], "weight", 16, 32)


@query("transforms_intersection", "SELECT unnest(['weight', 'KR']) AS transform")
def transforms_intersection(spark, sf):
    _, bins = nation_contacts(spark, sf)
    return spark.createDataFrame([(t,) for t in matrix.common_transforms([bins, bins.withColumn("VC", F.lit(1.0))])], "transform string")


@query("filled_tiles", f"SELECT z, j // (4 * (1 << CAST(3 - z AS INT))) AS x, i // (4 * (1 << CAST(3 - z AS INT))) AS y, count(*) AS n FROM (SELECT CAST(unnest(range(0, 4)) AS INT) AS z, * FROM {_CELLS} WHERE i <= j) GROUP BY ALL")
def filled_tiles(spark, sf):
    return matrix.filled_tiles(nation_cells(spark, sf).where("i <= j"), 3, 4)


_NB = "(SELECT n_nationkey AS b, 'r' || n_regionkey AS chrom, n_nationkey * 10 AS s, n_nationkey * 10 + 10 AS e FROM nation)"


@query(
    "region_pixels",
    f"WITH m AS (SELECT bin1, bin2, c FROM {_PIX} UNION ALL SELECT bin2, bin1, c FROM {_PIX} WHERE bin1 <> bin2) SELECT bin1, bin2, c AS count FROM m JOIN {_NB} p ON bin1 = p.b JOIN {_NB} q ON bin2 = q.b WHERE p.chrom = 'r1' AND p.s < 200 AND p.e > 15 AND q.chrom = 'r2' AND q.s < 300 AND q.e > 0",
)
def region_pixels(spark, sf):
    k = F.col("n_nationkey").cast("long")
    bins = table(spark, sf, "nation").select(k.alias("bin_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("chrom"), (k * 10).alias("start"), (k * 10 + 10).alias("end"))
    return matrix.region_pixels(nation_contacts(spark, sf)[0], bins, ("r1", 15, 200), ("r2", 0, 300)).select("bin1", "bin2", "count")


@query("quadtree_children", "SELECT z + 1 AS z, 2 * x + a AS x, 2 * y + b AS y FROM (SELECT CAST(n_regionkey AS BIGINT) AS z, CAST(n_nationkey AS BIGINT) AS x, CAST(n_nationkey % 7 AS BIGINT) AS y FROM nation WHERE n_nationkey % 2 = 0), (VALUES (0), (1)) AS s(a), (VALUES (0), (1)) AS t(b)")
def quadtree_children(spark, sf):
    k = F.col("n_nationkey").cast("long")
    return matrix.children(table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("z"), k.alias("x"), (k % 7).alias("y")), F.col("x") % 2 == 0)


# ---- points and labels


_PTS = "(SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


def _cells_sql(n: int, box: str, where: str = "true") -> str:
    side = lambda v: f"CAST(least(floor(({v} - {v}0) / ({v}1 - {v}0) * {n}), {n - 1}) AS INT)"
    return f"SELECT {side('x')} AS bx, {side('y')} AS by, count(*) AS n FROM {_PTS}, ({box}) WHERE {where} GROUP BY ALL"


@query("density_2d", _cells_sql(32, f"SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {_PTS}"))
def density_2d(spark, sf):
    return points.density(cloud(spark, sf), 32)


_SQ = f"SELECT min(x) AS x0, min(x) + greatest(max(x) - min(x), max(y) - min(y)) / 2 AS x1, min(y) AS y0, min(y) + greatest(max(x) - min(x), max(y) - min(y)) / 2 AS y1 FROM {_PTS}"


@query("density_tile_extent", _cells_sql(16, _SQ, "x > x0 AND x < x1 AND y > y0 AND y < y1"))
def density_tile_extent(spark, sf):
    df = cloud(spark, sf)
    return points.density_tile(df, points.square_extent(df), 1, 0, 0, 16, over="tile")


@query("points_capped", f"SELECT vec_id FROM {_PTS}, ({_SQ}) WHERE x > x0 AND x < x1 AND y > y0 AND y < y1 ORDER BY vec_id LIMIT 30")
def points_capped(spark, sf):
    df = cloud(spark, sf)
    return points.capped_points(df, points.square_extent(df), 1, 0, 0, ("vec_id",)).select("vec_id")


def part_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("label"), F.col("p_retailprice").alias("importance"))


@query("labels_importance", "SELECT p_partkey AS idx, p_name AS label FROM part WHERE p_partkey >= 20 AND p_partkey < 180 ORDER BY p_retailprice DESC, p_partkey LIMIT 16")
def labels_importance(spark, sf):
    return points.top_labels(part_labels(spark, sf), 20, 180, 16).select("idx", "label")


@query("labels_linspace", "SELECT p_partkey AS idx, p_name AS label FROM part WHERE p_partkey IN (SELECT 20 + k * 159 // 15 FROM (SELECT unnest(range(0, 16)) AS k))")
def labels_linspace(spark, sf):
    return points.even_labels(part_labels(spark, sf), 20, 180, 16).select("idx", "label")


@query(
    "score_quantile_threshold",
    "WITH s AS (SELECT c_nationkey AS g, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS score FROM orders JOIN customer ON o_custkey = c_custkey), t AS (SELECT g, count(*) AS n FROM s GROUP BY g), "
    "q AS (SELECT s.g, n, list(score ORDER BY score) AS l FROM s JOIN t ON s.g = t.g GROUP BY s.g, n), p AS (SELECT g, n, l, (1 - 20.0::DOUBLE / n) * (n - 1) AS pt FROM q), "
    "c AS (SELECT g, CASE WHEN n > 20 THEN CAST(floor(l[CAST(floor(pt) AS INT) + 1] + (l[CAST(ceil(pt) AS INT) + 1] - l[CAST(floor(pt) AS INT) + 1]) * (pt - floor(pt))) AS BIGINT) END AS cut FROM p) "
    "SELECT s.g, o_orderkey, score FROM s JOIN c ON s.g = c.g WHERE cut IS NULL OR score >= cut",
)
def score_quantile_threshold(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    s = o.select(F.col("c_nationkey").alias("g"), "o_orderkey", F.floor("o_totalprice").cast("long").alias("score"))
    return points.score_threshold(s, ("g",), "score", 20).select("g", "o_orderkey", "score")


@query("sampled_items")
def sampled_items(spark, sf):
    return points.sampled(table(spark, sf, "events").select("event_id", "event_type"), ("event_type",), ("event_id",), 50)


@query(
    "autocomplete_topk",
    "WITH n AS (SELECT lower(n_name) AS s, n_name AS name, n_nationkey AS importance FROM (SELECT regexp_replace(n_name, '[ ./]', '_', 'g') AS q, * FROM nation)), w AS (SELECT lower(regexp_replace(name, '[ ./]', '_', 'g')) AS s, name, importance FROM n), "
    "p AS (SELECT s, name, importance, unnest(range(1, length(s) + 1)) AS i FROM w), u AS (SELECT DISTINCT substr(s, i, k) AS substring, name, importance FROM (SELECT *, unnest(range(1, length(s) - i + 2)) AS k FROM p)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY substring ORDER BY importance DESC, name) AS rank FROM u) SELECT substring, name, importance, rank FROM r WHERE rank <= 10",
)
def autocomplete_topk(spark, sf):
    return points.autocomplete(table(spark, sf, "nation"), "n_name", "n_nationkey").withColumn("rank", F.col("rank").cast("long"))


@query("dictionary_codes", "SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)")
def dictionary_codes(spark, sf):
    return points.dictionary_codes(table(spark, sf, "part"), "p_type")


# ---- features, sequences, alignments


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("uid"), (k % 340 - 170.0).alias("minLng"), (k % 340 - 170.0 + k % 9).alias("maxLng"), (k % 150 - 75.0).alias("minLat"), (k % 150 - 75.0 + k % 7).alias("maxLat"), F.lit(0).alias("zoomLevel"))


_BOX = "(SELECT c_custkey AS uid, CAST(c_custkey % 340 - 170 AS DOUBLE) AS x0, CAST(c_custkey % 340 - 170 + c_custkey % 9 AS DOUBLE) AS x1, CAST(c_custkey % 150 - 75 AS DOUBLE) AS y0, CAST(c_custkey % 150 - 75 + c_custkey % 7 AS DOUBLE) AS y1 FROM customer)"
_MX = lambda v: f"floor(8 * ({v} + 180) / 360)"
_MY = lambda v: f"floor(8 * (pi() - ln(tan((radians({v}) + pi() / 2) / 2))) / (2 * pi()))"


@query("geo_tile_join", f"SELECT 't.3.' || tx || '.' || ty AS tile_id, uid FROM {_BOX} JOIN (VALUES (2, 3), (3, 3), (4, 4)) AS t(tx, ty) ON {_MX('x0')} <= tx AND {_MX('x1')} >= tx AND {_MY('y1')} <= ty AND {_MY('y0')} >= ty")
def geo_tile_join(spark, sf):
    return intervals.tile_features(boxes(spark, sf), tileid.requests(spark, ["t.3.2.3", "t.3.3.3", "t.3.4.4"], 2)).select("tile_id", "uid")


@query("geo_bbox_area", f"SELECT uid, x0 AS \"minLng\", x1 AS \"maxLng\", round((x1 - x0) * (y1 - y0) / 2, 6) AS area FROM {_BOX}")
def geo_bbox_area(spark, sf):
    from .sources.text import ring_area

    b = boxes(spark, sf)
    point = lambda x, y: F.array(F.col(x), F.col(y))
    b = b.withColumn("ring", F.array(point("minLng", "minLat"), point("maxLng", "minLat"), point("maxLng", "maxLat"), point("minLng", "minLat")))
    xs = F.transform("ring", lambda p: F.get(p, F.lit(0)))
    return b.select("uid", F.array_min(xs).alias("minLng"), F.array_max(xs).alias("maxLng"), F.round(ring_area(F.col("ring")), 6).alias("area"))


def _mercator_sql(z: int) -> str:
    x, y = (lambda v: f"floor({1 << z} * ({v} + 180) / 360)"), (lambda v: f"floor({1 << z} * (pi() - ln(tan((radians({v}) + pi() / 2) / 2))) / (2 * pi()))")
    return f"{x('x0')} AS x0, {x('x1')} AS x1, {y('y1')} AS y0, {y('y0')} AS y1"


@query("place_features_greedy", _greedy(f"(SELECT *, uid % 101 AS importance FROM {_BOX})", _mercator_sql, 3, 21))
def place_features_greedy(spark, sf):
    placed, _ = placement.place_features(boxes(spark, sf).drop("zoomLevel").withColumn("importance", F.col("uid") % 101), 3, 20)
    return placed.select("uid", "zoomLevel")


_CIG = "SELECT o_orderkey, o_custkey AS pos, o_orderkey % 5 + 1 AS c, o_orderkey % 40 + 10 AS m, o_orderkey % 7 + 1 AS d FROM orders"


@query("cigar_substitutions", f"SELECT o_orderkey, pos - c AS at, CAST(c AS INT) AS length, 'S' AS op FROM ({_CIG}) UNION ALL SELECT o_orderkey, pos + m, CAST(d AS INT), 'D' FROM ({_CIG}) UNION ALL SELECT o_orderkey, pos + m + d, CAST(c AS INT), 'I' FROM ({_CIG}) UNION ALL SELECT o_orderkey, pos + m + d, CAST(d AS INT), 'X' FROM ({_CIG})")
def cigar_substitutions(spark, sf):
    k = F.col("o_orderkey")
    c, m, d = k % 5 + 1, k % 40 + 10, k % 7 + 1
    cigar = F.format_string("%dS%dM%dD%dI%dX", c, m, d, c, d)
    df = table(spark, sf, "orders").select("o_orderkey", F.explode(alignments.substitutions(cigar, F.col("o_custkey"))).alias("s"))
    return df.select("o_orderkey", F.col("s.pos").alias("at"), "s.length", "s.op")


@query("md_mismatches", "SELECT o_orderkey, o_custkey + o_orderkey % 40 AS at, 'A' AS base FROM orders UNION ALL SELECT o_orderkey, o_custkey + o_orderkey % 40 + 1 + 3 + 2 + 5, 'T' FROM orders")
def md_mismatches(spark, sf):
    md = F.format_string("%dA3^GC5T0", F.col("o_orderkey") % 40)
    df = table(spark, sf, "orders").select("o_orderkey", F.explode(alignments.mismatches(md, F.col("o_custkey"))).alias("v"))
    return df.select("o_orderkey", F.col("v.pos").alias("at"), "v.base")


@query("read_ids", "SELECT o_orderkey, 'r' || o_custkey || CASE WHEN o_orderkey & 64 <> 0 THEN '_1' WHEN o_orderkey & 128 <> 0 THEN '_2' ELSE '' END AS id, CASE WHEN o_orderkey & 16 <> 0 THEN '-' ELSE '+' END AS strand FROM orders WHERE o_orderkey & 4 = 0")
def read_ids(spark, sf):
    flag = F.col("o_orderkey").cast("int")
    df = table(spark, sf, "orders").where(~alignments.flag_is(flag, alignments.UNMAPPED))
    return df.select("o_orderkey", alignments.read_id(F.concat(F.lit("r"), F.col("o_custkey").cast("string")), flag).alias("id"), alignments.strand(flag).alias("strand"))


@query("sequence_chunks", "SELECT CAST(doc_id AS VARCHAR) AS chrom, CAST(k AS INT) AS chunk, substr(text, CAST(k * 256 + 1 AS INT), 256) AS seq FROM (SELECT *, unnest(range(0, (length(text) + 255) // 256)) AS k FROM documents)")
def sequence_chunks(spark, sf):
    return sequences.chunked(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chrom"), F.col("text").alias("seq")), 256)


@query("sequence_tiles", "WITH s AS (SELECT string_agg(n_name, '' ORDER BY n_nationkey) AS q FROM nation) SELECT CAST(k AS BIGINT) AS tile, substr(q, CAST(k * 16 + 1 AS INT), 16) AS sequence FROM s, (SELECT unnest(range(0, 10)) AS k)")
def sequence_tiles(spark, sf):
    nation = table(spark, sf, "nation")
    sizes = coords.with_offsets(nation.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("chrom"), F.length("n_name").cast("long").alias("size")))
    asked = spark.range(10).select(F.col("id").alias("tile"), (F.col("id") * 16).alias("start"), (F.col("id") * 16 + 16).alias("end"))
    return sequences.sequence_tiles(sequences.chunked(nation.select(F.col("n_name").alias("chrom"), F.col("n_name").alias("seq")), 4), sizes, asked, 4)


@query("sequence_sizes", "SELECT lang AS chrom, CAST(sum(length(text)) AS BIGINT) AS size FROM documents GROUP BY 1")
def sequence_sizes(spark, sf):
    return sequences.sequence_sizes(table(spark, sf, "documents").select(F.col("lang").alias("chrom"), F.col("text").alias("seq")))


# ---- encoding


@query("dense_index", "SELECT l_partkey % 64 + 64 * (l_suppkey % 64) AS cell, round(sum(l_quantity), 5) AS value FROM lineitem GROUP BY 1")
def dense_index(spark, sf):
    cell = encode.dense_index([F.col("l_partkey") % 64, F.col("l_suppkey") % 64], 64)
    return table(spark, sf, "lineitem").groupBy(cell.alias("cell")).agg(F.round(F.sum("l_quantity"), 5).alias("value"))


@query("sparse_or_dense", "SELECT tile, n < 25 AS is_sparse, n AS n_cells FROM (SELECT o_custkey // 256 AS tile, count(DISTINCT o_custkey % 256) AS n FROM orders GROUP BY 1)")
def sparse_or_dense(spark, sf):
    cells = table(spark, sf, "orders").groupBy(coords.floor_div(F.col("o_custkey"), 256).alias("tile"), (F.col("o_custkey") % 256).alias("index")).agg(F.sum("o_totalprice").alias("value"))
    each = cells.groupBy("tile").agg(F.collect_list(F.struct("index", "value")).alias("cells"))
    out = each.select("tile", F.size("cells").cast("long").alias("n_cells"), encode.binned_tile(F.col("cells"), 256).alias("json"))
    return out.select("tile", F.col("json").startswith('{"sparse"').alias("is_sparse"), "n_cells")


@query("dense_base64_f16")
def dense_base64_f16(spark, sf):
    bins = pyramid.bins(events(spark, sf), "pos", "value", 3600, ("event_type",)).select("event_type", F.pmod(F.col("bin"), F.lit(64)).alias("slot"), pyramid.mean().alias("value"))
    slots = bins.groupBy("event_type", "slot").agg(F.avg("value").alias("value"))
    return encode.dense_tiles(slots, ("event_type",), 64, "slot").select("event_type", encode.packed("dense").alias("t")).select("event_type", "t.*")


# ---- streams


def _streamed(spark: SparkSession, sf: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stream over the events to its end, and read what it appended."""
    schema = table(spark, sf, "events").schema
    own = folder(spark, "stream")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = build(source)
    out.writeStream.outputMode("append").format("parquet").option("path", f"{own}/out").option("checkpointLocation", f"{own}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{own}/out")


def _since(c: str) -> Column:
    """Microseconds from the start of the events."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast({c} as timestamp_ntz))")


#: What the watermark has passed once the stream has read all events.
_PASSED = "(SELECT (max(epoch_ms(ts)) - epoch_ms(TIMESTAMP '2024-01-01')) * 1000 - 3600000000 AS w FROM events)"
_US = "(SELECT *, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS t FROM events)"


@query("stream_pyramid", f"WITH p AS (SELECT z, t // (3600000000 * (1 << CAST(3 - z AS INT))) * (3600000000 * (1 << CAST(3 - z AS INT))) AS start, value FROM (SELECT CAST(unnest(range(0, 4)) AS INT) AS z, * FROM {_US})) SELECT z, start, count(*) AS n, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM p, {_PASSED} WHERE start + 3600000000 * (1 << CAST(3 - z AS INT)) <= w GROUP BY z, start")
def stream_pyramid(spark, sf):
    """Bins that the watermark has closed; those that end after it stay open."""
    return rounded(_streamed(spark, sf, lambda s: streams.pyramid(s, "ts", "value", 3600, 3, "1 hour")).withColumn("start", _since("start")), "sum")


@query(
    "stream_sessions",
    f"WITH g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM {_US}), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g), "
    f'q AS (SELECT user_id, min(t) AS start, max(t) + 1800000000 AS "end", count(*) AS n, round(sum(value), 4) AS sum FROM k GROUP BY user_id, k) SELECT q.* FROM q, {_PASSED} WHERE "end" <= w',
)
def stream_sessions(spark, sf):
    out = _streamed(spark, sf, lambda s: streams.sessions(s, "ts", "value", "30 minutes", "1 hour", ("user_id",)))
    return rounded(out.withColumn("start", _since("start")).withColumn("end", _since("end")), "sum")


@query(
    "stream_sliding",
    f'WITH o AS (SELECT event_type, value, t // 10800000000 * 10800000000 - k * 10800000000 AS start FROM {_US}, (VALUES (0), (1)) AS v(k)) SELECT event_type, start, start + 21600000000 AS "end", count(*) AS n, round(sum(value), 4) AS sum FROM o, {_PASSED} WHERE start + 21600000000 <= w GROUP BY event_type, start',
)
def stream_sliding(spark, sf):
    out = _streamed(spark, sf, lambda s: streams.sliding(s, "ts", "value", "6 hours", "3 hours", "1 hour", ("event_type",)))
    return rounded(out.withColumn("start", _since("start")).withColumn("end", _since("end")), "sum")


@query(
    "stream_tiles",
    f"WITH o AS (SELECT event_type, value, t // 14400000000 * 14400 AS start FROM {_US}) SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS sum FROM o, {_PASSED} WHERE (start + 14400) * 1000000 <= w GROUP BY event_type, start",
)
def stream_tiles(spark, sf):
    out = _streamed(spark, sf, lambda s: streams.closed_tiles(s, "ts", "value", "event_type", 14400, "1 hour"))
    return rounded(out.withColumn("start", F.col("start") - 1704067200), "sum")


@query("count_by_key", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def count_by_key(spark, sf):
    return rounded(table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(missing(F.col("value"))).alias("total")), "total")


