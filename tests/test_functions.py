import math

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import alignments, coords, encode, tileid


@given(st.integers(1, 1 << 60), st.integers(1, 4096))
def test_max_zoom_is_the_least_level_that_fits(length, size):
    z = coords.max_zoom(length, size)
    assert size << z >= length
    assert z == 0 or size << (z - 1) < length


def test_max_zoom_at_powers_of_two():
    assert [coords.max_zoom(1 << n, 1) for n in (29, 31, 39, 47, 62)] == [29, 31, 39, 47, 62]


def test_natural_order(spark):
    def ordered(names):
        df = spark.createDataFrame([(n,) for n in names], "n string")
        return [r.n for r in df.orderBy(coords.natural_key(F.col("n"))).collect()]

    assert ordered(["m", "y", "x", "4", "2", "1", "3"]) == ["1", "2", "3", "4", "x", "y", "m"]
    assert ordered(["chrMT", "chr10", "chrX", "chr2", "chrY", "chrUn_2"]) == ["chr2", "chr10", "chrX", "chrY", "chrMT", "chrUn_2"]


def test_absolute_positions_and_back(spark):
    axis = coords.segments(spark, [("a", 100), ("b", 50), ("c", 70)])
    df = spark.createDataFrame([("b", 10), ("c", 0), ("z", 3)], "chrom string, pos long")
    assert {r.at for r in coords.to_absolute(df, axis, at="pos").collect()} == {110, 150}
    assert [(r.chrom, r.n_rows) for r in coords.unknown_segments(df, axis).collect()] == [("z", 1)]
    spans = spark.createDataFrame([(90, 230)], "start long, end long")
    parts = [(r.chrom, r.seg_start, r.seg_end) for r in coords.absolute_to_segments(spans, axis).orderBy("ord").collect()]
    assert parts == [("a", 90, 100), ("b", 0, 50), ("c", 0, 80)]  # the last part may pass the end


def test_floor_div_of_negatives(spark):
    assert spark.range(1).select(coords.floor_div(F.lit(-1), 4)).first()[0] == -1


def test_mercator_round_trip(spark):
    x, y = coords.mercator(F.lit(12.5), F.lit(-33.25), 7)
    lng, lat = spark.range(1).select(x.alias("x"), y.alias("y")).select(*coords.inverse_mercator(F.col("x"), F.col("y"), 7)).first()
    assert math.isclose(lng, 12.5) and math.isclose(lat, -33.25)
    a, b, c, d = coords.tile_box(0, 0, 0)
    assert (a, c) == (-180, 180) and math.isclose(b, -d)


def test_region_bins_follow_the_binning_scheme(spark):
    r = spark.range(1).select(coords.region_bins(F.lit(0).cast("long"), F.lit(1).cast("long"))).first()[0]
    assert r == [0, 1, 9, 73, 585, 4681]


def test_tile_ids():
    t = tileid.parse("abc.3.5.7.KR", 2)
    assert (t.uuid, t.z, t.x, t.y, t.mode) == ("abc", 3, 5, 7, "KR")
    assert tileid.parse("abc|cos:x.4.9").options == (("cos", "x"),)
    try:
        tileid.parse("abc.3", 1)
    except ValueError:
        pass
    else:
        raise AssertionError
    groups = tileid.by_adjacency(["a.3.0.0", "a.3.0.1", "a.3.5.5", "a.2.0.0", "a.3.1.1"])
    assert sorted(map(len, groups)) == [1, 1, 3]
    assert set(tileid.by_zoom_and_mode(["a.3.0.0", "a.3.1.1.KR"])) == {(3, "default"), (3, "KR")}


def test_cigar_walk(spark):
    r = spark.range(1).select(alignments.substitutions(F.lit("2H3S10M2I5M3D4M1X6N2S"), F.lit(100))).first()[0]
    assert [(x.pos, x.length, x.op) for x in r] == [(98, 2, "H"), (97, 3, "S"), (110, 2, "I"), (115, 3, "D"), (122, 1, "X"), (123, 6, "N"), (129, 2, "S")]
    assert spark.range(1).select(alignments.reference_length(F.lit("5S10M2D3I"))).first()[0] == 12


def test_md_walk(spark):
    r = spark.range(1).select(alignments.mismatches(F.lit("10A5^AC6T0G"), F.lit(1))).first()[0]
    assert [(x.pos, x.base) for x in r] == [(11, "A"), (25, "T"), (26, "G")]


def test_half_floats(spark):
    df = spark.createDataFrame([([0.0, 2.0, 4.0],), ([1e6, None, 2.0],)], "v array<double>")
    a, b = [r.t for r in df.select(encode.packed("v").alias("t")).collect()]
    assert (a.dense, a.dtype, a["size"], a.max_value) == ("AAAAQABE", "float16", 3, 4.0)
    assert (b.dtype, b.min_value) == ("float32", 2.0)


def test_dense_index_puts_the_first_dimension_first(spark):
    assert spark.range(1).select(encode.dense_index([F.lit(3), F.lit(2)], 64)).first()[0] == 3 + 2 * 64


def test_sparse_and_dense_json(spark):
    df = spark.createDataFrame([([(3, 1.5)],), ([(k, float(k)) for k in range(8)],)], "c array<struct<index:long,value:double>>")
    a, b = [r.t for r in df.select(encode.binned_tile(F.col("c"), 16, most_sparse=4).alias("t")).collect()]
    assert a == '{"sparse":[{"bin":[3.0],"value":1.5}],"min_value":1.5,"max_value":1.5}'
    assert b.startswith('{"dense":[0.0,1.0,2.0') and b.endswith('"max_value":7.0}')


def test_hashed_importance_ignores_partitions(spark):
    df = spark.range(100)
    a = {r.id: r.h for r in df.repartition(7).withColumn("h", coords.hashed_importance(3, "id")).collect()}
    b = {r.id: r.h for r in df.coalesce(1).withColumn("h", coords.hashed_importance(3, "id")).collect()}
    assert a == b and all(0 <= v < 1 for v in a.values()) and len(set(a.values())) == 100
