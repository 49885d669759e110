import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import annotations, intervals, matrix, multivec, placement, points, pyramid, sequences, signal


def cells(spark, a):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(a) for j, v in enumerate(row) if v == v], "i long, j long, value double")


def test_coarsened_rows(spark):
    """Rows 0..7 of an 8 x 8 matrix whose values are their column: known sums."""
    a = np.tile(np.arange(8.0), (8, 1)).T  # row number in each cell
    two = {(r.i, r.j): r.value for r in matrix.coarsen(cells(spark, a), 2).collect()}
    assert [two[(x, 0)] for x in range(4)] == [8 * x + 2 for x in range(4)]
    four = {(r.i, r.j): r.value for r in matrix.coarsen(cells(spark, a), 4).collect()}
    assert [four[(x, 0)] for x in range(2)] == [24, 88]


def test_matrix_pyramid_equals_direct_sums(spark):
    a = np.random.default_rng(1).integers(0, 9, (13, 13)).astype(float)
    for r in pyramid.matrix_pyramid(cells(spark, a), 3).collect():
        k = 1 << (3 - r.z)
        assert r.value == a[r.i * k : (r.i + 1) * k, r.j * k : (r.j + 1) * k].sum()


def test_missing_value_policies(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, None), (3, float("nan")), (4, 2.0), (5, -2.0)], "p long, v double")
    got = {p: [r.value for r in pyramid.summed(df, "p", "v", 2, p).orderBy("bin").collect()] for p in ("keep", "zero", "zero_to_missing", "propagate")}
    assert got == {"keep": [1.0, None, 0.0], "zero": [1.0, 0.0, 0.0], "zero_to_missing": [1.0, None, None], "propagate": [None, None, 0.0]}


def test_every_level_has_the_base_sum(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(r.randrange(10_000), r.random()) for _ in range(500)], "p long, v double")
    levels = pyramid.pyramid(pyramid.bins(df, "p", "v", 16), 6, step=2)
    sums = {x.z: (x.n, x.s) for x in levels.groupBy("z").agg(F.sum("n").alias("n"), F.sum("sum").alias("s")).collect()}
    assert set(sums) == {0, 2, 4, 6}
    assert all(n == 500 and math.isclose(s, sums[6][1]) for n, s in sums.values())


@pytest.mark.parametrize("z", range(7))
def test_read_level_equals_direct(spark, z):
    df = spark.range(3000).select(F.col("id").alias("p"), (F.col("id") % 17).cast("double").alias("v"))
    stored = pyramid.pyramid(pyramid.bins(df, "p", "v", 1), 6, step=3)
    got = {r.bin: (r.n, r.sum, r.min, r.max) for r in pyramid.read_level(stored, z, [0, 3, 6]).collect()}
    want = {r.bin: (r.n, r.sum, r.min, r.max) for r in pyramid.bins(df, "p", "v", 1 << (6 - z)).collect()}
    assert got == want


def test_interval_values_by_bin(spark):
    df = spark.createDataFrame([(9, 14, 1.0), (12, 30, None)], "a long, b long, v double")
    got = {r.bin: (r.n, r.n_missing, r.sum) for r in pyramid.interval_bins(df, "a", "b", "v", 8).collect()}
    assert got == {1: (9, 4, 5.0), 2: (8, 8, None), 3: (6, 6, None)}


def test_whisker_interleaves_single_modes(spark):
    df = spark.range(100).select(F.col("id").alias("p"), F.sin("id").alias("v"))
    flat = [r.value for r in signal.interleaved(signal.window_summary(df, "p", "v", 10, "whisker"), "whisker", 10).orderBy("position").collect()]
    for k, mode in enumerate(("min", "max", "mean", "std")):
        one = [r[mode] for r in signal.window_summary(df, "p", "v", 10, mode).orderBy("bin").collect()]
        assert flat[k::4] == one
    assert all(a >= m >= b for a, m, b in zip(flat[1::4], flat[2::4], flat[0::4]))


def greedy(items, tiles, deepest, cap):
    """The sequential rule."""
    count, out = defaultdict(int), {}
    for uid, imp, *place in sorted(items, key=lambda x: (-x[1], x[0])):
        for z in range(deepest + 1):
            own = [(z, t) for t in tiles(z, place)]
            if all(count[t] < cap for t in own):
                for t in own:
                    count[t] += 1
                out[uid] = z
                break
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_placement_is_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    items = [(k, r.choice([0.1, 0.5, 0.9, r.random()]), (s := r.randrange(900)), s + r.choice([0, 1, 5, 60, 300])) for k in range(70)]
    df = spark.createDataFrame(items, "uid long, importance double, startPos long, endPos long")
    placed, rest = placement.place_intervals(df, 128, 3, 4)
    got = {x.uid: x.zoomLevel for x in placed.collect()}

    def tiles(z, place):
        w, (a, b) = 128 << (3 - z), place
        return [a // w + k for k in range(-(-(b - a) // w))]

    want = greedy(items, tiles, 3, 4)
    assert got == want
    assert {x.uid for x in rest.collect()} == {k for k, *_ in items} - set(want)


def test_rectangle_placement_is_the_sequential_rule(spark):
    r = random.Random(5)
    items = [(k, r.random(), (x := r.randrange(500)), x + r.randrange(200), (y := r.randrange(500)), y + r.randrange(90)) for k in range(40)]
    df = spark.createDataFrame(items, "uid long, importance double, fromX long, toX long, fromY long, toY long")
    placed, _ = placement.place_rectangles(df, 256, 1, 3)

    def tiles(z, p):
        w = 256 << (1 - z)
        return [(i, j) for i in range(p[0] // w, p[1] // w + 1) for j in range(p[2] // w, p[3] // w + 1)]

    assert {x.uid: x.zoomLevel for x in placed.collect()} == greedy(items, tiles, 1, 4)


def test_point_placement_is_the_sequential_rule(spark):
    r = random.Random(8)
    items = [(k, r.random(), r.randrange(1000)) for k in range(200)]
    df = spark.createDataFrame(items, "uid long, importance double, p long")
    got = {x.uid: x.zoomLevel for x in placement.place_points(df, "p", 128, 3, 10, ("uid",)).collect()}
    assert got == greedy(items, lambda z, p: [p[0] // (128 << (3 - z))], 3, 10)


def test_tiles_show_what_overlaps_and_children_hold_it(spark):
    from tessella.functions.tileid import requests

    r = random.Random(4)
    items = [(k, (s := r.randrange(1000)), s + r.randrange(80), r.randrange(3)) for k in range(200)]
    df = spark.createDataFrame(items, "uid long, startPos long, endPos long, zoomLevel int")
    ids = [f"t.{z}.{x}" for z in (2, 3) for x in range(1 << z)]
    got = defaultdict(set)
    for x in intervals.tile_intervals(df, requests(spark, ids), 1024).collect():
        got[x.tile_id].add(x.uid)
    for z in (2, 3):
        w = 1024 >> z
        for x in range(1 << z):
            assert got[f"t.{z}.{x}"] == {k for k, a, b, lv in items if a < (x + 1) * w and b >= x * w and lv <= z}
    for x in range(4):
        assert got[f"t.2.{x}"] <= got[f"t.3.{2 * x}"] | got[f"t.3.{2 * x + 1}"]


def test_logsumexp_and_propagating_sum(spark):
    base = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 0, 2.0), ("a", 2, 0, None), ("a", 3, 0, 5.0)], "chrom string, bin long, row int, value double")
    top = {(r.k, r.bin): r.value for r in multivec.halving(base, 1, "logsumexp").collect()}
    assert math.isclose(top[(1, 0)], math.log(math.e + math.e**2)) and math.isclose(top[(1, 1)], 5.0)
    sums = {(r.k, r.bin): r.value for r in multivec.halving(base, 1, "sum").collect()}
    assert sums[(1, 0)] == 3.0 and sums[(1, 1)] is None
    assert {(r.k, r.bin): r.value for r in multivec.halving(base, 1).collect()}[(1, 1)] == 5.0


def test_unaligned_vectors_raise(spark):
    df = spark.createDataFrame([("a", 5, 0, 1.0)], "chrom string, start long, row int, value double")
    with pytest.raises(Exception, match="multiples"):
        multivec.binned(df, 10).collect()


def test_vector_tile_crosses_segments(spark):
    from tessella.functions.coords import segments

    sizes = segments(spark, [("a", 30), ("b", 20)])
    base = spark.createDataFrame([("a", k, 0, float(k)) for k in range(3)] + [("b", k, 0, 10.0 + k) for k in range(2)], "chrom string, bin long, row int, value double")
    levels = multivec.halving(base, 0)
    got = {r.column: r.value for r in multivec.tile(levels, sizes, 0, 10, 0, 8).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 2.0, 3: 10.0, 4: 11.0}


def test_density_equals_numpy(spark):
    r = np.random.default_rng(3)
    xy = r.normal(size=(400, 2))
    df = spark.createDataFrame([tuple(map(float, p)) for p in xy], "x double, y double")
    want, *_ = np.histogram2d(xy[:, 0], xy[:, 1], bins=16)
    got = np.zeros((16, 16))
    for c in points.density(df, 16).collect():
        got[c.bx, c.by] = c.n
    assert (got == want).all()


def test_score_threshold_equals_numpy(spark):
    r = random.Random(6)
    items = [(g, k, r.randrange(100)) for g in (1, 2) for k in range(60 if g == 1 else 10)]
    got = {(x.g, x.k) for x in points.score_threshold(spark.createDataFrame(items, "g long, k long, s long"), ("g",), "s", 20).collect()}
    cut = int(np.quantile([s for g, _, s in items if g == 1], 1 - 20 / 60))
    assert got == {(g, k) for g, k, s in items if g == 2 or s >= cut}


def test_sequence_tiles(spark):
    from tessella.functions.coords import segments

    axis = segments(spark, [("a", 10), ("b", 7)])
    seqs = spark.createDataFrame([("a", "ACGTACGTAC"), ("b", "TTTGGGC")], "chrom string, seq string")
    asked = spark.createDataFrame([(0, 0, 6), (1, 6, 12), (2, 12, 30)], "tile long, start long, end long")
    got = {r.tile: r.sequence for r in sequences.sequence_tiles(sequences.chunked(seqs, 4), axis, asked, 4).collect()}
    assert got == {0: "ACGTAC", 1: "GTACTT", 2: "TGGGC"}


def test_exon_unions(spark):
    t = spark.createDataFrame([("g", 0, 100, [0, 50], [10, 100]), ("g", 90, 200, [90, 150], [120, 200]), ("g", 300, 400, [300], [400])], "k string, txStart long, txEnd long, exonStarts array<long>, exonEnds array<long>")
    got = sorted((r.txStart, r.txEnd, r.exonStarts, r.exonEnds) for r in annotations.exon_unions(t, ("k",)).collect())
    assert got == [(0, 200, [0, 50, 150], [10, 120, 200]), (300, 400, [300], [400])]


def test_contacts(spark):
    bins = spark.createDataFrame([(0, 0.5, 2.0), (1, 1.0, 4.0), (2, None, None)], "bin_id long, weight double, KR double")
    pixels = spark.createDataFrame([(0, 1, 8.0), (1, 1, 3.0), (0, 2, 5.0)], "bin1 long, bin2 long, count double")
    assert {(r.bin1, r.bin2): r.value for r in matrix.balanced(pixels, bins).collect()} == {(0, 1): 4.0, (1, 1): 3.0, (0, 2): None}
    assert {(r.bin1, r.bin2): r.value for r in matrix.balanced(pixels, bins, "KR").collect()}[(0, 1)] == 1.0
    assert {(r.i, r.j) for r in matrix.contact_tile(pixels, bins, 0, 0, 4, "none").collect()} == {(0, 1), (1, 0), (1, 1), (0, 2), (2, 0)}
    assert sorted(r.position for r in matrix.masked_axis(bins, "weight", 0, 5).collect()) == [2, 3, 4]
    assert matrix.common_transforms([bins, bins.drop("KR")]) == ["weight"]


def test_guards(spark):
    df = spark.createDataFrame([(10,), (11,)], "w long")
    assert [r[0] for r in df.select(sequences.guarded(F.col("w"), 10)).collect()] == [None, "Tile too large: 11"]
    found = spark.createDataFrame([(1,), (1,), (2,)], "t long")
    assert {r.t: r.error for r in sequences.limited(found, ("t",), 1).collect()} == {1: "Too many results", 2: None}


def test_alignments(spark):
    rows = [("r", 64, "a", 5, 60, "3S4M", "MD", {"NM": "0"}), ("u", 4, "a", 1, 0, "*", "", None), ("s", 16, "a", 2, 9, "2M1X", "2A0", None)]
    df = spark.createDataFrame(rows, "qname string, flag int, rname string, pos long, mapq int, cigar string, md string, tags map<string,string>")
    got = {r.id: (r["from"], r.to, r.strand, [tuple(c) for c in r.cigars]) for r in sequences.alignments(df).collect()}
    assert got == {"r_1": (4, 8, "+", [(2, 3, "S")]), "s": (1, 4, "-", [(4, 1, "X")])}


def test_unsorted_rows_across_ranges(spark):
    r = random.Random(3)
    at = [r.randrange(1000) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(at)), "k long, p long").repartition(3)
    assert {x.k for x in annotations.unsorted_rows(df, ("k",), ("p",)).collect()} == {k for k in range(1, 400) if at[k] < at[k - 1]}


def test_feature_placement_is_the_sequential_rule(spark):
    import math

    def tile(lng, lat, z):
        return math.floor(2**z * (lng + 180) / 360), math.floor(2**z * (math.pi - math.log(math.tan((math.radians(lat) + math.pi / 2) / 2))) / (2 * math.pi))

    r = random.Random(8)
    items = []
    for k in range(120):
        x, y = r.uniform(-170, 150), r.uniform(-70, 60)
        items.append((k, x, x + r.uniform(0, 20), y, y + r.uniform(0, 15), float(r.randrange(50))))
    df = spark.createDataFrame(items, "uid long, minLng double, maxLng double, minLat double, maxLat double, importance double")
    placed, left = placement.place_features(df, 3, 4)
    used, want, rest = {}, {}, sorted(items, key=lambda i: (-i[5], i[0]))
    for z in range(4):
        again = []
        for i in rest:
            (x0, y0), (x1, y1) = tile(i[1], i[4], z), tile(i[2], i[3], z)
            tiles = [(z, x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]
            if all(used.get(t, 0) <= 4 for t in tiles):
                want[i[0]] = z
                for t in tiles:
                    used[t] = used.get(t, 0) + 1
            else:
                again.append(i)
        rest = again
    assert {r.uid: r.zoomLevel for r in placed.collect()} == want
    assert {r.uid for r in left.collect()} == {i[0] for i in rest}


def test_query_size_past_the_coarse_bins(spark):
    """From 2^29 on, bin numbers of coarse levels would be those of finer levels."""
    regions = spark.createDataFrame([(1, "a", 0, 50_000), (2, "a", (1 << 29) - 20, (1 << 29) + 50_000), (3, "a", 541_000_000, 541_050_000)], "region long, chrom string, start long, end long")
    chunks = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 585, 4), ("a", 4680, 8), ("a", 4681, 16), ("a", 4718, 32), ("a", 4719, 64), ("a", 37448, 128), ("a", 37449, 256)], "chrom string, bin long, n_bytes long")
    got = {r.region: r.n_bytes for r in sequences.query_size(regions, chunks).collect()}
    assert got == {1: 1 + 2 + 4 + 16, 2: 1 + 8 + 128 + 256, 3: 0}
