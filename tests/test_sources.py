import base64
import json
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.coords import segments
from tessella.operators import multivec, pyramid
from tessella.plans import serving
from tessella.sources import indexes, text, tilesets
from tessella.sources.tilesets import Info


@pytest.fixture
def axis(spark):
    return segments(spark, [("chr1", 1000), ("chr2", 500)])


def put(path, content, mode="w"):
    with open(path, mode) as f:
        f.write(content)
    return str(path)


def test_bed(spark, tmp_path, axis):
    p = put(tmp_path / "a.bed", "chr1\t10\t20\tx y\t3.5\nchr2\t40\t30\tz\t1\nchr2\tbad\t7\tq\t1\nchrZ\t1\t2\tw\t1\n")
    rows = {r.name: r for r in text.read_bed(spark, p, axis, name=4, importance=5, delimiter="\t").collect()}
    assert set(rows) == {"x y", "z"}  # a bad number and an unknown segment drop
    assert (rows["x y"].startPos, rows["x y"].endPos, rows["x y"].importance) == (10, 20, 3.5)
    assert (rows["z"].startPos, rows["z"].endPos, rows["z"].chrOffset) == (1030, 1040, 1000)
    bad = text.read_bed(spark, p, delimiter="\t", corrupt=True).where("_corrupt").collect()
    assert len(bad) == 1 and "bad" in bad[0]._line
    assert {r.importance for r in text.read_bed(spark, p, axis, importance="size").collect()} == {10.0}
    assert text.read_bed(spark, p, axis, chromosome="chr2").count() == 1
    assert len(text.read_bed(spark, p, axis, delimiter="\t").first().fields) == 5
    again = text.read_bed(spark, p, axis).select("uid", "importance").orderBy("uid").collect()
    assert again == text.read_bed(spark, p, axis).repartition(3).select("uid", "importance").orderBy("uid").collect()


def test_header_is_dropped(spark, tmp_path, axis):
    p = put(tmp_path / "h.bed", "chrom start end\nchr1 1 2\nchr1 5 9\n")
    assert text.read_bed(spark, p, axis, header=True).count() == 2
    q = put(tmp_path / "i.bed", "chrom start end\nchr2 7 8\n")
    assert sorted(r.start for r in text.read_bed(spark, [p, q], axis, header=True).collect()) == [1, 5, 7]


def test_bedpe(spark, tmp_path, axis):
    p = put(tmp_path / "a.bedpe", "chr1 10 20 chr2 5 9\nchr2 1 3 chr2 8 2\n")
    rows = sorted((r.fromX, r.toX, r.fromY, r.toY, r.importance) for r in text.read_bedpe(spark, p, axis, importance="size").collect())
    assert rows == [(10, 20, 1005, 1009, 10.0), (1001, 1003, 1002, 1008, 6.0)]


def test_bedgraph_positions(spark, tmp_path, axis):
    p = put(tmp_path / "a.bg", "chr1 10 15 1\nchr2 30 40 77\nchr1 20 22 nil\n")
    df = text.read_bedgraph(spark, p, axis, missing="nil")
    unit = {r.bin: r["sum"] for r in pyramid.interval_bins(df, "start", "end", "value", 1).collect()}
    assert {k for k, v in unit.items() if v == 1.0} == set(range(9, 14))
    assert {k for k, v in unit.items() if v == 77.0} == set(range(1029, 1039))
    assert unit[19] is None
    assert text.read_bedgraph(spark, p, axis, exp2=True, chromosome="chr1").where("value = 2").count() == 1


def test_geojson(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 3], [0, 3], [0, 0]]]}
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": square, "properties": {"a": 7}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [5, 6]}, "properties": {}}]}
    p = put(tmp_path / "a.json", json.dumps(doc))
    a, b = text.read_geojson(spark, p).orderBy(F.desc("area")).collect()
    assert (a.minLng, a.maxLng, a.minLat, a.maxLat, a.area, a.importance) == (0, 4, 0, 3, 12, 12)
    assert (b.minLng, b.maxLat, b.area) == (5, 6, 0)
    assert text.read_geojson(spark, p, "a").where("importance = 7").count() == 1


def test_matrix_points_and_sizes(spark, tmp_path):
    cells, labels = text.read_matrix(spark, put(tmp_path / "m.tsv", "\ta\tb\nb\t3\tnan\na\t1\t2\n"))
    assert {(r.i, r.j): r.value for r in cells.collect()} == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 3.0, (1, 1): None}
    assert [r.label for r in labels.orderBy("idx").collect()] == ["a", "b"]
    assert text.read_points(spark, put(tmp_path / "p.csv", "x,y,c\n1,2,q\n,3,r\n")).count() == 1
    assert [(r.chrom, r.offset) for r in text.read_chromsizes(spark, put(tmp_path / "s.sizes", "b\t5\na\t7\n")).orderBy("ord").collect()] == [("b", 0), ("a", 5)]


def test_fasta_sam_gff(spark, tmp_path):
    fa = text.read_fasta(spark, put(tmp_path / "a.fa", ">one first\nACGT\nAC\n>two\nGG\n"))
    assert {r.chrom: r.seq for r in fa.collect()} == {"one": "ACGTAC", "two": "GG"}
    sam = text.read_sam(spark, put(tmp_path / "a.sam", "@HD\tVN:1\nq\t16\tchr1\t7\t60\t5M\t*\t0\t0\tACGTA\t*\tNM:i:1\tMD:Z:2A2\n")).first()
    assert (sam.pos, sam.md, sam.tags["NM"]) == (7, "2A2", "1")
    gff = "##gff\nc\t.\tgene\t1\t90\t.\t+\t.\tID=g;Name=G\nc\t.\tmRNA\t1\t90\t.\t+\t.\tID=t;Parent=g\nc\t.\texon\t1\t20\t.\t+\t.\tParent=t\nc\t.\texon\t50\t90\t.\t+\t.\tParent=t\nc\t.\tCDS\t5\t60\t.\t+\t0\tParent=t\n"
    from tessella.operators.annotations import gene_predictions

    r = gene_predictions(text.read_gff(spark, put(tmp_path / "a.gff", gff))).first()
    assert (r.txStart, r.txEnd, r.gene_name, r.cdsStart, r.cdsEnd, r.exonStarts, r.exonEnds) == (0, 90, "G", 4, 60, [0, 49], [20, 90])


def test_vectors(spark, tmp_path):
    p = put(tmp_path / "v.bed", "track x\nchr1\t0\t10\t1\tNA\nchr1\t10\t20\t3\t4\n")
    rows = {(r.start, r.row): r.value for r in text.read_vectors(spark, p, delimiter="\t").collect()}
    assert rows == {(0, 0): 1.0, (0, 1): None, (10, 0): 3.0, (10, 1): 4.0}
    e = put(tmp_path / "e.bed", 'chr1\t0\t200\tid:1,qcat:[[0.5,2],[0.1,1]]\n')
    assert [r.value for r in text.read_vectors(spark, e, "epilogos").orderBy("row").collect()] == [0.1, 0.5]
    s = put(tmp_path / "s.bed", "chr1\t0\t10\tB\n")
    assert [r.value for r in text.read_vectors(spark, s, "states", states=["A", "B"]).orderBy("row").collect()] == [0.0, 1.0]


def test_types_by_name():
    assert text.infer_filetype("a.Multires.mv5") == "multivec" and text.infer_filetype("a.BW") == "bigwig"
    assert text.infer_datatype("cooler") == "matrix" and text.infer_filetype("a.xyz") is None


def test_binary_index(spark, tmp_path):
    chunk = struct.pack("<QQ", 100 << 16, 250 << 16)
    data = b"BAI\1" + struct.pack("<i", 1) + struct.pack("<i", 1) + struct.pack("<Ii", 4681, 1) + chunk + struct.pack("<i", 1) + struct.pack("<Q", 0)
    p = put(tmp_path / "a.bai", data, "wb")
    assert [tuple(r) for r in indexes.read_index(spark, p).collect()] == [(0, 4681, 150)]


def test_database(spark, tmp_path):
    p = str(tmp_path / "t.db")
    own = sqlite3.connect(p)
    own.execute("create table intervals (id int, startPos int)")
    own.executemany("insert into intervals values (?, ?)", [(1, 5), (2, 9)])
    own.commit()
    own.close()
    got = indexes.read_database(spark, p, "select id, startPos from intervals", "id long, startPos long").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 5), (2, 9)]


def test_tileset_round_trip_and_tiles(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("p"), (F.col("id") % 10).cast("double").alias("v"))
    info = Info("hitile", 64, 4, 1024, [0], [1000], stored=[0, 2, 4])
    tilesets.write_tileset(pyramid.pyramid(pyramid.bins(df, "p", "v"), 4, 2), f"{tmp_path}/t", info)
    back, data = tilesets.tileset_info(spark, f"{tmp_path}/t"), tilesets.read_tileset(spark, f"{tmp_path}/t")
    assert back == info
    rows = {r.tile_id: r for r in serving.tiles("hitile", data, back, ["t.4.0", "t.3.1", "t.9.0"]).collect()}
    assert set(rows) == {"t.4.0", "t.3.1"}
    raw = np.frombuffer(base64.b64decode(rows["t.4.0"].dense), "<f2")
    assert raw.tolist() == [k % 10 for k in range(64)]
    assert "zoomLevel" not in data.columns and any("z=4" in str(p) for p in (tmp_path / "t/data").iterdir())


def test_serving_kinds(spark):
    items = spark.createDataFrame([(k, 10 * k, 10 * k + 5, 0, float(k), 0, "n", ["f"]) for k in range(20)], "uid long, startPos long, endPos long, zoomLevel int, importance double, chrOffset long, name string, fields array<string>")
    info = Info("beddb", 64, 2, 256, [0], [200])
    rows = {r.tile_id: [i.uid for i in r.items] for r in serving.tiles("beddb", items, info, ["t.0.0", "t.2.1"]).collect()}
    assert rows["t.0.0"] == list(range(20)) and rows["t.2.1"] == list(range(6, 13))
    cells = spark.createDataFrame([(z, 0, 1, 2.0) for z in range(2)], "z int, i long, j long, value double")
    minfo = Info("mrmatrix", 4, 1, 8, [0, 0], [8, 8])
    dense = np.frombuffer(base64.b64decode(serving.tiles("mrmatrix", cells, minfo, ["m.1.0.0"]).first().dense), "<f2").reshape(4, 4)
    assert dense[0, 1] == 2.0 and np.isnan(dense).sum() == 15
    with pytest.raises(ValueError, match="beyond"):
        serving.tiles("mrmatrix", cells, minfo, ["m.2.0.0"])
    base = spark.createDataFrame([("chr1", 0, 0, 1.0)], "chrom string, bin long, row int, value double")
    vinfo = Info("multivec", 4, 0, 4, [0], [4], row_infos=["a"])
    v = serving.tiles("multivec", multivec.halving(base, 0), vinfo, ["v.0.0"], sizes=segments(spark, [("chr1", 4)])).first()
    assert np.frombuffer(base64.b64decode(v.dense), "<f2").tolist() == [1.0, 0.0, 0.0, 0.0]
    cloud = spark.createDataFrame([(0.0, 0.0), (0.5, 0.5), (1.0, 1.0)], "x double, y double")
    pinfo = Info("points", 4, 3, 1, [0.0, 0.0], [1.0, 1.0])
    assert [len(r.items) for r in serving.tiles("points", cloud, pinfo, ["p.0.0.0"]).collect()] == [1]  # bounds are exclusive


def test_other_sinks(spark, tmp_path):
    tiles = spark.createDataFrame([("a.1.2", '{"dense":[1]}', 1, 2)], "tile_id string, tile string, z int, x long")
    tilesets.write_columns(tiles, f"{tmp_path}/c")
    assert spark.read.text(f"{tmp_path}/c").first().value == 'a.1.2\t{"dense":[1]}'
    tilesets.write_bulk(tiles, f"{tmp_path}/b", "ix")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/b").collect()]
    assert {"index": {"_index": "ix", "_id": "a.1.2"}} in lines and {"tile_id": "a.1.2", "tile_value": {"dense": [1]}} in lines
    tilesets.write_folders(tiles, f"{tmp_path}/f", gzip=True)
    assert (tmp_path / "f/z=1/x=2").exists()
    tilesets.write_nothing(tiles)
    tilesets.write_description(spark, tilesets.describe("p", "c", ["i"], rows=3), f"{tmp_path}/d")
    assert json.loads(spark.read.text(f"{tmp_path}/d").first().value)["rows"] == 3


def test_command_line(spark, tmp_path):
    from tessella import cli

    sizes = put(tmp_path / "s.sizes", "chr1\t1000\nchr2\t500\n")
    bed = put(tmp_path / "a.bed", "".join(f"chr1\t{k}\t{k + 3}\n" for k in range(0, 900, 10)))
    a = cli.parser().parse_args(["bedfile", bed, f"{tmp_path}/o", "--chromsizes", sizes, "--tile-size", "256", "--max-per-tile", "20", "--importance", "size"])
    cli.bedfile(spark, a)
    placed = tilesets.read_tileset(spark, f"{tmp_path}/o")
    assert placed.groupBy("zoomLevel").count().where("zoomLevel = 0 AND count = 20").count() == 1
    assert tilesets.tileset_info(spark, f"{tmp_path}/o").max_zoom == 3
    bg = put(tmp_path / "a.bg", "chr1\t1\t11\t2\n")
    cli.bedgraph(spark, cli.parser().parse_args(["bedgraph", bg, f"{tmp_path}/g", "--chromsizes", sizes, "--tile-size", "64"]))
    assert tilesets.read_tileset(spark, f"{tmp_path}/g").where("z = 0").agg(F.sum("sum")).first()[0] == 20.0
    with pytest.raises(SystemExit):
        cli.bedfile(spark, cli.parser().parse_args(["bedfile", bed, f"{tmp_path}/x"]))


def test_repeated_tags_and_long_values(spark, tmp_path):
    long = "x" * 2_000_000
    p = put(tmp_path / "a.sam", "@HD\n" + "\t".join(["r1", "0", "chr1", "5", "60", "4M", "*", "0", "0", "ACGT", "*", "NM:i:1", f"XA:Z:{long}", "NM:i:2"]) + "\n")
    r = text.read_sam(spark, p).first()
    assert r.tags == {"NM": "1", "XA": long}


def test_files_are_zipped_on_the_command_line(spark, tmp_path):
    from tessella.cli import main

    sizes = put(tmp_path / "s.tsv", "chr1\t64\n")
    files = [put(tmp_path / f"{k}.bed", "".join(f"chr1\t{i * 2}\t{i * 2 + 2}\t{v * (i + 1)}\n" for i in range(4))) for k, v in enumerate((1, 10, 100))]
    main(["multivec", ",".join(files), f"{tmp_path}/out", "--chromsizes", sizes, "--resolution", "2", "--tile-size", "8"])
    data, info = tilesets.read_tileset(spark, f"{tmp_path}/out"), tilesets.tileset_info(spark, f"{tmp_path}/out")
    assert sorted((r.bin, r.row, r.value) for r in data.where("k = 0").collect()) == [(i, k, float(v * (i + 1))) for i in range(4) for k, v in enumerate((1, 10, 100))]
    assert len(info.row_infos) == 3
    main(["bigwigs_to_multivec", ",".join(files), f"{tmp_path}/signals", "--chromsizes", sizes, "--resolution", "4", "--tile-size", "8"])
    got = sorted((r.bin, r.row, r.value) for r in tilesets.read_tileset(spark, f"{tmp_path}/signals").where("k = 0").collect())
    assert got == [(b, k, float(v * 2 * (4 * b + 3))) for b in range(2) for k, v in enumerate((1, 10, 100))]


def test_contact_tiles_leave_masked_bins_empty(spark):
    pixels = spark.createDataFrame([(0, 0, 4.0), (0, 2, 3.0), (1, 2, 9.0), (2, 2, 1.0)], "bin1 long, bin2 long, count double")
    bins = spark.createDataFrame([(0, 1.0), (1, None), (2, 2.0)], "bin_id long, weight double")
    info = Info("cooler", 4, 0, 4, [0, 0], [3, 3], resolutions=[1])
    (tile,) = serving.tiles("cooler", {1: pixels}, info, ["a.0.0.0"], bins={1: bins}, encoded=False).collect()
    assert tile.value == [4.0, None, 6.0, None] + [None] * 4 + [6.0, None, 4.0, None] + [None] * 4
    (raw,) = serving.tiles("cooler", {1: pixels}, info, ["a.0.0.0.none"], bins={1: bins}, encoded=False).collect()
    assert raw.value == [4.0, 0.0, 3.0, None, 0.0, 0.0, 9.0, None, 3.0, 9.0, 1.0, None] + [None] * 4


def test_no_ids_give_no_rows(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    rect = "fromX long, toX long, fromY long, toY long, uid string, importance double, chrOffset long, fields array<string>, zoomLevel int"
    info = Info("x", 4, 2, 16, [0, 0], [16, 16], resolutions=[1])
    cases = {
        "beddb": ("startPos long, endPos long, uid string, importance double, chrOffset long, name string, fields array<string>, zoomLevel int", {}),
        "bed2ddb": (rect, {}), "arcs": (rect, {}), "points": ("x double, y double", {}), "density": ("x double, y double", {}), "nplabels": ("idx long, label string, importance double", {}),
        "hitile": ("z int, bin long, n long, n_missing long, sum double, sumsq double, min double, max double", {}), "mrmatrix": ("z int, i long, j long, value double", {}),
        "npmatrix": ("i long, j long, value double", {}), "npvector": ("idx long, value double", {}), "multivec": ("k int, chrom string, bin long, row int, value double", {"sizes": segments(spark, [("a", 16)])}),
    }
    for kind, (schema, options) in cases.items():
        assert serving.tiles(kind, empty(schema), info, [], **options).count() == 0, kind
        asked = ["a.1.0"] if kind in ("beddb", "arcs", "nplabels", "hitile", "npvector", "multivec") else ["a.1.0.0"]
        assert serving.tiles(kind, empty(schema), info, asked, **options).count() == 1, kind
    pixels, bins = empty("bin1 long, bin2 long, count double"), empty("bin_id long, weight double")
    assert serving.tiles("cooler", {1: pixels}, info, [], bins={1: bins}).count() == 0


def test_run_encoding(spark):
    from tessella.functions.encode import runs, sparse_runs

    cells = spark.createDataFrame([(0, 2.0, 5, 1), (0, 2.0, 3, 9), (0, 7.0, 4, 4)], "tile int, value double, x int, y int")
    (r,) = runs(sparse_runs(cells, ("tile",), "value", ("x", "y")), ("tile",), "value", ("x", "y")).collect()
    assert r.sparse == [2.0, 2.0, 3.0, 5.0, 9.0, 1.0, 7.0, 1.0, 4.0, 4.0]


def test_image_and_other_readers(spark, tmp_path):
    p = put(tmp_path / "t.json", '[{"len": 3, "start": "a", "end": "b"}]')
    assert [tuple(r) for r in text.read_time_interval(spark, p).collect()] == [(3, "a", "b")]
