"""Binary indexes and database tilesets, decoded per file in Arrow batches."""

from __future__ import annotations

import gzip
import sqlite3
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_linear_index(data: bytes) -> list[tuple[int, int, int, int]]:
    """(reference, bin, chunk start, chunk end) of an alignment index, or of a block-compressed text index."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 4
    (n_ref,) = struct.unpack_from("<i", data, at)
    at += 4
    if data[:4] == b"TBI\1":
        (length,) = struct.unpack_from("<i", data, at + 24)
        at += 28 + length
    elif data[:4] != b"BAI\1":
        raise ValueError("neither kind of index")
    rows = []
    for ref in range(n_ref):
        (n_bin,) = struct.unpack_from("<i", data, at)
        at += 4
        for _ in range(n_bin):
            bin_, n_chunk = struct.unpack_from("<Ii", data, at)
            at += 8
            for _ in range(n_chunk):
                a, b = struct.unpack_from("<QQ", data, at)
                at += 16
                rows.append((ref, bin_, a, b))
        (n_intv,) = struct.unpack_from("<i", data, at)
        at += 4 + 8 * n_intv
    return rows


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """ref, bin, n_bytes (compressed bytes that a bin's chunks span)."""

    def run(frames):
        for pdf in frames:
            for data in pdf["content"]:
                rows = parse_linear_index(bytes(data))
                yield pd.DataFrame([(r, b, (z >> 16) - (a >> 16)) for r, b, a, z in rows], columns=["ref", "bin", "n_bytes"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "ref long, bin long, n_bytes long").groupBy("ref", "bin").agg(F.sum("n_bytes").alias("n_bytes"))


def read_database(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of a query against each SQLite tileset that the path names; the files travel through Spark."""

    def run(frames):
        for pdf in frames:
            for data in pdf["content"]:
                own = sqlite3.connect(":memory:")
                own.deserialize(bytes(data))
                cursor = own.execute(query)
                names = [c[0] for c in cursor.description]
                while rows := cursor.fetchmany(50_000):
                    yield pd.DataFrame(rows, columns=names)
                own.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


#: Columns of database tilesets by kind.
TABLES = {
    "beddb": ("SELECT id, zoomLevel, importance, startPos, endPos, chrOffset, uid, name, fields FROM intervals", "id long, zoomLevel int, importance double, startPos long, endPos long, chrOffset long, uid string, name string, fields string"),
    "bed2ddb": ("SELECT id, zoomLevel, importance, fromX, toX, fromY, toY, chrOffset, uid, fields FROM intervals", "id long, zoomLevel int, importance double, fromX long, toX long, fromY long, toY long, chrOffset long, uid string, fields string"),
    "gjdb": ("SELECT id, zoomLevel, importance, minLng, maxLng, minLat, maxLat, uid, geometry, properties FROM intervals", "id long, zoomLevel int, importance double, minLng double, maxLng double, minLat double, maxLat double, uid string, geometry string, properties string"),
    "imtiles": ("SELECT z, y, x, image FROM tiles", "z int, y long, x long, image binary"),
}


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The items of a database tileset; raw fields are split at tabs."""
    df = read_database(spark, path, *TABLES[kind])
    return df.withColumn("fields", F.split("fields", "\t")) if "fields" in df.columns else df


def image_tiles(tiles: DataFrame, requests: DataFrame) -> DataFrame:
    """tile_id, image (base64) of requested image tiles; tiles has z, y, x, image."""
    return requests.join(tiles, ["z", "x", "y"], "left").select("tile_id", F.base64("image").alias("image"))
