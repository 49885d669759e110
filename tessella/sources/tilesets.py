"""Tilesets as Parquet with a JSON sidecar, and other sinks for tiles.

Data is partitioned by what requests prune on (zoom level, level, resolution) and sorted within
files by position, so a tile request reads few row groups.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 3
#: kind: partition columns, and the order within files.
LAYOUTS = {
    "beddb": (["zoomLevel"], ["startPos", "endPos"]),
    "bed2ddb": (["zoomLevel"], ["fromX", "fromY"]),
    "gjdb": (["zoomLevel"], ["minLng", "minLat"]),
    "hitile": (["z"], ["bin"]),
    "multivec": (["k"], ["chrom", "bin", "row"]),
    "mrmatrix": (["z"], ["i", "j"]),
    "cooler": (["resolution"], ["bin1", "bin2"]),
    "imtiles": (["z"], ["x", "y"]),
}


@dataclass
class Info:
    """What a tileset says about itself."""

    kind: str
    tile_size: int
    max_zoom: int
    max_width: int
    min_pos: list[float]
    max_pos: list[float]
    chrom_names: list[str] = field(default_factory=list)
    chrom_sizes: list[int] = field(default_factory=list)
    resolutions: list[int] = field(default_factory=list)
    stored: list[int] = field(default_factory=list)
    row_infos: list[str] = field(default_factory=list)
    header: str = ""
    extra: dict = field(default_factory=dict)
    version: int = VERSION


def write_tileset(df: DataFrame, path: str, info: Info) -> None:
    """Write data and its sidecar; the committer makes each appear whole or not at all."""
    parts, order = LAYOUTS[info.kind]
    df.sortWithinPartitions(*parts, *order).write.mode("overwrite").partitionBy(*parts).parquet(f"{path}/data")
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(asdict(info)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def tileset_info(spark: SparkSession, path: str) -> Info:
    return Info(**json.loads(spark.read.text(f"{path}/info").first()[0]))


def read_tileset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def write_columns(tiles: DataFrame, path: str) -> None:
    """Tab-separated tile id and JSON, one line a tile."""
    tiles.select(F.concat_ws("\t", "tile_id", "tile").alias("value")).write.mode("overwrite").text(path)


def write_bulk(tiles: DataFrame, path: str, index: str) -> None:
    """Pairs of action and document lines, as bulk loaders of search indexes read them."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col("tile_id").alias("_id")).alias("index")))
    document = F.concat(F.lit('{"tile_id":'), F.to_json(F.array("tile_id")).substr(F.lit(2), F.length(F.to_json(F.array("tile_id"))) - 2), F.lit(',"tile_value":'), F.col("tile"), F.lit("}"))
    tiles.select(F.concat_ws("\n", action, document).alias("value")).write.mode("overwrite").text(path)


def write_folders(tiles: DataFrame, path: str, gzip: bool = False) -> None:
    """JSON by zoom level and x: z=../x=../part files."""
    tiles.write.mode("overwrite").option("compression", "gzip" if gzip else "none").partitionBy("z", "x").json(path)


def write_nothing(tiles: DataFrame) -> None:
    """Run a plan and drop its rows."""
    tiles.write.format("noop").mode("overwrite").save()


def describe(path: str, command: str, inputs: list[str], **facts) -> dict:
    """A record of where a dataset comes from."""
    return {"path": path, "command": command, "inputs": inputs, "created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **facts}


def write_description(spark: SparkSession, record: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("append").text(path)
