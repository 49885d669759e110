"""Tile ids: `uuid.z.x[.y][.mode]`, with `|key:value` options after the uuid or at the end."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TileId:
    uuid: str
    z: int
    x: int
    y: int | None = None
    mode: str | None = None
    options: tuple[tuple[str, str], ...] = field(default=())


def parse(tile_id: str, dims: int = 1) -> TileId:
    """A tile id as numbers; raises ValueError if it has too few parts."""
    body, *rest = tile_id.split("|")
    options = []
    for part in rest:
        head, _, tail = part.partition(".")
        key, _, value = head.partition(":")
        options.append((key, value))
        body += f".{tail}" if tail else ""
    parts = body.split(".")
    if len(parts) < 2 + dims:
        raise ValueError(f"tile id {tile_id!r} needs a zoom level and {dims} positions")
    place = [int(p) for p in parts[2 : 2 + dims]]
    mode = parts[2 + dims] if len(parts) > 2 + dims else None
    return TileId(parts[0], int(parts[1]), place[0], place[1] if dims > 1 else None, mode, tuple(options))


def parsed(tile_id: Column, dims: int = 1) -> Column:
    """The same as a struct column; malformed parts are null, a missing mode is `default`."""
    body = F.split(F.regexp_replace(tile_id, r"\|[^.]*", ""), r"\.")
    opts = F.regexp_extract_all(tile_id, F.lit(r"\|([^.|]*)"), F.lit(1))
    number = lambda k: F.get(body, F.lit(k)).try_cast("long")
    return F.struct(
        F.get(body, F.lit(0)).alias("uuid"),
        number(1).cast("int").alias("z"),
        number(2).alias("x"),
        (number(3) if dims > 1 else F.lit(None).cast("long")).alias("y"),
        F.coalesce(F.get(body, F.lit(2 + dims)), F.lit("default")).alias("mode"),
        F.map_from_entries(F.transform(opts, lambda o: F.struct(F.split_part(o, F.lit(":"), F.lit(1)), F.split_part(o, F.lit(":"), F.lit(2))))).alias("options"),
    )


def requests(spark, tile_ids: list[str], dims: int = 1) -> DataFrame:
    """tile_id, z, x[, y] of a request."""
    rows = []
    for t in tile_ids:
        p = parse(t, dims)
        rows.append((t, p.z, p.x, p.y, p.mode or "default"))
    return spark.createDataFrame(rows, "tile_id string, z int, x long, y long, mode string")


def by_adjacency(tile_ids: list[str], dims: int = 2, most: int = 0) -> list[list[str]]:
    """Groups of tiles of one uuid, zoom level and mode that touch each other, so one scan serves each.

    most: tiles a group may have, 0 for any number.
    """
    groups: dict = {}
    for t in dict.fromkeys(tile_ids):
        p = parse(t, dims)
        groups.setdefault((p.uuid, p.z, p.mode, p.options), {})[(p.x, p.y or 0)] = t
    out = []
    for tiles in groups.values():
        left = dict(tiles)
        while left:
            first = min(left)
            stack, own = [first], []
            tile = left.pop(first)
            own.append(tile)
            while stack:
                x, y = stack.pop()
                for near in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if near in left and (not most or len(own) < most):
                        own.append(left.pop(near))
                        stack.append(near)
            out.append(own)
    return out


def by_zoom_and_mode(tile_ids: list[str], dims: int = 2) -> dict[tuple[int, str], list[str]]:
    """Tile ids by zoom level and mode."""
    out: dict = {}
    for t in tile_ids:
        p = parse(t, dims)
        out.setdefault((p.z, p.mode or "default"), []).append(t)
    return out
