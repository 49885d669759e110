"""Importance placement: each item goes to the coarsest level all of whose tiles have room.

The rule is sequential: items come by falling importance, and an item takes a place in each tile
that it touches at the first level where none of them is full. It is computed in parallel rounds
per level, with the same result. A round ranks the undecided items of every tile. An item whose
rank is within the room left in each of its tiles is placed, since all more important undecided
items were counted before it; an item with a full tile moves on to the next level. The most
important undecided item is always decided, so rounds end; a handful is usual. Only items ranked
within the cap leave a tile's window, so a tile that all items touch costs a top-k, not a sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import floor_div, mercator
from ..scratch import written
from .intervals import walked_tiles


def _order(importance: str, key: tuple[str, ...]) -> list:
    return [F.desc_nulls_last(importance), *key]


def place_greedy(items: DataFrame, tiles: Callable[[int], Column], deepest: int, cap: int, key: tuple[str, ...], importance: str = "importance") -> tuple[DataFrame, DataFrame]:
    """(placed items with zoomLevel, items that fit nowhere).

    tiles(z): array of the tiles that an item touches at level z, as strings or numbers. An item
    that touches none is placed at once. key: columns that identify an item and break ties.
    """
    columns = items.columns
    rest = written(items, "items")
    done = None
    for z in range(deepest + 1):
        touched = rest.withColumn("_tiles", F.array_distinct(tiles(z)))
        open_ = written(touched.select(*key, importance, "_tiles"), "open")
        placed = open_.where(F.size("_tiles") <= 0).select(*key)
        open_ = open_.where(F.size("_tiles") > 0)
        used = None
        while True:
            pairs = open_.select(*key, importance, F.size("_tiles").alias("_n"), F.explode("_tiles").alias("_tile"))
            if used is not None:
                pairs = pairs.join(used, "_tile", "left").withColumn("_used", F.coalesce("_used", F.lit(0)))
            else:
                pairs = pairs.withColumn("_used", F.lit(0).cast("long"))
            room = cap - F.col("_used")
            full = pairs.where(room <= 0).select(*key).distinct()
            rank = F.row_number().over(Window.partitionBy("_tile").orderBy(*_order(importance, key)))
            ahead = pairs.withColumn("_rank", rank).where(F.col("_rank") <= cap).where(F.col("_rank") <= room)
            fits = ahead.groupBy(*key).agg(F.count("*").alias("_ok"), F.first("_n").alias("_n")).where("_ok = _n").select(*key)
            step = written(fits.withColumn("_fits", F.lit(True)).unionByName(full.withColumn("_fits", F.lit(False))), "round")
            now = step.where("_fits").drop("_fits")
            new = now.join(open_, list(key)).select(F.explode("_tiles").alias("_tile")).groupBy("_tile").agg(F.count("*").alias("_used"))
            used = new if used is None else used.unionByName(new).groupBy("_tile").agg(F.sum("_used").alias("_used"))
            used = written(used, "used")
            placed = placed.unionByName(now)
            open_ = written(open_.join(step.select(*key), list(key), "left_anti"), "open")
            if open_.isEmpty():
                break
        own = written(placed, "placed")
        level = rest.join(own, list(key)).withColumn("zoomLevel", F.lit(z)).select(*columns, "zoomLevel")
        done = level if done is None else done.unionByName(level)
        rest = written(rest.join(own, list(key), "left_anti"), "items")
        if rest.isEmpty():
            break
    return done, rest


def place_intervals(items: DataFrame, tile_size: int, deepest: int, cap: int, start: str = "startPos", end: str = "endPos", key: tuple[str, ...] = ("uid",)) -> tuple[DataFrame, DataFrame]:
    """1-D: at most `cap` items a tile; tiles are those met in steps of a tile's width from the start."""
    return place_greedy(items, lambda z: walked_tiles(F.col(start), F.col(end), tile_size << (deepest - z)), deepest, cap, key)


def place_rectangles(items: DataFrame, tile_size: int, deepest: int, cap: int, key: tuple[str, ...] = ("uid",)) -> tuple[DataFrame, DataFrame]:
    """2-D: a tile is full once it has more than `cap` items."""

    def tiles(z: int) -> Column:
        w = tile_size << (deepest - z)
        side = lambda a, b: F.sequence(floor_div(F.col(a), w), floor_div(F.col(b), w))
        return F.flatten(F.transform(side("fromX", "toX"), lambda x: F.transform(side("fromY", "toY"), lambda y: F.concat_ws(".", x.cast("string"), y.cast("string")))))

    return place_greedy(items, tiles, deepest, cap + 1, key)


def place_features(items: DataFrame, deepest: int, cap: int, key: tuple[str, ...] = ("uid",)) -> tuple[DataFrame, DataFrame]:
    """Mercator: a tile is full once it has more than `cap` features."""

    def tiles(z: int) -> Column:
        left, top = mercator(F.col("minLng"), F.col("maxLat"), z)
        right, bottom = mercator(F.col("maxLng"), F.col("minLat"), z)
        side = lambda a, b: F.sequence(F.floor(a), F.floor(b))
        return F.flatten(F.transform(side(left, right), lambda x: F.transform(side(top, bottom), lambda y: F.concat_ws(".", x.cast("string"), y.cast("string")))))

    return place_greedy(items, tiles, deepest, cap + 1, key)


def place_points(items: DataFrame, pos: str, tile_size: int, deepest: int, cap: int, key: tuple[str, ...], importance: str = "importance") -> DataFrame:
    """Items on one position each: one ranked pass a level is exact, as a tile's room is taken by rank."""
    # the top of each tile is a limit per group, which tasks apply before they shuffle; the rest is what isn't in it
    rest, done = items, None
    for z in range(deepest + 1):
        tile = floor_div(F.col(pos), tile_size << (deepest - z))
        ranked = rest.withColumn("_rank", F.row_number().over(Window.partitionBy(tile).orderBy(*_order(importance, key))))
        level = written(ranked.where(F.col("_rank") <= cap).drop("_rank").withColumn("zoomLevel", F.lit(z)), "placed")
        done = level if done is None else done.unionByName(level)
        rest = rest.join(level.select(*key), list(key), "left_anti")
        if z % 5 == 4:
            rest = written(rest, "items")
    return done


def top_per_tile(items: DataFrame, tile: Column, cap: int, key: tuple[str, ...], importance: str = "importance", reverse: bool = False) -> DataFrame:
    """The `cap` most (or least) important items of each tile, each key once; tiles are independent."""
    first = F.asc(importance) if reverse else F.desc(importance)
    best = items.withColumn("_tile", tile).groupBy("_tile", *key).agg((F.min if reverse else F.max)(importance).alias(importance))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("_tile").orderBy(first, *key)))
    return ranked.where(F.col("rank") <= cap).withColumnRenamed("_tile", "tile")
