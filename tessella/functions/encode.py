"""Tile encodings: dense float16 or float32 in base64, dense or sparse JSON.

Only the packing of half floats needs Python, as an Arrow batch function over whole tiles; the rest
is expressions. Missing values become NaN here and nowhere else.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest and smallest normal magnitude of a half float: beyond them a tile is sent as float32.
HALF_MAX, HALF_MIN = 65504.0, 6.104e-05

_TILE = T.StructType([
    T.StructField("dense", T.StringType()), T.StructField("dtype", T.StringType()), T.StructField("size", T.IntegerType()),
    T.StructField("min_value", T.DoubleType()), T.StructField("max_value", T.DoubleType()),
])


def dense_array(values: Column, n: int, fill: float | None = None) -> Column:
    """An array of n values from an array of (bin, value); other bins hold `fill`."""
    by_bin = F.map_from_entries(F.transform(values, lambda s: F.struct(s["bin"].cast("int"), s["value"].cast("double"))))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.get(F.array(F.try_element_at(by_bin, k)), F.lit(0)), F.lit(fill).cast("double")))


def dense_tiles(bins: DataFrame, keys: tuple[str, ...], n: int, bin_: str = "bin", value: str = "value", fill: float | None = None) -> DataFrame:
    """One row a tile: keys and `dense`, an array of its n bins."""
    grouped = bins.groupBy(*keys).agg(F.collect_list(F.struct(F.col(bin_).alias("bin"), F.col(value).alias("value"))).alias("_v"))
    return grouped.select(*keys, dense_array(F.col("_v"), n, fill).alias("dense"))


def fits_half(values: np.ndarray) -> bool:
    finite = np.abs(values[np.isfinite(values)])
    finite = finite[finite > 0]
    return not len(finite) or bool(finite.max() < HALF_MAX and finite.min() > HALF_MIN)


@F.pandas_udf(_TILE)
def packed(values: pd.Series) -> pd.DataFrame:
    """dense (base64, little-endian), dtype, size, min_value and max_value of each array."""
    rows = []
    for v in values:
        a = np.array([np.nan if x is None else x for x in v], np.float64)
        dtype = "float16" if fits_half(a) else "float32"
        known = a[~np.isnan(a)]
        text = base64.b64encode(a.astype("<f2" if dtype == "float16" else "<f4").tobytes()).decode()
        rows.append((text, dtype, len(a), float(known.min()) if len(known) else None, float(known.max()) if len(known) else None))
    return pd.DataFrame(rows, columns=["dense", "dtype", "size", "min_value", "max_value"])


def dense_index(positions: list[Column], bins: int) -> Column:
    """Place of an n-dimensional bin in a flat array, the first dimension fastest."""
    total = F.lit(0).cast("long")
    for k, p in enumerate(positions):
        total = total + p.cast("long") * bins**k
    return total


def binned_tile(cells: Column, n_cells: int, dims: int = 1, bins: int = 256, most_sparse: int | None = None) -> Column:
    """JSON of a tile from an array of (index, value): sparse if it has few cells, else dense with zeros.

    Values are rounded to 5 digits in dense tiles. A tile is sparse below a tenth of its cells.
    """
    limit = n_cells // 10 if most_sparse is None else most_sparse
    ordered = F.array_sort(F.transform(cells, lambda c: F.struct(c["index"].alias("index"), c["value"].alias("value"))))
    low = F.array_min(F.transform(cells, lambda c: c["value"]))
    high = F.array_max(F.transform(cells, lambda c: c["value"]))
    place = lambda i: F.array(*((F.floor(i / bins**k) % bins).cast("double") for k in range(dims)))
    sparse = F.to_json(F.struct(F.transform(ordered, lambda c: F.struct(place(c["index"]).alias("bin"), c["value"].alias("value"))).alias("sparse"), low.alias("min_value"), high.alias("max_value")))
    by_bin = F.map_from_entries(F.transform(ordered, lambda c: F.struct(c["index"].cast("int"), F.round(c["value"], 5))))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n_cells - 1)), lambda k: F.coalesce(F.try_element_at(by_bin, k), F.lit(0.0)))
    return F.when(F.size(cells) < limit, sparse).otherwise(F.to_json(F.struct(dense.alias("dense"), low.alias("min_value"), high.alias("max_value"))))



def sparse_runs(cells: DataFrame, keys: tuple[str, ...], value: str, positions: tuple[str, ...]) -> DataFrame:
    """keys, value, n, then an array per position: the places of each value of a tile, in order.

    Flattened by `runs` this is the encoding value, n, xs, ys of sparse tiles.
    """
    grouped = cells.groupBy(*keys, value).agg(F.array_sort(F.collect_list(F.struct(*positions))).alias("_p"))
    return grouped.select(*keys, value, F.size("_p").cast("long").alias("n"), *(F.col(f"_p.{c}").alias(c) for c in positions))


def runs(encoded: DataFrame, keys: tuple[str, ...], value: str, positions: tuple[str, ...]) -> DataFrame:
    """keys, sparse: value, n, positions of all values of a tile in one flat array, by falling n."""
    each = F.concat(F.array(F.col(value).cast("double"), F.col("n").cast("double")), *(F.transform(c, lambda v: v.cast("double")) for c in positions))
    grouped = encoded.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"), each.alias("r")))).alias("_r"))
    return grouped.select(*keys, F.flatten(F.transform("_r", lambda s: s["r"])).alias("sparse"))
