"""What the operators of this subpackage share: tables, scratch space and text columns."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import folder, mark, release

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str, *folders: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder, in folders by columns, and read it back."""
    spark = df.sparkSession
    path = folder(spark, tag)
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


#: Rows of an Arrow batch; texts are long, and a batch lies several times in memory.
BATCH_ROWS = 1000
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df, after Spark's default of 10000 rows an Arrow batch, if it holds, is set to BATCH_ROWS."""
    if df.sparkSession.conf.get(_ROWS_CONF, "10000") == "10000":
        df.sparkSession.conf.set(_ROWS_CONF, str(BATCH_ROWS))
    return df


def trimmed(function):
    """A batch function whose worker gives freed memory back at the end of a partition."""

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass

    return run


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(sizes: list[int], most: int):
    """Consecutive ranges [i, j) whose sizes sum to about `most`; a larger item stands alone."""
    i = total = 0
    for j, n in enumerate(sizes):
        if j > i and total + n > most:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)


__all__ = ["byte_texts", "chunks", "mark", "materialize", "release", "small_batches", "table", "text_or_empty", "trimmed"]
