"""Tables written between the rounds of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "/tmp/checkpoints/tessella"

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return LOCAL


def folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, for release()."""
    path = f"{shared_dir(spark)}/tessella-{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet and read back: its lineage ends here, and lost executors reread the files."""
    spark = df.sparkSession
    path = folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A position in the list of scratch tables, for release()."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete scratch tables written in [since, until); frames that still read them become invalid."""
    until = len(_written) if until is None else until
    jvm = spark.sparkContext._jvm
    for k in range(since, min(until, len(_written))):
        if _written[k]:
            path = jvm.org.apache.hadoop.fs.Path(_written[k])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            _written[k] = ""
