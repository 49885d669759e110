"""What a block of values with missing ones sums to. NULL is missing inside; NaN only on the wire."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(v: Column) -> Column:
    """NaN as NULL; do this on ingest."""
    return F.nanvl(v.cast("double"), F.lit(None).cast("double"))


def keep(v: Column) -> Column:
    """Skip missing values; a block of nothing else is missing."""
    return F.sum(v)


def zero(v: Column) -> Column:
    """Skip missing values; a block of nothing else is 0."""
    return F.coalesce(F.sum(v), F.lit(0.0))


def zero_to_missing(v: Column) -> Column:
    """Skip missing values; a sum of 0 is missing."""
    return F.nullif(F.sum(v), F.lit(0.0))


def propagate(v: Column) -> Column:
    """One missing value makes the block missing."""
    return F.when(F.count_if(v.isNull()) == 0, F.sum(v))


POLICIES: dict[str, Callable[[Column], Column]] = {"keep": keep, "zero": zero, "zero_to_missing": zero_to_missing, "propagate": propagate}
