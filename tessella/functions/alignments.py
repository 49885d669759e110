"""CIGAR and MD strings, flags and read names of alignments, as column expressions.

Positions are 1-based on the reference, as in text alignments. Walking an operation list is a fold
over an array, so no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNMAPPED, REVERSE, FIRST, LAST = 4, 16, 64, 128


def operations(cigar: Column) -> Column:
    """Array of (op, length)."""
    both = F.arrays_zip(F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHPX=])"), F.lit(1)).alias("n"), F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHPX=])"), F.lit(2)).alias("op"))
    return F.transform(both, lambda o: F.struct(o.op.alias("op"), o.n.cast("int").alias("length")))


def substitutions(cigar: Column, pos: Column) -> Column:
    """Array of (pos, length, op) of X, I, D, N, S and H operations on the reference.

    A leading clip lies before the first position; insertions and trailing clips lie at the next one.
    """
    start = F.struct(pos.cast("long").alias("at"), F.lit(True).alias("lead"), F.array().cast("array<struct<pos:bigint,length:int,op:string>>").alias("out"))

    def step(a: Column, o: Column) -> Column:
        clip = o.op.isin("S", "H")
        at = F.when(clip & a.lead, a["at"] - o.length).otherwise(a["at"])
        entry = F.array(F.struct(at.cast("long").alias("pos"), o.length.alias("length"), o.op.alias("op")))
        return F.struct(
            F.when(o.op.isin("M", "D", "N", "X", "="), a["at"] + o.length).otherwise(a["at"]).cast("long").alias("at"),
            (a.lead & clip).alias("lead"),
            F.when(o.op.isin("X", "I", "D", "N", "S", "H"), F.concat(a.out, entry)).otherwise(a.out).alias("out"),
        )

    return F.aggregate(operations(cigar), start, step, lambda a: a.out)


def reference_length(cigar: Column) -> Column:
    """Reference positions that an alignment covers."""
    return F.aggregate(operations(cigar), F.lit(0), lambda n, o: n + F.when(o.op.isin("M", "D", "N", "X", "="), o.length).otherwise(0))


def mismatches(md: Column, pos: Column) -> Column:
    """Array of (pos, base): reference positions and bases that an MD string says differ."""
    parts = F.regexp_extract_all(md, F.lit(r"([0-9]+|\^[A-Z]+|[A-Z])"), F.lit(1))
    start = F.struct(pos.cast("long").alias("at"), F.array().cast("array<struct<pos:bigint,base:string>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        number = p.try_cast("int")
        gap = p.startswith("^")
        single = number.isNull() & ~gap
        move = F.when(number.isNotNull(), number).when(gap, F.length(p) - 1).otherwise(1)
        out = F.when(single, F.concat(a.out, F.array(F.struct(a["at"].alias("pos"), p.alias("base"))))).otherwise(a.out)
        return F.struct((a["at"] + move).cast("long").alias("at"), out.alias("out"))

    return F.aggregate(parts, start, step, lambda a: a.out)


def flag_is(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def read_id(name: Column, flag: Column) -> Column:
    """The read's name, with _1 or _2 for the ends of a pair."""
    return F.concat(name, F.when(flag_is(flag, FIRST), "_1").when(flag_is(flag, LAST), "_2").otherwise(""))


def strand(flag: Column) -> Column:
    return F.when(flag_is(flag, REVERSE), "-").otherwise("+")
