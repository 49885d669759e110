"""Benchmark decontamination: SimHash of item-sized windows, in native expressions only.

Words are runs of non-blank characters, lower-cased. Items and windows are compared by their
multisets of SHINGLE-word shingles (an item of fewer words is one shingle).

A window with any similarity to an item shares a shingle with it. Of all windows of the item's size
one that starts where a stretch of shared shingles starts is as similar as any: moving a window up
to the next such place loses nothing. So the windows to fingerprint are those that start with a
stretch, and those aligned with the item on it; a window is moved inside its text where it would
stick out, and a text shorter than the item is one window as a whole, if long enough to reach
SIMILARITY. (Where an item repeats a shingle, another window could be more similar by the repeats.)

SimHash fingerprints of a window and of the items that it shares a stretch with meet in a
multi-index of RADIUS + 1 blocks, which by the pigeonhole principle yields every pair at most
RADIUS bits apart. Texts of similarity 0.8 differ by about 10 of 64 bits, with a deviation of 3, so
RADIUS is set five deviations beyond. Those pairs are then verified exactly: sum of smaller over sum
of larger shingle counts, kept from SIMILARITY on.

One row per (doc_id, item_id): the best window and how many of the windows match. Null and empty
texts match nothing, and neither do empty items. Rows that repeat a doc_id count as one document,
and repeated items give equal rows once per item_id. Empty tables give no rows. Further columns are
ignored. Texts are cut into pieces of PIECE words with margins of the longest item, so a word's row
is bounded whatever the text. Copies of a passage in a third of all documents stay in their
documents' own groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 24
#: Words of a piece of a text, without its margins.
PIECE = 512
#: Shingles of the benchmark that are broadcast at most; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000
_BITS = 64


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(text_or_empty(text)), r"[\x20\x09-\x0D]+"), "")


def _shingles(array: str, width: str) -> str:
    return f"transform(sequence(1, size({array}) - {width} + 1), i -> array_join(slice({array}, i, {width}), ' '))"


def _counts(bits: int, hashes: str) -> str:
    """Ones per bit of an array of hashes, `bits` wide, side by side in longs: place b in lane b div bits of long b % bits."""
    lanes = sum(1 << k for k in range(0, _BITS, bits))
    return f"transform(sequence(0, {bits - 1}), k -> aggregate({hashes}, 0L, (a, h) -> a + (shiftrightunsigned(h, k) & {lanes}L)))"


def _fingerprint(shingles: str) -> str:
    """SimHash of an array of shingles: bit b is 1 if it is 1 in over half of the hashes."""

    def majority(bits: int) -> str:
        one = f"shiftrightunsigned(n[b % {bits}], {bits} * (b div {bits})) & {(1 << bits) - 1}L"
        return f"""element_at(transform(array({_counts(bits, 'hs')}), n -> aggregate(sequence(0, {_BITS - 1}), 0L, (f, b) -> f |
            CASE WHEN 2 * ({one}) > size(hs) THEN shiftleft(1L, b) ELSE 0L END)), 1)"""

    hashes = f"transform({shingles}, s -> xxhash64(s))"
    return f"element_at(transform(array({hashes}), hs -> CASE WHEN size(hs) < {1 << 16} THEN {majority(16)} ELSE {majority(32)} END), 1)"


def _blocks(radius: int) -> Column:
    """(block, value) of each of radius + 1 blocks that the bits of `fp` are dealt to."""
    edges = [_BITS * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*(F.struct(F.lit(k).alias("block"), F.expr(f"shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1}L").alias("value")) for k, (a, b) in enumerate(zip(edges, edges[1:]))))


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, item (key of the text), m (words), width (of shingles), w (words), s (shingles), fp."""
    df = benchmark.select("item_id", words("text").alias("w")).where("size(w) > 0").distinct()
    df = df.withColumn("m", F.size("w")).withColumn("width", F.least(F.lit(SHINGLE), F.col("m"))).withColumn("item", F.xxhash64("w"))
    return df.withColumn("s", F.expr(_shingles("w", "width"))).withColumn("fp", F.expr(_fingerprint("s")))


def windows(docs: DataFrame, known: DataFrame, similarity: float = SIMILARITY) -> DataFrame | None:
    """doc_id, start, m, item, width, w: the distinct windows at stretches of shingles shared with an item."""
    keys = known.select("item", "m", "width", F.posexplode("w").alias("j", "_"), "w").where("j <= m - width")
    facts = known.groupBy("width").agg(F.max("m").alias("m")).collect()  # a row a width, of SHINGLE at most
    if not facts:
        return None
    margin, found = max(r.m for r in facts), None
    texts = docs.select("doc_id", words("text").alias("_d")).where("size(_d) > 0").withColumn("n", F.size("_d"))
    # off: place of the first word that a piece carries
    off = f"greatest(0, p * {PIECE} - {margin})"
    cut = f"transform(sequence(0, (n - 1) div {PIECE}), p -> struct(p AS p, {off} AS off, slice(_d, {off} + 1, (p + 1) * {PIECE} + {margin} - {off}) AS d))"
    piece = texts.select("doc_id", "n", F.explode(F.expr(cut)).alias("_p")).select("doc_id", "n", F.col("_p.p").alias("_p"), "_p.off", "_p.d")
    for width in sorted(r.width for r in facts):
        key = F.xxhash64(*(F.get("w", F.col("j") + k) for k in range(width)))
        index = keys.where(F.col("width") == width).select(key.alias("key"), "j", "m", "item", F.get("w", F.col("j") - 1).alias("before")).distinct()
        if index.count() <= BROADCAST_ROWS:
            index = F.broadcast(index)
        at = piece.select("doc_id", "n", "off", "d", F.explode(F.expr(f"sequence(_p * {PIECE}, least((_p + 1) * {PIECE} - 1, n - 1))")).alias("i")).where(F.col("i") <= F.col("n") - width)
        word = lambda k: F.get("d", F.col("i") - F.col("off") + k)
        at = at.select("doc_id", "n", "off", "d", "i", F.xxhash64(*(word(k) for k in range(width))).alias("key"))
        # of two multisets the smaller has at least `similarity` of the larger's shingles
        enough = (F.col("m") <= F.col("n")) | (F.col("n") - (width - 1) >= similarity * (F.col("m") - (width - 1)) - 1e-9)
        # within a stretch the words before agree as well
        first = (F.col("j") == 0) | (F.col("i") == 0) | (word(-1) != F.col("before"))
        hits = at.join(index, "key").where(enough & first)
        starts = F.expr("array_distinct(array(greatest(0, least(i - j, n - m)), greatest(0, least(i, n - m))))")
        hits = hits.select("doc_id", "off", "d", "m", "item", F.explode(starts).alias("start"))
        hits = hits.select("doc_id", "start", "m", "item", F.lit(width).alias("width"), F.expr("slice(d, start - off + 1, m)").alias("w"))
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, n_windows, start, n_words, hamming, similarity of every document that holds an item."""
    known = materialize(items(benchmark), "items")
    texts = known.dropDuplicates(["item"])
    cut = windows(docs, texts, similarity)
    if cut is None:
        cut = known.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("start"), "m", "item", "width", "w").limit(0)
    # windows are few bytes and much work, so they aren't coalesced by size
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(cut.repartition(parts, "doc_id", "start"), "windows").withColumn("s", F.expr(_shingles("w", "width"))).withColumn("fp", F.expr(_fingerprint("s")))
    cut = materialize(cut, "fingerprints")
    left = cut.select("doc_id", "start", "item", "s", "fp", F.explode(_blocks(radius)).alias("x")).select("doc_id", "start", "item", "s", "fp", "x.block", "x.value")
    right = texts.select("item", F.col("s").alias("t"), F.col("fp").alias("fp2"), F.explode(_blocks(radius)).alias("x")).select("item", "t", "fp2", "x.block", "x.value")
    near = left.join(right, ["item", "block", "value"]).withColumn("hamming", F.expr("bit_count(fp ^ fp2)")).where(F.col("hamming") <= radius)
    # a pair meets in every block that agrees; keep it in the first of them only
    n = radius + 1
    low, wide = f"CAST({_BITS} * k DIV {n} AS int)", f"CAST({_BITS} * (k + 1) DIV {n} - {_BITS} * k DIV {n} AS int)"
    near = near.where(f"NOT exists(sequence(0, {radius}), k -> k < block AND shiftrightunsigned(fp ^ fp2, {low}) & (shiftleft(1L, {wide}) - 1) = 0)")
    plain = "size(array_distinct(s)) = size(s) OR size(array_distinct(t)) = size(t)"  # then no shingle counts twice in both
    both = f"CASE WHEN {plain} THEN size(array_intersect(s, t)) ELSE aggregate(array_distinct(s), 0, (n, x) -> n + least(size(filter(s, y -> y = x)), size(filter(t, y -> y = x)))) END"
    scored = near.withColumn("n_words", F.size("s")).withColumn("_b", F.expr(both)).withColumn("similarity", F.expr("_b / (size(s) + size(t) - _b)")).where(F.col("similarity") >= similarity)
    scored = scored.join(known.select("item", "item_id", "m", "width"), "item").withColumn("n_words", F.col("n_words") + F.col("width") - 1)
    best = F.max_by(F.struct("start", F.col("n_words").alias("m"), "hamming", "similarity"), F.struct("similarity", -F.col("start")))
    return scored.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows"), best.alias("b")).select("doc_id", "item_id", "n_windows", "b.start", F.col("b.m").alias("n_words"), "b.hamming", "b.similarity")


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
