"""SimHash near-duplicate groups, searched exactly with sharded vantage-point trees.

Fingerprints take word shingles with repeats; a bit is 1 if it is set in over half of the shingle
hashes. Equal fingerprints are one point. The 64 bits are cut into one block more than the radius, so
both ends of a link agree in a block: each point goes to one shard a block, named by the block's first
bits, as many as leave about CELL points a shard. Every point is thus dealt out four times at radius 3
however many there are. A shard of over SHARD points, as fingerprints much alike make it, is dealt on
by a tree of vantage points, fitted on a sample of PER_SHARD points for each shard's worth (at least
SAMPLE): a point whose distance to a vantage point is within the radius
below a boundary goes to both sides, so by the triangle bound |d(x, v) - d(y, v)| <= d(x, y) both
ends of every link share a shard. Every shard builds its own tree in the same way. Shards return
spanning links only, so a group of m near copies costs at most m links per shard.

Null and empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id
yield a row each; a null doc_id gets its group's component. An empty table gives no rows. Further
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, materialize, small_batches, trimmed

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Points that a block's value should leave in a shard, and bits of a value at most.
CELL, MOST_BITS = 4096, 24
#: Points that a shard may hold, points of the upper tree's sample for each, and its least size.
SHARD, PER_SHARD, SAMPLE = 16384, 64, 8192
#: Vantage points tried for a split on so many points, and the share of pairs up to which it is worth it.
TRIES, PROBE, WORTH = 8, 2048, 0.9
_LEAF = 512


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """SimHash of a text's word shingles; 0 without words."""
    words = text.lower().split()
    n = max(1, len(words) - width + 1)
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, width) for t in byte_texts(b.column(1))), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return small_batches(texts).mapInArrow(trimmed(run), "doc_id long, fp long")


def _distance(points: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ v).astype(np.int16)


def _split(points: np.ndarray, radius: int) -> tuple[float, np.uint64, int]:
    """(share of the pairs that are left, vantage point, boundary) of the best split of points.

    The sides are d <= mu and d > mu - radius; of TRIES vantage points and all boundaries it is the
    one with the least sum of squared sizes, estimated on at most PROBE points.
    """
    probe = points[:: max(1, len(points) // PROBE)]
    best = (1.0, points[0], 0)
    for v in probe[:: max(1, len(probe) // TRIES)][:TRIES]:
        below = np.cumsum(np.bincount(_distance(probe, v), minlength=65)) / len(probe)
        mu = np.arange(radius, 64)
        inside, outside = below[mu], 1 - below[mu - radius]
        share = np.where((inside < 1) & (outside < 1), inside**2 + outside**2, 1.0)
        k = int(share.argmin())
        if share[k] < best[0]:
            best = (float(share[k]), v, int(mu[k]))
    return best


def upper_tree(sample: np.ndarray, most: float, radius: int) -> tuple[list[tuple], int]:
    """Nodes (vantage, radius, inside, outside), root first, and the number of shards; a negative child -1-k is shard k.

    A side is split on while it has over `most` points of the sample and a split is worth it.
    """
    nodes: list[tuple] = []
    leaves = 0

    def grow(points: np.ndarray) -> int:
        nonlocal leaves
        if len(points) > max(most, 2):
            share, v, mu = _split(points, radius)
            if share < WORTH:
                d = _distance(points, v)
                k = len(nodes)
                nodes.append(())
                inside = grow(points[d <= mu])
                nodes[k] = (int(v), mu, inside, grow(points[d > mu - radius]))
                return k
        leaves += 1
        return -leaves

    grow(np.unique(sample))
    return nodes, leaves


def route(points: np.ndarray, nodes: list[tuple], radius: int):
    """(point index, shard): shards cover the points so that both ends of every link share one.

    A node's two sides are d <= mu and d > mu - radius. Of two points that share neither side one
    has d <= mu - radius and the other d > mu, so they are more than `radius` bits apart.
    """
    stack = [(0 if nodes else -1, np.arange(len(points)))]
    while stack:
        k, idx = stack.pop()
        if not len(idx):
            continue
        if k < 0:
            yield idx, -1 - k
            continue
        v, mu, inside, outside = nodes[k]
        d = _distance(points[idx], np.uint64(v))
        stack += [(inside, idx[d <= mu]), (outside, idx[d > mu - radius])]


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each component of n nodes."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def shard_links(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between points of a shard, found with a vantage-point tree over them."""
    n, found = len(points), [[], []]
    held = 0

    def link(a: np.ndarray, b) -> None:
        nonlocal held
        found[0].append(a)
        found[1].append(np.broadcast_to(b, a.shape))
        held += len(a)
        if held > 2_000_000:
            label = _labels(n, np.concatenate(found[0]), np.concatenate(found[1]))
            rest = np.flatnonzero(label != np.arange(n))
            found[0], found[1], held = [rest], [label[rest]], 0

    stack = [np.arange(n)]
    while stack:
        own = stack.pop()
        if len(own) > _LEAF:
            share, v, mu = _split(points[own], radius)
            d = _distance(points[own], v)
            link(own[d <= radius], int(own[d.argmin()]))  # v is one of them
            if 2 * int(d.max()) <= radius:
                continue  # any two of them are linked, and all are linked to v
            if share < WORTH:
                stack += [own[d <= mu], own[d > mu - radius]]
                continue
        for i in range(0, len(own), 256):
            part = own[i : i + 256]
            for j in range(i, len(own), 1 << 14):
                other = own[j : j + (1 << 14)]
                x, y = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[other][None, :]) <= radius)
                keep = part[x] < other[y]
                link(part[x[keep]], other[y[keep]])
    if not found[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = _labels(n, np.concatenate(found[0]), np.concatenate(found[1]))
    rest = np.flatnonzero(label != np.arange(n))
    return rest, label[rest]


def blocks_of(n: int, radius: int) -> tuple[int, int]:
    """(blocks, bits of each that name a shard) for n points; (1, 0) if one shard is as good.

    Of radius + 1 blocks two points within the radius share one, so they share its first bits.
    """
    blocks = radius + 1
    width = min(64 // blocks, MOST_BITS)
    worth = next((b for b in range(width + 1) if blocks < WORTH * (1 << b)), None)
    if n <= CELL or worth is None:
        return 1, 0
    return blocks, min(width, max(worth, (-(-n // CELL) - 1).bit_length()))


def cells(points: np.ndarray, blocks: int, bits: int):
    """(points' cells) of each block: block << bits | the block's first bits."""
    for k in range(blocks):
        yield (np.uint64(k << bits) | points >> np.uint64(64 * k // blocks) & np.uint64((1 << bits) - 1)).astype(np.int64)


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: spanning links between distinct fingerprints (column fp) at most `radius` bits apart."""
    points = points.select("fp")
    blocks, bits = blocks_of(points.count(), radius)
    shards = blocks << bits

    def sizes(batches):
        for b in batches:
            for own in cells(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), blocks, bits):
                cell, m = np.unique(own, return_counts=True)
                yield pa.record_batch([pa.array(cell), pa.array(m)], names=["cell", "m"])

    crowded = {r.cell: r.m for r in points.mapInArrow(sizes, "cell long, m long").groupBy("cell").agg(F.sum("m").alias("m")).where(F.col("m") > SHARD).collect()}
    trees: dict[int, tuple[list[tuple], int]] = {}
    if crowded:
        share = {c: min(1.0, max(SAMPLE, PER_SHARD * -(-m // SHARD)) / m) for c, m in crowded.items()}

        def some(batches):
            for b in batches:
                fps, u = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for own in cells(fps.view(np.uint64), blocks, bits):
                    at = np.flatnonzero(u < np.array([share.get(c, 0.0) for c in own.tolist()]))
                    yield pa.record_batch([pa.array(own[at]), pa.array(fps[at])], names=["cell", "fp"])

        drawn = F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        got = points.select("fp", drawn.alias("u")).mapInArrow(some, "cell long, fp long").toArrow()
        cell, fps = got.column("cell").to_numpy(), got.column("fp").to_numpy().view(np.uint64)
        for c, m in sorted(crowded.items()):
            sample = fps[cell == c]
            nodes, leaves = upper_tree(sample, SHARD * len(sample) / m, radius)
            trees[c] = nodes, shards
            shards += leaves

    def deal(batches):
        full = np.array(sorted(trees), np.int64)
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for own in cells(fps.view(np.uint64), blocks, bits):
                much = np.isin(own, full)
                yield pa.record_batch([pa.array(own[~much]), pa.array(fps[~much])], names=["shard", "fp"])
                for c in np.unique(own[much]).tolist():
                    nodes, first = trees[c]
                    inside = fps[own == c]
                    for idx, shard in route(inside.view(np.uint64), nodes, radius):
                        yield pa.record_batch([pa.array(np.full(len(idx), first + shard)), pa.array(inside[idx])], names=["shard", "fp"])

    def search(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy()
        a, b = shard_links(fps.view(np.uint64), radius)
        return pa.table({"a": fps[a], "b": fps[b]})

    dealt = points.mapInArrow(deal, "shard long, fp long")
    # shards are few bytes and much work: partitions by their number, not coalesced by size
    parts = -(-(blocks << bits) // 4) + 2 * (shards - (blocks << bits))
    return dealt.repartition(parts, "shard").groupBy("shard").applyInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of an undirected edge list a, b.

    Alternates large-star and small-star steps, so long chains shrink in about log n rounds and
    no node's neighbours are ever gathered in one row.
    """
    ordered = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = materialize(ordered(edges), "edges")
    before = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = state.union(state.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        state = ordered(large)
        low = state.groupBy("u").agg(F.min("v").alias("m"))
        small = state.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        state = materialize(ordered(small.union(low.select("u", "m"))), "edges")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over fingerprints `radius` bits apart."""
    fps = materialize(fingerprints(docs, width), "fingerprints")
    points = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    roots = components(links(points, radius))
    rooted = points.join(roots, points.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
