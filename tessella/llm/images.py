"""Cropped and edited image copies by local descriptors, Hamming tables and geometric consensus.

An image is a row (image_id, height, width, pixels): grey bytes, row by row. Harris corners are
taken at several scales: of each the strongest, one for AREA pixels but CORNERS at least. Each is turned to its intensity centroid and
described by 256 comparisons of smoothed pixels, so brightness, contrast and rotation don't matter.
Images with equal pixels are one class, named by its smallest image_id, and are described once.
Descriptors are cut into TABLES keys; descriptors of a query and of a class that share a key and
differ in RADIUS bits at most are matches (all within TABLES - 1 bits are found; a copy is missed
only if too few of its corners share a key, and tests hold the pairs against those of all
descriptors). Matches of a
pair vote for scale, turn and shift in overlapping cells; a pair is a copy if VOTES different
corners of the query agree on a cell.

Images that are null, empty, of inconsistent size or smaller than a patch have no descriptors; null
pixels form a class. Repeated rows belong to one class. Null ids are never queries' names in a
result. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

SCALES, CORNERS, AREA = (1.0, 1.5), 16, 196
PATCH, TURNS, BITS = 7, 24, 256
TABLES, RADIUS, VOTES = 4, 24, 5
#: Cells of a vote: octaves of scale, turns of 45 degrees, pixels of shift.
CELL = 6.0
_FEATURES = "k int, y float, x float, scale float, turn int, d array<long>"


def _pattern() -> np.ndarray:
    """Offsets (TURNS, BITS, 2 ends, 2) of the comparisons at each turn.

    A patch brightens along its own orientation, so the two ends lie equally far along it: only
    what the orientation doesn't tell is compared.
    """
    rng = np.random.default_rng(3)
    ends = np.clip(rng.normal(0, PATCH / 2, (BITS, 2, 2)), -PATCH / 1.5, PATCH / 1.5)
    ends[:, 1, 0] = ends[:, 0, 0]
    angle = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.stack([np.stack([np.cos(angle), np.sin(angle)], -1), np.stack([-np.sin(angle), np.cos(angle)], -1)], -2)
    return np.rint(np.einsum("tij,bej->tbei", turn, ends)).astype(np.int64)


_OFFSETS = _pattern()
_DISC = [(y, x) for y in range(-PATCH, PATCH + 1) for x in range(-PATCH, PATCH + 1) if y * y + x * x <= PATCH * PATCH]


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2r + 1, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis, dtype=np.float64)
        n = a.shape[axis]
        a = np.take(c, np.arange(2 * r + 1, 2 * r + 1 + n), axis) - np.take(c, np.arange(n), axis)
    return a


def _resize(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return a
    h, w = int(a.shape[1] / scale), int(a.shape[2] / scale)
    ys, xs = (np.arange(h) + 0.5) * scale - 0.5, (np.arange(w) + 0.5) * scale - 0.5
    y, x = np.clip(ys.astype(int), 0, a.shape[1] - 2), np.clip(xs.astype(int), 0, a.shape[2] - 2)
    fy, fx = (ys - y)[:, None], xs - x
    top = a[:, y][:, :, x] * (1 - fx) + a[:, y][:, :, x + 1] * fx
    low = a[:, y + 1][:, :, x] * (1 - fx) + a[:, y + 1][:, :, x + 1] * fx
    return top * (1 - fy) + low * fy


def describe(stack: np.ndarray):
    """(image, y, x, scale, turn, descriptor as four longs) of the corners of equally large images."""
    out = []
    for scale in SCALES:
        a = _resize(stack.astype(np.float32), scale)
        n, h, w = a.shape
        if min(h, w) <= 2 * PATCH + 2:
            continue
        smooth = _box(a, 1) / 9
        gy, gx = np.gradient(smooth, axis=(1, 2))
        yy, xx, xy = _box(gy * gy, 2), _box(gx * gx, 2), _box(gy * gx, 2)
        r = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
        peak = np.zeros_like(r, bool)
        m = PATCH + 1
        core = r[:, m : h - m, m : w - m]
        peak[:, m : h - m, m : w - m] = core > 1.0
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    peak[:, m : h - m, m : w - m] &= core >= r[:, m + dy : h - m + dy, m + dx : w - m + dx]
        flat = np.where(peak, r, 0).reshape(n, -1)
        top = np.argsort(-flat, axis=1, kind="stable")[:, : max(CORNERS, h * w // AREA)]
        keep = np.take_along_axis(flat, top, 1) > 0
        image = np.nonzero(keep)[0]
        y, x = np.divmod(top[keep], w)
        my = sum(dy * smooth[image, y + dy, x + dx] for dy, dx in _DISC)
        mx = sum(dx * smooth[image, y + dy, x + dx] for dy, dx in _DISC)
        turn = np.rint(np.arctan2(mx, my) / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
        at = _OFFSETS[(TURNS - turn) % TURNS]
        pixel = lambda e: smooth[image[:, None], y[:, None] + at[:, :, e, 0], x[:, None] + at[:, :, e, 1]]
        bits = np.packbits(pixel(0) < pixel(1), axis=1)
        out.append((image, y * scale, x * scale, np.full(len(image), scale), turn, np.ascontiguousarray(bits).view(np.int64)))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5 + [np.zeros((0, 4), np.int64)]


def features(images: DataFrame) -> DataFrame:
    """image_id and one row per corner; columns of images: image_id, height, width, pixels."""

    def run(batches):
        for b in batches:
            groups: dict = {}
            for k, (h, w, p) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)))):
                if p and h and w and h * w == len(p):
                    groups.setdefault((h, w), []).append(k)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            pixels = b.column(3)
            for (h, w), where in groups.items():
                step = max(1, (1 << 20) // (h * w))
                for i in range(0, len(where), step):
                    own = where[i : i + step]
                    stack = np.stack([np.frombuffer(pixels[k].as_py(), np.uint8).reshape(h, w) for k in own])
                    image, y, x, scale, turn, d = describe(stack)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(d) + 1, 4, dtype=np.int32)), pa.array(d.ravel()))
                    # corners of an image by number, over all scales
                    order = np.argsort(image, kind="stable")
                    rank = np.empty(len(image), np.int32)
                    rank[order] = np.arange(len(image)) - np.searchsorted(image[order], image[order])
                    yield pa.record_batch([pa.array(ids[np.array(own)[image]], pa.int64()), pa.array(rank), pa.array(y, pa.float32()), pa.array(x, pa.float32()), pa.array(scale, pa.float32()), pa.array(turn, pa.int32()), lists], names=["image_id", "k", "y", "x", "scale", "turn", "d"])

    return images.where("image_id IS NOT NULL").select("image_id", "height", "width", "pixels").mapInArrow(run, f"image_id long, {_FEATURES}")


def classes(images: DataFrame) -> DataFrame:
    """image_id, class_id: the smallest image_id with the same pixels."""
    key = images.select("image_id", F.sha2(F.concat_ws(",", "height", "width", F.hex("pixels")), 256).alias("key"))
    return key.join(key.groupBy("key").agg(F.min("image_id").alias("class_id")), "key").select("image_id", "class_id")


def copies(queries: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (query_id, class_id, n_votes) of class representatives, and membership (image_id, class_id) of images."""
    member, asked = classes(images), classes(queries)
    single = lambda df, of: df.join(of.where("image_id = class_id").select("image_id").distinct(), "image_id", "left_semi").dropDuplicates(["image_id"])
    known, ask = materialize(features(single(images, member)), "features"), materialize(features(single(queries, asked)), "features")

    def keyed(df: DataFrame, image: str, corner: str) -> DataFrame:
        """One row per table, with a key and no descriptor: the side of all images is long."""
        at = [F.xxhash64(F.lit(t), F.get("d", F.lit(t))) for t in range(TABLES)]
        return df.select(F.col("image_id").alias(image), F.col("k").alias(corner), F.explode(F.array(*at)).alias("key"))

    def named(df: DataFrame, image: str, corner: str, n: int) -> DataFrame:
        return df.select(F.col("image_id").alias(image), F.col("k").alias(corner), *(F.col(a).alias(f"{b}{n}") for a, b in zip(("y", "x", "scale", "turn", "d"), "yxsrd")))

    met = keyed(ask, "query_id", "q").join(keyed(known, "class_id", "c"), "key").drop("key").distinct()
    near = met.join(named(ask, "query_id", "q", 1), ["query_id", "q"]).join(named(known, "class_id", "c", 2), ["class_id", "c"])
    apart = sum(F.bit_count(F.get("d1", F.lit(k)).bitwiseXOR(F.get("d2", F.lit(k)))) for k in range(4))
    near = near.where(apart <= RADIUS)
    turn = (F.col("r2") - F.col("r1")) * (2 * np.pi / TURNS)
    grow = F.col("s2") / F.col("s1")
    ty = F.col("y2") - grow * (F.cos(turn) * F.col("y1") - F.sin(turn) * F.col("x1"))
    tx = F.col("x2") - grow * (F.sin(turn) * F.col("y1") + F.cos(turn) * F.col("x1"))
    half = lambda v, k: F.floor(v / CELL + k / 2)
    octave = F.rint(2 * F.log2(grow))
    eighth = F.pmod(F.rint((F.col("r2") - F.col("r1")) * 8 / TURNS), F.lit(8))
    cells = F.array(*(F.struct(F.lit(2 * a + b).alias("grid"), octave.alias("o"), eighth.alias("e"), half(ty, a).alias("ty"), half(tx, b).alias("tx")) for a in (0, 1) for b in (0, 1)))
    votes = near.select("query_id", "class_id", "y1", "x1", "s1", F.explode(cells).alias("c")).distinct()
    pairs = votes.groupBy("query_id", "class_id", "c").count().groupBy("query_id", "class_id").agg(F.max("count").alias("n_votes"))
    return pairs.where(F.col("n_votes") >= VOTES), member


def render(vectors: DataFrame, edited: bool) -> DataFrame:
    """A grey image of smooth grain drawn from a vector; edited: cropped, and with other contrast."""

    def draw(vector) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(np.rint(np.array(vector, np.float64) * 1000).astype(np.int64).tobytes())
        rng = np.random.default_rng(seed)
        grain = rng.integers(0, 256, (1, 28, 28)).astype(np.float32)
        return _resize(grain, 28 / 56)[0].astype(np.uint8)

    def run(batches):
        for b in batches:
            rows = []
            for vector in b.column(1).to_pylist():
                image = None if vector is None else draw([0.0 if v is None else v for v in vector])
                if image is not None and edited:
                    image = (image[4:53, 3:52] * 0.8 + 20).astype(np.uint8)
                rows.append((None, None, None) if image is None else (*image.shape, image.tobytes()))
            h, w, p = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(p, pa.binary())], names=["image_id", "height", "width", "pixels"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")).mapInArrow(run, "image_id long, height int, width int, pixels binary")


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    """Edited copies of the images of every row divisible by 20, searched in the images of all rows.

    kind `match`: query class, image class, votes; kind `member`: image, its class, null.
    """
    rows = table(spark, sf_dir, "embeddings")
    images = materialize(render(rows, False), "images")
    queries = materialize(render(rows.where("vec_id % 20 = 0"), True), "images")
    pairs, member = copies(queries, images)
    return pairs.select(F.lit("match").alias("kind"), F.col("query_id").alias("vec_id"), "class_id", "n_votes").unionByName(
        member.select(F.lit("member").alias("kind"), F.col("image_id").alias("vec_id"), "class_id", F.lit(None).cast("long").alias("n_votes"))
    )
