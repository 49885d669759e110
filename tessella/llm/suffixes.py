"""Exact removal of repeated byte strings with sharded logarithmic families of suffix arrays.

A byte goes if a WINDOW-byte string that covers it also starts earlier: in a document of smaller
doc_id, or earlier in the same one. Matches never cross documents.

1. Documents are packed into batches. In every window the K-byte gram of least hash is its anchor,
   so equal windows have the same anchor at the same place. Runs of windows with one anchor form a
   segment (about 43 windows). Per batch and distinct gram, four bytes of its hash go to a shard.
2. Shards answer which grams of a batch occur twice anywhere. A false answer costs time only.
3. Batches cut the segments of such grams out. Of equal segments within a batch only the earliest
   is sent on; the others are repeats. Segments are dealt by their gram, or, for grams of at least
   HOT places in all, window by window by the window's hash, so that one passage in any share of all documents
   is spread and pre-aggregated.
4. Each shard takes its segments in the order of documents, in batches. A batch gets a suffix
   array: its window starts in the order of their first eight bytes, then of a 64-bit hash of the
   whole window, with their places. It is searched in every level of the shard's index for windows
   that occur earlier, and joins the index as a level; levels of equal size merge geometrically.
   Windows with equal keys are compared byte by byte.
5. Batches unite the repeated windows and cut them out.

There is a row for each batch and shard that share a gram, at most one for each gram of a batch. Null and empty texts,
and those shorter than WINDOW bytes, lose nothing. Rows with one doc_id count as separate
documents in the order in which they were packed; null doc_ids come first. An empty table gives no
rows. Further columns are ignored. Everything between the steps is written to the shared folder,
so lost executors repeat tasks, never change batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, materialize, small_batches, table, trimmed

WINDOW, GRAM = 100, 32
#: Text bytes of a batch (its documents stay whole), and of the input for each shard; a small input
#: is dealt to SPREAD shards all the same.
BATCH_BYTES, SHARD_BYTES, SPREAD = 1 << 22, 1 << 25, 96
HOT = 4096
_PLACE_BITS = 19
_SPAN = WINDOW - GRAM + 1
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Windows of a batch of an index, at least and at most.
_LEAST_BATCH, _MOST_BATCH = 8192, 65536


def _power(k: int) -> np.uint64:
    return _U(pow(_BASE, k, 1 << 64))


def _rolling(x: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hashes of the strings of 1, 2, 4, ... bytes at each place; those of `sizes`."""
    h, n, kept = x.astype(np.uint64) + _U(1), 1, {}
    kept[1] = h
    while n < max(sizes):
        h = h[:-n] * _power(n) + h[n:]
        n *= 2
        if n in sizes:
            kept[n] = h
    return [kept[s] for s in sizes]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(31))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _chunk_segments(x: np.ndarray, lens: np.ndarray):
    """(document, first window, windows, gram hash) of the segments of a chunk of documents."""
    n, ends = len(x), np.cumsum(lens)
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = _mix(_rolling(x, (GRAM,))[0])
    mask = _U((1 << _PLACE_BITS) - 1)
    m = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= _SPAN:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < _SPAN:
        m = np.minimum(m[: -(_SPAN - width)], m[_SPAN - width :])
    anchor = (m & mask).astype(np.int64)
    turn = np.zeros(len(anchor) + 1, np.int8)
    long = lens >= WINDOW
    np.add.at(turn, (ends - lens)[long], 1)
    np.add.at(turn, (ends - WINDOW + 1)[long], -1)
    valid = np.cumsum(turn[:-1], dtype=np.int8) > 0
    anchor[~valid] = -1
    new = np.r_[True, anchor[1:] != anchor[:-1]] & valid
    last = np.r_[anchor[1:] != anchor[:-1], True] & valid
    first = np.flatnonzero(new)
    count = np.flatnonzero(last) - first + 1
    doc = np.searchsorted(ends, first, "right")
    return doc, first - (ends - lens)[doc], count, h[anchor[first]]


def segments(texts: list[bytes]):
    """(document, first window, windows, gram hash) of all segments of a batch."""
    most = 1 << _PLACE_BITS
    out, i = [], 0
    while i < len(texts):
        if len(texts[i]) > most:
            x, step = np.frombuffer(texts[i], np.uint8), most - WINDOW + 1
            for a in range(0, len(x) - WINDOW + 1, step):
                part = x[a : a + most]
                doc, p, n, h = _chunk_segments(part, np.array([len(part)]))
                out.append((doc + i, p + a, n, h))
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) <= most:
            size += len(texts[j])
            j += 1
        doc, p, n, h = _chunk_segments(np.frombuffer(b"".join(texts[i:j]), np.uint8), np.array([len(t) for t in texts[i:j]]))
        out.append((doc + i, p, n, h))
        i = j
    return tuple(np.concatenate(c) for c in zip(*out))


def _pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * (1 + len(kinds)), []
    for size, kind in zip(np.frombuffer(data, np.int64, len(kinds), 8), kinds):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def _batch(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    """doc_ids (null: the least long) and texts of a packed batch."""
    ids, lens, data = _unpack(blob, np.int64, np.int64, np.uint8)
    ends, raw = np.cumsum(lens).tolist(), data.tobytes()
    return ids, [raw[e - n : e] for e, n in zip(ends, lens.tolist())]


def _by_shard(shard: np.ndarray):
    """(shard, places) for each shard that occurs."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0])
    for a, b in zip(cut, np.r_[cut[1:], len(order)]):
        yield int(shard[order[a]]), order[a:b]


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[] for _ in schema], schema)], schema=schema)


_NULL = -(1 << 63)
_KEYED = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("batch", pa.int64()), ("blob", pa.binary())])
_SQL = "kind int, key long, batch long, blob binary"


def _write_batches(docs: DataFrame, shards: int) -> DataFrame:
    """kind 0: packed batches by batch; kind 1: the distinct grams of each batch by shard."""

    def emit(ids, texts, batch):
        lens = np.array([len(t) for t in texts], np.int64)
        rows = [(0, batch, batch, _pack(np.array(ids, np.int64), lens, np.frombuffer(b"".join(texts), np.uint8), level=4))]
        gram, count = np.unique(segments(texts)[3], return_counts=True)
        for shard, at in _by_shard((gram % _U(shards)).astype(np.int64)):
            rows.append((1, shard, batch, _pack((gram[at] // _U(shards)).astype(np.uint32), np.minimum(count[at], 1 << 30).astype(np.int32))))
        yield from _rows(_KEYED, rows).to_batches()

    def run(batches):
        base, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), byte_texts(b.column(1))):
                if texts and size + len(t) > BATCH_BYTES:
                    yield from emit(ids, texts, base)
                    base, ids, texts, size = base + 1, [], [], 0
                ids.append(_NULL if k is None else k)
                texts.append(t)
                size += len(t)
        if texts:
            yield from emit(ids, texts, base)

    return small_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(trimmed(run), _SQL)


def _repeated_grams(group: pa.Table) -> pa.Table:
    """For each batch of a shard: 0 for a gram that occurs once in all, 1 for more often, 2 for HOT ones."""
    batches = group.column("batch").to_pylist()
    parts = [_unpack(b, np.uint32, np.int32) for b in group.column("blob").to_pylist()]
    gram = np.concatenate([p[0] for p in parts])
    _, where = np.unique(gram, return_inverse=True)
    total = np.bincount(where, np.concatenate([p[1] for p in parts]))[where]
    answer = (1 * (total > 1) + (total >= HOT)).astype(np.uint8)
    shard, at, rows = group.column("key")[0].as_py(), 0, []
    for batch, p in zip(batches, parts):
        mine = answer[at : at + len(p[0])]
        at += len(p[0])
        if mine.any():
            rows.append((2, batch, shard, _pack(mine)))
    return _rows(_KEYED, rows)


def _cut_segments(shards: int):
    """kind 3: segments to match by shard; kind 4: repeats found within the batch."""

    def run(group: pa.Table) -> pa.Table:
        batch = group.column("key")[0].as_py()
        answers, blob = {}, None
        for kind, other, data in zip(group.column("kind").to_pylist(), group.column("batch").to_pylist(), group.column("blob").to_pylist()):
            if kind == 0:
                blob = data
            else:
                answers[other] = data
        if not answers:
            return _rows(_KEYED, [])
        ids, texts = _batch(blob)
        doc, first, count, h = segments(texts)
        gram, where = np.unique(h, return_inverse=True)
        state = np.zeros(len(gram), np.uint8)
        for shard, at in _by_shard((gram % _U(shards)).astype(np.int64)):
            if shard in answers:
                state[at] = _unpack(answers[shard], np.uint8)[0]
        state = state[where]
        pick = np.flatnonzero(state)
        pick = pick[np.lexsort((first[pick], doc[pick], ids[doc[pick]]))]
        doc, first, count, h, state = doc[pick], first[pick], count[pick], h[pick], state[pick]
        cuts = [texts[d][a : a + n + WINDOW - 1] for d, a, n in zip(doc.tolist(), first.tolist(), count.tolist())]
        seen: set[bytes] = set()
        again = np.zeros(len(cuts), bool)
        for k, c in enumerate(cuts):
            if c in seen:
                again[k] = True
            else:
                seen.add(c)
        rows = []
        if again.any():
            rows.append((4, batch, batch, _pack(doc[again].astype(np.int32), first[again], (first + count + WINDOW - 1)[again])))
        hot = np.flatnonzero((state == 2) & ~again)
        cold = np.flatnonzero((state < 2) & ~again)
        d, p, n, key, parts = doc[cold], first[cold], count[cold], h[cold], [cuts[k] for k in cold.tolist()]
        if len(hot):
            windows, ws, wd, wp, repeats = {}, [], [], [], []
            for k in hot.tolist():
                for i in range(int(count[k])):
                    w = cuts[k][i : i + WINDOW]
                    if w in windows:
                        repeats.append((int(doc[k]), int(first[k]) + i))
                    else:
                        windows[w] = len(ws)
                        ws.append(w)
                        wd.append(int(doc[k]))
                        wp.append(int(first[k]) + i)
            if repeats:
                r = np.array(repeats, np.int64)
                rows.append((4, batch, batch, _pack(r[:, 0].astype(np.int32), r[:, 1], r[:, 1] + WINDOW)))
            x = np.frombuffer(b"".join(ws), np.uint8)
            key = np.r_[key, _mix(_window_hash(x)[::WINDOW])]
            d, p, n, parts = np.r_[d, wd], np.r_[p, wp], np.r_[n, np.ones(len(ws), np.int64)], parts + ws
        for shard, at in _by_shard((key % _U(shards)).astype(np.int64)):
            data = np.frombuffer(b"".join([parts[k] for k in at.tolist()]), np.uint8)
            rows.append((3, shard, batch, _pack(ids[d[at]], d[at].astype(np.int32), p[at].astype(np.int64), n[at].astype(np.int32), data)))
        return _rows(_KEYED, rows)

    return run


def _window_hash(x: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW = 64 + 32 + 4 bytes at each place."""
    h4, h32, h64 = _rolling(x, (4, 32, 64))
    n = len(x) - WINDOW + 1
    return (h64[:n] * _power(32) + h32[64 : 64 + n]) * _power(4) + h4[96 : 96 + n]


class SuffixFamily:
    """Levels of sorted window keys with places; later windows are looked up in all of them.

    same(a, b): which of the windows at places a and b agree byte by byte.
    """

    def __init__(self, same=None):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.same = same or (lambda a, b: np.ones(len(a), bool))
        self.odd: list[int] = []  # windows whose key another window took first

    def add(self, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Adds a batch of window keys in the order of their places; true for those seen before."""
        order = np.argsort(keys, kind="stable")
        array, place = keys[order], places[order]
        first = np.r_[True, array[1:] != array[:-1]] if len(array) else np.zeros(0, bool)
        before = np.where(first, -1, place[np.maximum.accumulate(np.where(first, np.arange(len(array)), 0))]) if len(array) else place
        for level, at_place in self.levels:
            at = np.minimum(np.searchsorted(level, array), len(level) - 1)
            hit = level[at] == array
            before = np.where(hit, at_place[at], before)
        again = before >= 0
        check = np.flatnonzero(again)
        wrong = check[~self.same(place[check], before[check])]
        for k in wrong[np.argsort(place[wrong], kind="stable")].tolist():  # equal keys of different windows: one in 2^64
            one = np.full(len(self.odd), place[k])
            if not (len(self.odd) and self.same(one, np.array(self.odd)).any()):
                again[k] = False
                self.odd.append(int(place[k]))
        out = np.zeros(len(keys), bool)
        out[order] = again
        fresh = before < 0
        if fresh.any():
            self.levels.append((array[fresh], place[fresh]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (b, y), (a, x) = self.levels.pop(), self.levels.pop()
            both = np.concatenate([a, b])
            order = np.argsort(both, kind="stable")
            self.levels.append((both[order], np.concatenate([x, y])[order]))
        return out


def _agree(x: np.ndarray):
    """Compares windows of x by their places, in bounded steps."""
    view = np.lib.stride_tricks.sliding_window_view(x, WINDOW) if len(x) >= WINDOW else None

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for i in range(0, len(a), 1 << 15):
            out[i : i + (1 << 15)] = (view[a[i : i + (1 << 15)]] == view[b[i : i + (1 << 15)]]).all(axis=1)
        return out

    return same


def suffix_keys(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sort keys of the windows that start at `places`: their first eight bytes, then a hash of all."""
    key = np.empty((len(places), 2), ">u8")
    head = x.astype(np.uint64)
    for n in (1, 2, 4):
        head = (head[:-n] << _U(8 * n)) | head[n:]
    key[:, 0] = head[places]
    key[:, 1] = _window_hash(x)[places]
    return key.view("S16").ravel()


def _match(group: pa.Table) -> pa.Table:
    """kind 4: the repeats among a shard's segments, by batch."""
    parts = [(b, *_unpack(blob, np.int64, np.int32, np.int64, np.int32, np.uint8)) for b, blob in zip(group.column("batch").to_pylist(), group.column("blob").to_pylist())]
    batch = np.concatenate([np.full(len(p[1]), p[0]) for p in parts])
    ids, doc, first, count = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4))
    x = np.concatenate([p[5] for p in parts])
    size = count.astype(np.int64) + WINDOW - 1
    begin = np.cumsum(size) - size
    order = np.lexsort((first, doc, batch, ids))
    windows = np.cumsum(count[order])
    step = min(_MOST_BATCH, max(_LEAST_BATCH, -(-int(windows[-1]) // 8)))
    family, found, i = SuffixFamily(_agree(x)), [], 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(windows, (windows[i - 1] if i else 0) + step, "right")))
        own = order[i:j]
        n = count[own].astype(np.int64)
        owner = np.repeat(np.arange(len(own)), n)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        near = np.concatenate([x[b : b + s] for b, s in zip(begin[own].tolist(), size[own].tolist())])
        keys = suffix_keys(near, np.repeat(np.cumsum(size[own]) - size[own], n) + inside)
        again = np.flatnonzero(family.add(keys, begin[own][owner] + inside))
        if len(again):
            s = own[owner[again]]
            place = first[s] + inside[again]
            found.append((batch[s], doc[s], place))
        i = j
    if not found:
        return _rows(_KEYED, [])
    b, d, p = (np.concatenate(c) for c in zip(*found))
    rows = []
    for one, at in _by_shard(b):
        k = at[np.lexsort((p[at], d[at]))]
        new = np.r_[True, (d[k][1:] != d[k][:-1]) | (p[k][1:] != p[k][:-1] + 1)]
        a = np.flatnonzero(new)
        z = np.r_[a[1:], len(k)] - 1
        rows.append((4, one, one, _pack(d[k][a].astype(np.int32), p[k][a], p[k][z] + WINDOW)))
    return _rows(_KEYED, rows)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
_OUT_SQL = "doc_id long, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept binary"


def _finish(group: pa.Table) -> pa.Table:
    found, blob = [], None
    for kind, data in zip(group.column("kind").to_pylist(), group.column("blob").to_pylist()):
        if kind == 0:
            blob = data
        else:
            found.append(_unpack(data, np.int32, np.int64, np.int64))
    ids, texts = _batch(blob)
    spans: dict[int, list] = {}
    if found:
        d, a, z = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((a, d))
        for k, s, e in zip(d[order].tolist(), a[order].tolist(), z[order].tolist()):
            own = spans.setdefault(k, [])
            if own and s <= own[-1][1]:
                own[-1][1] = max(own[-1][1], e)
            else:
                own.append([s, e])
    removed, kept = [], []
    for k, t in enumerate(texts):
        at, left, own = 0, [], spans.get(k, [])
        for s, e in own:
            left.append(t[at:s])
            at = e
        kept.append(b"".join(left) + t[at:] if own else t)
        removed.append([{"start": s, "end": e} for s, e in own])
    return pa.table([pa.array([None if k == _NULL else k for k in ids.tolist()], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, _OUT.field("removed").type), pa.array(kept, pa.binary())], schema=_OUT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (byte spans, maximal and in order) and kept (the remaining bytes)."""
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(-(-total // SHARD_BYTES), min(SPREAD, 1 + (total >> 20)))
    dealt = materialize(_write_batches(docs, shards), "batches", "kind")
    texts, grams = dealt.where("kind = 0"), dealt.where("kind = 1")
    answers = grams.groupBy("key").applyInArrow(_repeated_grams, _SQL)
    cut = materialize(texts.unionByName(answers).groupBy("key").applyInArrow(_cut_segments(shards), _SQL), "segments", "kind")
    matched = cut.where("kind = 3").groupBy("key").applyInArrow(_match, _SQL)
    marks = cut.where("kind = 4").unionByName(matched)
    return texts.unionByName(marks).groupBy("key").applyInArrow(_finish, _OUT_SQL)


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
