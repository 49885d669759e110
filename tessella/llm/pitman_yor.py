"""Language-model scores from a hierarchical Pitman-Yor process.

Tokens are words in lower case (A-Z) and one end per text. Three families of restaurants are joined:

* Contexts: the restaurant of each training word, and of a text's begin, seats the words that follow
  it. Every training pair is a dish of its own, however rare. New tables draw from the word restaurant.
* Words: the restaurant of all training words; its customers are the contexts' tables. New tables draw a
  spelling.
* Spellings: restaurants per context of up to three bytes, each of whose new tables draws from the
  restaurant of the shorter context, down to a uniform draw. Older bytes count by class (64, 32 and
  32 classes), so there are at most 65536 restaurants of 257 dishes whatever the corpus.

Customers of a parent are its children's tables; of a word, the mean of its samples' tables in all contexts.

Seating is sampled by Gibbs in blocks: in a sweep all customers of a dish leave and are seated anew.
Given the mass M of new tables in their restaurant, which is held within a sweep, c customers whose
dish the parent draws with probability g take t tables with probability in proportion to
(M g)^t S(c, t), S being the generalised Stirling numbers of the discount. Up to _EXACT customers
they are tabulated; beyond that S follows its scaling law in t / c^discount. Random numbers are
hashes of dish and sweep, so neither partitions nor repeated tasks change a draw. Predictive
probabilities are averaged over SAMPLES sweeps; each of them sums to one with the tables it has.
The word restaurant has one draw of all words per sample; while contexts are seated, their parent is
held at the words' shares of the training tokens. Words that no training text holds are
one type, as they are for the base score: its probability is that of a new table times the mass
that the spelling model leaves to words not seen. Discounts come from counts of counts, those of contexts
and the concentration, from leaving out each pair, by bucket.

Counting, seating and scoring run in Spark tasks. The driver gets the spelling counts (65536 * 257 at
most) and how many words there are of each count (at most the root of twice the training tokens), and
sends them to the tasks. Documents stay in the block that read them: their distinct words are asked for
by block, and answers return to it. Questions and answers go packed, a row for each block and shard of the
words; a shard has its training words once, with places that answers are looked up by. A block's distinct
pairs go, packed, to buckets of contexts, a row for each block and bucket; a bucket has all pairs of its
contexts, seats them and answers each block, and tells its words' tables to shards of the words' numbers.

A null text is empty; an empty text has its end only. Repeated rows get a row each and count each
in training; a null doc_id is not held out. An empty table gives no rows. Without training tokens
the base score takes N = V = 0 and the model its spelling base. Further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, mark, materialize, release, small_batches, table, trimmed

#: Text bytes of a block of documents.
BLOCK_BYTES = 1 << 24
#: Training tokens that a bucket of contexts has on average.
BUCKET_TOKENS = 1 << 22
#: Text bytes for which words get one shard, and shards at least.
SHARD_BYTES, LEAST_SHARDS = 1 << 27, 48
#: A share of the tokens that words of a Contexts table have; scores don't depend on it.
FREQUENT = 1 << 15
CONCENTRATION, BURN_IN, SAMPLES = 1.0, 6, 4
#: Sweeps before the samples of contexts, whose parent is held.
CONTEXT_BURN_IN = 2
#: Concentrations of contexts of which the one that best predicts each training pair from all others is taken.
CONTEXT_CONCENTRATIONS = (1.0, 16.0, 256.0, 4096.0)
_CLASSES = (64, 32, 32)
_SYMBOLS = 257  # bytes, and the end of a word
_EXACT, _GRID = 256, 128


def uniform(key: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on key and stream only."""
    x = key.astype(np.uint64) + np.uint64((stream + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 + 2.0**-54


def discount(types: int, once: int, twice: int) -> float:
    """From counts of counts: the lesser of the leave-one-out estimate and the share of types seen once."""
    return min(0.95, max(0.1, min(once / (once + 2 * twice), once / types))) if once else 0.1


def discount_of(counts: np.ndarray) -> float:
    return discount(len(counts), int((counts == 1).sum()), int((counts == 2).sum()))


_FACTORIAL = np.r_[0.0, np.cumsum(np.log(np.arange(1, 1 << 14)))]


def _log_factorial(t: np.ndarray) -> np.ndarray:
    """ln t! of whole numbers from 1 on; beyond the table by Stirling's series, exact to 1e-9."""
    out = _FACTORIAL[np.minimum(t, len(_FACTORIAL) - 1).astype(np.int64)]
    high = t >= len(_FACTORIAL)
    if high.any():
        x = t[high] + 1.0
        out[high] = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x)
    return out


@lru_cache(maxsize=16)
def seats_of(less: float) -> Seats:
    """Tables are built once a process for each discount."""
    return Seats(less)


class Seats:
    """Draws of table counts under one discount."""

    def __init__(self, less: float):
        self.less = less
        log_s = np.full((_EXACT + 1, _EXACT + 2), -np.inf)
        log_s[1, 1] = 0.0
        for c in range(1, _EXACT):
            t = np.arange(1, c + 1)
            log_s[c + 1, 1 : c + 1] = log_s[c, 1 : c + 1] + np.log(c - less * t)
            log_s[c + 1, 1 : c + 2] = np.logaddexp(log_s[c + 1, 1 : c + 2], log_s[c, : c + 1])
        self.log_s = log_s[:, 1 : _EXACT + 1]
        t = np.arange(1, _EXACT + 1)
        # S(c, t) t! less^t / c! is the chance that t heavy-tailed sizes sum to c: a function of t / c^less over c
        self.place = t / _EXACT**less
        self.law = self.log_s[_EXACT] + _log_factorial(t) + t * np.log(less) - np.log(self.place)

    def draw(self, customers: np.ndarray, weight: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Tables of each dish; weight: mass of new tables times the parent's probability."""
        out = np.minimum(customers, 1).astype(np.int64)
        log_w = np.log(np.maximum(weight, 1e-300))
        # table counts beyond `width` have no chance: they fall off as Poisson ones of this mean, or faster
        lam = np.exp(np.minimum(log_w - np.log(self.less), 60))
        width = np.minimum(np.ceil(lam + 8 * np.sqrt(lam) + 16), customers)
        small = np.flatnonzero((customers > 1) & (customers <= _EXACT))
        small = small[np.argsort(width[small], kind="stable")]
        a = 0
        while a < len(small):
            own = small[a : a + 4096]
            w = int(width[own[-1]])
            out[own] = 1 + self._pick(log_w[own, None] * np.arange(1, w + 1) + self.log_s[customers[own], :w], u[own])
            a += len(own)
        large = np.flatnonzero(customers > _EXACT)
        large = large[np.argsort(width[large], kind="stable")]
        for i in range(0, len(large), 4096):
            own = large[i : i + 4096]
            c, log_l = customers[own].astype(np.float64), log_w[own] - np.log(self.less)
            scale = c**-self.less
            low, high = np.ones(len(own)), np.minimum(width[own], 4 * self.place[-1] / scale + 30)
            for step in range(3):  # a grid over the whole range, then twice over where the mass is
                points = int(min(_GRID, (high - low).max() + 1))
                grid = np.rint(low[:, None] + np.maximum(high - low, points - 1 if points < _GRID else 0)[:, None] * np.linspace(0, 1, points))
                p = self._log_p(grid, log_l, scale)
                if points < _GRID or step == 2:
                    break
                near = p > p.max(axis=1, keepdims=True) - 30
                gap = np.ceil((high - low) / (points - 1)) + 1
                first = np.take_along_axis(grid, near.argmax(axis=1)[:, None], 1)[:, 0]
                last = np.take_along_axis(grid, (points - 1 - near[:, ::-1].argmax(axis=1))[:, None], 1)[:, 0]
                low, high = np.maximum(first - gap, 1), np.minimum(last + gap, c)
            p = np.where((np.diff(grid, prepend=0, axis=1) > 0) & (grid <= c[:, None]), p, -np.inf)
            out[own] = np.take_along_axis(grid, self._pick(p, u[own])[:, None], 1)[:, 0].astype(np.int64)
        return out

    def _log_p(self, t: np.ndarray, log_l: np.ndarray, scale: np.ndarray) -> np.ndarray:
        at = t * scale[:, None]
        over = np.maximum(at - self.place[-1], 0) * (self.law[-1] - self.law[-2]) / (self.place[-1] - self.place[-2])
        return t * log_l[:, None] - _log_factorial(t) + np.log(at) + np.interp(at, self.place, self.law) + over

    @staticmethod
    def _pick(log_p: np.ndarray, u: np.ndarray) -> np.ndarray:
        up = np.cumsum(np.exp(log_p - log_p.max(axis=1, keepdims=True)), axis=1)
        return np.minimum((up < u[:, None] * up[:, -1:]).sum(axis=1), log_p.shape[1] - 1)


class Spelling:
    """Predictive probabilities of the next symbol after up to three bytes of context, a column a sample."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        """key: context * 257 + symbol, with the context's classes packed newest first."""
        self.keys = [key]
        for shrink in reversed(_CLASSES):
            self.keys.append(np.unique(self._parent(self.keys[-1], shrink)))
        up = [np.searchsorted(b, self._parent(a, s)) for a, b, s in zip(self.keys, self.keys[1:], reversed(_CLASSES))]
        self.context = [np.unique(k // _SYMBOLS, return_inverse=True) for k in self.keys]
        customers, levels = [count.astype(np.int64)], len(self.keys)
        for level in range(levels - 1):  # one table a dish, to begin with
            customers.append(np.bincount(up[level], minlength=len(self.keys[level + 1])))
        seats = [Seats(discount_of(c)) for c in customers]
        tables = [np.minimum(c, 1) for c in customers]
        self.p = [np.zeros((len(k), SAMPLES)) for k in self.keys]
        self.open = [np.zeros((len(c[0]), SAMPLES)) for c in self.context]
        for sweep in range(BURN_IN + SAMPLES):
            probability: list = [None] * levels
            base: list = [None] * levels
            mass: list = [None] * levels
            for level in reversed(range(levels)):
                base[level] = probability[level + 1][up[level]] if level < levels - 1 else np.full(len(self.keys[level]), 1 / _SYMBOLS)
                names, where = self.context[level]
                n, t = np.bincount(where, customers[level], len(names)), np.bincount(where, tables[level], len(names))
                mass[level] = CONCENTRATION + seats[level].less * t
                probability[level] = (customers[level] - seats[level].less * tables[level] + mass[level][where] * base[level]) / (n + CONCENTRATION)[where]
                if sweep >= BURN_IN:
                    self.p[level][:, sweep - BURN_IN] = probability[level]
                    self.open[level][:, sweep - BURN_IN] = mass[level] / (n + CONCENTRATION)
            if sweep == BURN_IN + SAMPLES - 1:
                break
            for level in range(levels):  # the children's tables are the parents' customers
                if level:
                    customers[level] = np.bincount(up[level - 1], tables[level - 1], len(self.keys[level])).astype(np.int64)
                weight = mass[level][self.context[level][1]] * base[level]
                tables[level] = seats[level].draw(customers[level], weight, uniform(self.keys[level] * 8 + level, sweep))

    @staticmethod
    def _parent(key: np.ndarray, classes: int) -> np.ndarray:
        return key // _SYMBOLS // classes * _SYMBOLS + key % _SYMBOLS

    def probability(self, key: np.ndarray) -> np.ndarray:
        """P(symbol | context) of packed keys, a column a sample."""
        key, factor, out = key.copy(), np.ones((len(key), SAMPLES)), np.empty((len(key), SAMPLES))
        left = np.arange(len(key))
        for level, keys in enumerate(self.keys):
            k = key[left]
            at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
            hit = keys[at] == k if len(keys) else np.zeros(len(k), bool)
            out[left[hit]] = factor[left[hit]] * self.p[level][at[hit]]
            left, k = left[~hit], k[~hit]
            names = self.context[level][0]
            if len(names) and len(left):
                at = np.minimum(np.searchsorted(names, k // _SYMBOLS), len(names) - 1)
                factor[left] *= np.where((names[at] == k // _SYMBOLS)[:, None], self.open[level][at], 1.0)
            if level < len(_CLASSES):
                key[left] = self._parent(key[left], _CLASSES[-1 - level])
        out[left] = factor[left] / _SYMBOLS
        return out


def spelling_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(packed key of each symbol, its word) for words and their ends."""
    size = np.array([len(w) + 1 for w in words], np.int64)
    data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64) + 1
    end = np.cumsum(size)
    symbol = data.copy()
    symbol[end - 1] = 0
    inside = np.arange(len(data)) - np.repeat(end - size, size)
    context = np.zeros(len(data), np.int64)
    for k, classes in enumerate(_CLASSES, 1):
        older = np.r_[np.zeros(k, np.int64), data[:-k]] if len(data) > k else np.zeros(len(data), np.int64)
        context = context * classes + np.where(inside >= k, older % classes, 0)
    return context * _SYMBOLS + symbol, np.repeat(np.arange(len(words)), size)


def spell(words: list[bytes], model: Spelling) -> np.ndarray:
    """Each word's probability under the spelling model, a column a sample."""
    out = np.empty((len(words), SAMPLES))
    for i in range(0, len(words), 1 << 14):
        key, word = spelling_keys(words[i : i + (1 << 14)])
        start = np.flatnonzero(np.r_[True, np.diff(word) != 0])
        out[i : i + (1 << 14)] = np.exp(np.add.reduceat(np.log(model.probability(key)), start, axis=0))
    return out


class Contexts:
    """Contexts and parent sampled jointly, for a table of classes that fits a process: score() seats by bucket instead."""

    def __init__(self, counts: np.ndarray, pairs: np.ndarray, n: np.ndarray, follow: np.ndarray):
        """counts: tokens by class; pairs: context * size + class of the dishes, sorted; n: their tokens;
        follow: tokens after each context."""
        self.size, classes = len(counts) + 1, len(counts)
        self.pairs, context, dish = pairs, pairs // (len(counts) + 1), pairs % (len(counts) + 1)
        own = np.unique(context)
        rest = follow - np.bincount(context, n, self.size).astype(np.int64)
        direct = counts - np.bincount(dish, n, classes).astype(np.int64)
        # the dishes of a context, then its REST
        where, kept = np.r_[np.searchsorted(own, context), np.arange(len(own))], len(dish)
        customers = np.r_[n, rest[own]].astype(np.int64)
        seats, root = Seats(discount_of(n)), Seats(discount_of(counts[counts > 0]))
        total = np.bincount(where, customers, len(own))
        key = np.r_[pairs, own * self.size + classes].astype(np.int64)

        def chain(concentration: float, sweeps: int):
            """Parent's probabilities, base, tables and mass of each sweep."""
            tables = np.minimum(customers, 1)
            top = direct + np.bincount(dish, tables[:kept], classes).astype(np.int64)
            high = np.minimum(top, 1)
            for sweep in range(sweeps):
                g = (top - root.less * high + (CONCENTRATION + root.less * high.sum()) / classes) / (top.sum() + CONCENTRATION)
                base = np.r_[g[dish], np.maximum(1 - np.bincount(where[:kept], g[dish], len(own)), 1e-12)]
                mass = concentration + seats.less * np.bincount(where, tables, len(own))
                yield g, base, tables, mass
                tables = seats.draw(customers, mass[where] * base, uniform(key, sweep))
                weight = np.full(classes, (CONCENTRATION + root.less * high.sum()) / classes)
                top = direct + np.bincount(dish, tables[:kept], classes).astype(np.int64)
                high = root.draw(top, weight, uniform(np.arange(classes) - (1 << 40), sweep))

        def left_out(concentration: float) -> float:
            """Log probability of each pair by all others."""
            *_, (g, base, tables, mass) = chain(concentration, 3)
            there = customers > 0
            alone = np.where(customers == 1, mass[where] - seats.less, mass[where])
            p = np.maximum(customers - 1 - seats.less * np.where(customers == 1, 0, tables), 0) + alone * base
            return float((customers * np.log(np.where(there, p, 1) / (np.maximum(total - 1, 0) + concentration)[where])).sum())

        self.concentration = max(CONTEXT_CONCENTRATIONS, key=left_out) if kept else CONCENTRATION
        self.pair, self.rest, self.root = np.zeros(kept), np.ones((self.size, SAMPLES)), np.zeros((classes, SAMPLES))
        for sweep, (g, base, tables, mass) in enumerate(chain(self.concentration, BURN_IN + SAMPLES)):
            if sweep >= BURN_IN:
                p = (customers - seats.less * tables + mass[where] * base) / (total + self.concentration)[where]
                self.root[:, sweep - BURN_IN] = g
                self.pair += p[:kept] / SAMPLES
                self.rest[own, sweep - BURN_IN] = p[kept:] / base[kept:]

    def probability(self, context: np.ndarray, dish: np.ndarray) -> np.ndarray:
        key = context * self.size + dish
        at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        hit = self.pairs[at] == key if len(self.pairs) else np.zeros(len(key), bool)
        out = np.empty(len(key))
        out[hit] = self.pair[at[hit]]
        context, dish = context[~hit], dish[~hit]
        out[~hit] = sum(self.rest[context, k] * self.root[dish, k] for k in range(SAMPLES)) / SAMPLES
        return out


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([a.nbytes for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(data, np.int64, len(kinds)), kinds):
        out.append(np.frombuffer(data, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


_NULL = -(1 << 63)
_BLOCKS = "kind int, block long, shard int, blob binary"
_NAMES = ["kind", "block", "shard", "blob"]


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and crc32(str(doc_id).encode()) % 10 == 0


def _texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def _write_blocks(docs: DataFrame, shards: int) -> DataFrame:
    """kind 0: the documents of a block, packed as the places of their words in order; kind 1: its words of a shard."""

    def emit(block, index, train, ids, sizes, places):
        words = list(index)
        n = np.zeros(len(words), np.int64)
        for t in train:
            n += np.bincount(t, minlength=len(words))
        shard = np.fromiter(map(crc32, words), np.int64, len(words)) % shards
        order = np.argsort(shard, kind="stable")  # a block's words, shard by shard
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        blobs = [_pack(np.array(ids, np.int64), np.array(sizes, np.int64), place[np.concatenate(places)])]
        found, first = np.unique(shard[order], return_index=True)
        for own in np.split(order, first[1:]):
            w = [words[i] for i in own.tolist()]
            blobs.append(_pack(np.fromiter(map(len, w), np.int64, len(w)), _planes(n[own]), np.frombuffer(b"".join(w), np.uint8)))
        for i, blob in enumerate(blobs):
            yield pa.record_batch([pa.array([min(i, 1)], pa.int32()), pa.array([block]), pa.array([found[i - 1] if i else -1], pa.int32()), pa.array([blob], pa.binary())], names=_NAMES)

    def run(batches):
        block, size = TaskContext.get().partitionId() << 32, 0
        index, train, held, ids, sizes, places = {}, [], 0, [], [], []
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), byte_texts(b.column(1))):
                words = text.lower().split()
                words.append(b"")
                place = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words))
                if not is_held_out(key):
                    train.append(place)
                    held += len(place)
                    if held > 1 << 21:  # one array of counts for many texts
                        train, held = [np.concatenate(train)], 0
                ids.append(_NULL if key is None else key)
                sizes.append(len(words))
                places.append(place)
                size += len(text)
                if size > BLOCK_BYTES:
                    yield from emit(block, index, [np.concatenate(train)] if train else [], ids, sizes, places)
                    block, size = block + 1, 0
                    index, train, held, ids, sizes, places = {}, [], 0, [], [], []
        if ids:
            yield from emit(block, index, [np.concatenate(train)] if train else [], ids, sizes, places)

    return _texts(docs).mapInArrow(trimmed(run), _BLOCKS)


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of numbers, all first bytes before all second ones, which packs better."""
    x = x if x.dtype == np.float64 else x.astype(np.int64)
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T)


def _unplanes(x: np.ndarray, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(8, -1).T).reshape(-1).view(kind)


_VOCABULARY = "kind int, shard int, block long, place int, word binary, c long, blob binary"


def _vocabulary(blocks: DataFrame) -> DataFrame:
    """kind 1: the training words of a shard, with places in it; kind 0: the places, from 1 on, of a block's words in it, or 0."""

    def unite(group: pa.Table) -> pa.Table:
        parts = [_unpack(b, np.int64, np.uint8, np.uint8) for b in group.column("blob").to_pylist()]
        texts = [pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(np.r_[0, np.cumsum(x)]), pa.py_buffer(data)]) for x, _, data in parts]
        words = pa.concat_arrays(texts).dictionary_encode()
        at = words.indices.to_numpy()
        c = np.bincount(at, np.concatenate([_unplanes(n) for _, n, _ in parts])).astype(np.int64)  # exact up to 2^53
        place = np.where(c > 0, np.cumsum(c > 0), 0)
        blobs = [_pack(_planes(x)) for x in np.split(place[at], np.cumsum([len(x) for x, _, _ in parts])[:-1])]
        shard, k, out = group.column("shard")[0].as_py(), len(blobs), []
        lead = [pa.array(np.zeros(k, np.int32)), pa.array(np.full(k, shard, np.int32)), group.column("block").combine_chunks()]
        out.append(pa.table([*lead, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.array(blobs, pa.binary())], names=fields))
        known, c = words.dictionary.filter(pa.array(c > 0)), c[c > 0]
        for i in range(0, len(c), 1 << 15):
            w = known.slice(i, 1 << 15).cast(pa.binary())
            k = len(w)
            lead = [pa.array(np.ones(k, np.int32)), pa.array(np.full(k, shard, np.int32)), pa.nulls(k, pa.int64())]
            out.append(pa.table([*lead, pa.array(np.arange(i, i + k, dtype=np.int32)), w, pa.array(c[i : i + k]), pa.nulls(k, pa.binary())], names=fields))
        return pa.concat_tables(out)

    fields = [x.split()[0] for x in _VOCABULARY.split(", ")]
    return materialize(blocks.where("kind = 1").select("shard", "block", "blob").groupBy("shard").applyInArrow(unite, _VOCABULARY), "vocabulary", "kind")


def _told(words: DataFrame, asked: DataFrame, **absent) -> DataFrame:
    """block, shard, blob: the columns that `absent` names, packed, of each of a block's words in a shard; its values are for words without a place.

    words: shard, place and these columns; asked: shard, block and blob, the places from 1 on or 0.
    """

    def tell(group: pa.Table) -> pa.Table:
        lead = group.column("blob").is_valid()
        rows, asks = group.filter(pc.invert(lead)), group.filter(lead)
        place, columns = rows.column("place").to_numpy(), []
        for name, value in absent.items():
            x = np.full(len(place) + 1, value)
            x[place + 1] = rows.column(name).to_numpy()
            columns.append(x)
        at = [_unplanes(_unpack(b, np.uint8)[0]) for b in asks.column("blob").to_pylist()]
        blobs = [_pack(*(_planes(x[k]) for x in columns)) for k in at]
        return pa.table([asks.column("block"), asks.column("shard"), pa.array(blobs, pa.binary())], names=["block", "shard", "blob"])

    rows = words.select("shard", "place", *absent).unionByName(asked.select("shard", "block", "blob"), allowMissingColumns=True)
    return rows.groupBy("shard").applyInArrow(tell, "block long, shard int, blob binary")


def _by_shard(blobs: dict[int, bytes], *kinds) -> list[np.ndarray]:
    """Columns of a block's words, shard by shard."""
    parts = [_unpack(blobs[k], *[np.uint8] * len(kinds)) for k in sorted(blobs)]
    return [np.concatenate([_unplanes(p[i], kind) for p in parts]) for i, kind in enumerate(kinds)]


def _numbered(vocab: DataFrame) -> DataFrame:
    """The vocabulary with id: numbers from 0 on by falling count."""
    at = F.monotonically_increasing_id()
    rows = materialize(vocab.orderBy(F.desc("c"), "word").select("*", at.alias("at")), "numbered")
    part, offset, cases = F.shiftright("at", 33), 0, {}
    for r in rows.groupBy(part.alias("k")).agg(F.count("*").alias("n")).orderBy("k").collect():  # a row a partition
        cases[r.k], offset = offset - (r.k << 33), offset + r.n
    shift = F.create_map(*(F.lit(x) for kv in cases.items() for x in kv))[part] if cases else F.lit(0)
    return rows.select(*vocab.columns, (F.col("at") + shift).cast("long").alias("id"))


class Buckets:
    """Names of pairs (context, word) of `words` numbered words, and the bucket of each."""

    def __init__(self, words: int, buckets: int):
        self.unknown, self.start, self.size, self.buckets = words, words + 1, words + 2, buckets

    def pairs(self, sizes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context of each token of the texts, and its pair; -1 if either word is unknown."""
        context = np.r_[0, word[:-1]]
        context[np.cumsum(sizes) - sizes] = self.start
        return context, np.where((context == self.unknown) | (word == self.unknown), -1, context * self.size + word)

    def dealt(self, pairs: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(bucket, places of its pairs in order) of sorted pairs."""
        at = (uniform(pairs // self.size, 0) * self.buckets).astype(np.uint16 if self.buckets < 1 << 16 else np.int64)
        order = np.argsort(at, kind="stable")
        bucket, first = np.unique(at[order], return_index=True)
        return list(zip(bucket.tolist(), np.split(order, first[1:])))


def seat_contexts(pairs: np.ndarray, n: np.ndarray, size: int, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Tables of each pair over all samples; contexts and the mean mass of their new tables; discount and concentration.

    pairs: context * size + word, sorted; n: their tokens; parent: the probability of each word.
    """
    own = pairs // size
    new = np.diff(own, prepend=-1) > 0
    own, where = own[new], np.cumsum(new, dtype=np.int32) - np.int32(1)
    less = discount_of(n)
    seats, follow, many = seats_of(less), np.bincount(where, n, len(own)), np.flatnonzero(n > 1)

    def chain(concentration: float, sweeps: int):
        tables = np.ones(len(n), np.int64)
        for sweep in range(sweeps):
            mass = concentration + less * np.bincount(where, tables, len(own))
            yield tables, mass
            if sweep < sweeps - 1:
                tables = tables.copy()
                tables[many] = seats.draw(n[many], mass[where[many]] * parent[many], uniform(pairs[many], sweep))

    def left_out(concentration: float) -> float:
        """Log probability of each pair by all others."""
        *_, (tables, mass) = chain(concentration, 2)
        found = 0.0
        for i in range(0, len(n), 1 << 18):  # for small arrays
            k = slice(i, i + (1 << 18))
            alone = np.where(n[k] == 1, mass[where[k]] - less, mass[where[k]])
            p = np.maximum(n[k] - 1 - less * np.where(n[k] == 1, 0, tables[k]), 0) + alone * parent[k]
            found += float((n[k] * np.log(p / (follow - 1 + concentration)[where[k]])).sum())
        return found

    best = max(CONTEXT_CONCENTRATIONS, key=left_out)
    drawn, open_ = np.zeros(len(n), np.int64), np.zeros(len(own))
    for sweep, (tables, mass) in enumerate(chain(best, CONTEXT_BURN_IN + SAMPLES)):
        if sweep >= CONTEXT_BURN_IN:
            drawn += tables
            open_ += mass / SAMPLES
    return drawn, own, open_ / (follow + best), less, best


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers of x, which is sorted in place."""
    x.sort()
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


_SEATS = "kind int, at long, bucket int, value double, blob binary"


def _seat_pairs(blocks: DataFrame, told: DataFrame, names: Buckets, counts: tuple[np.ndarray, np.ndarray], total: int, shards: int) -> DataFrame:
    """kind 0: a bucket's answer to a block (at); 1: its tables of words and its contexts' masses of new tables, of numbers
    that leave the remainder at; 2: the mass of a text's begin."""
    first, many = counts  # of words with the same count the first number, and that count

    def ask(group: pa.Table) -> pa.Table:
        blobs = dict(zip(group.column("shard").to_pylist(), group.column("blob").to_pylist()))
        ids, sizes, places = _unpack(blobs.pop(-1), np.int64, np.int64, np.int32)
        key = names.pairs(sizes, _by_shard(blobs, np.int64)[0][places])[1]
        train = np.repeat([not is_held_out(None if k == _NULL else k) for k in ids.tolist()], sizes)
        pairs, at = np.unique(key, return_inverse=True)
        n = np.bincount(at[train], minlength=len(pairs))[pairs >= 0]
        pairs = pairs[pairs >= 0]
        dealt = names.dealt(pairs)
        packed = [_pack(_planes(np.diff(pairs[at], prepend=0)), _planes(n[at])) for _, at in dealt]
        block = group.column("block")[0].as_py()
        return pa.table({"bucket": pa.array([k for k, _ in dealt], pa.int32()), "block": pa.array([block] * len(dealt), pa.int64()), "blob": pa.array(packed, pa.binary())})

    def seat(group: pa.Table) -> pa.Table:
        def asked():
            for blob in group.column("blob").to_pylist():
                steps, x = _unpack(blob, np.uint8, np.uint8)
                yield np.cumsum(_unplanes(steps)), _unplanes(x)

        every = _distinct(np.concatenate([k for k, _ in asked()]))
        n = np.zeros(len(every), np.int64)
        for k, x in asked():
            n[np.searchsorted(every, k)] += x
        there, drawn, out = n > 0, np.zeros(len(every), np.int64), []
        bucket, less, best = group.column("bucket")[0].as_py(), 0.0, 1.0

        def add(kind, to, value, blobs):
            k = len(to)
            out.append(pa.table([pa.array(np.full(k, kind, np.int32)), pa.array(to, pa.int64()), pa.array(np.full(k, bucket, np.int32)), pa.array(np.full(k, value)), pa.array(blobs, pa.binary())], names=["kind", "at", "bucket", "value", "blob"]))

        if there.any():
            pairs = every[there]
            parent = many[np.searchsorted(first, pairs % names.size, "right") - 1] / total
            drawn[there], own, open_, less, best = seat_contexts(pairs, n[there], names.size, parent)
            del parent
            if own[-1] == names.start:
                add(2, [names.start], open_[-1], [None])
            dish, where = np.unique(pairs % names.size, return_inverse=True)
            tables = np.bincount(where, drawn[there]).astype(np.int64)
            del pairs, where
            blobs = []
            for k in range(shards):
                d, c = dish % shards == k, (own % shards == k) & (own != names.start)
                blobs.append(_pack(_planes(np.diff(dish[d], prepend=0)), _planes(tables[d]), _planes(np.diff(own[c], prepend=0)), _planes(open_[c])))
            add(1, list(range(shards)), 0.0, blobs)
        blobs = []
        for k, _ in asked():
            at = np.searchsorted(every, k)
            blobs.append(_pack(np.array([less, best]), _planes(n[at]), _planes(drawn[at])))
        add(0, group.column("block").to_pylist(), 0.0, blobs)
        return pa.concat_tables(out)

    packed = blocks.where("kind = 0").select("block", "shard", "blob")
    asked = told.unionByName(packed).groupBy("block").applyInArrow(ask, "bucket int, block long, blob binary")
    return materialize(asked.groupBy("bucket").applyInArrow(seat, _SEATS), "contexts", "kind")


_CARRIED = ["id", "tokens", "open", "shard", "place"]
_CARRIED_TYPES = "id long, tokens long, open double, shard int, place int"


def _customers(named: DataFrame, seats: DataFrame, shards: int) -> DataFrame:
    """word, its customers c (the mean of its samples' tables in all contexts), and what is carried along."""

    def gather(group: pa.Table) -> pa.Table:
        lead = group.column("blob").is_valid()
        rows, slot = group.filter(pc.invert(lead)), group.column("slot")[0].as_py()
        at = rows.column("id").to_numpy() // shards
        tables, open_ = np.zeros(at.max(initial=-1) + 1, np.int64), np.ones(at.max(initial=-1) + 1)
        for blob in group.filter(lead).column("blob").to_pylist():
            dish, n, own, x = _unpack(blob, *[np.uint8] * 4)
            tables[(np.cumsum(_unplanes(dish)) - slot) // shards] += _unplanes(n)
            open_[(np.cumsum(_unplanes(own)) - slot) // shards] = _unplanes(x, np.float64)
        # halves are rounded up
        return rows.select(["word"]).append_column("c", pa.array(np.maximum(1, (2 * tables[at] + SAMPLES) // (2 * SAMPLES)))).append_column("id", rows.column("id")).append_column("tokens", rows.column("c")).append_column("open", pa.array(open_[at])).append_column("shard", rows.column("shard")).append_column("place", rows.column("place"))

    rows = named.withColumn("slot", F.col("id") % shards).unionByName(seats.where("kind = 1").select(F.col("at").alias("slot"), "blob"), allowMissingColumns=True)
    return rows.groupBy("slot").applyInArrow(gather, f"word binary, c long, {_CARRIED_TYPES}")


def _spelling_counts(vocab: DataFrame, tables) -> tuple[np.ndarray, np.ndarray]:
    """Counts of packed spelling keys, words weighted by their tables."""

    def run(batches):
        for b in batches:
            words = byte_texts(b.column(0))
            if words:
                key, word = spelling_keys(words)
                key, where = np.unique(key, return_inverse=True)
                yield pa.record_batch([pa.array(key), pa.array(np.bincount(where, b.column(1).to_numpy()[word]).astype(np.int64))], names=["key", "n"])

    rows = vocab.select("word", tables.cast("long").alias("t")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def seat_words(words: list[bytes], c: np.ndarray, base: np.ndarray, mass: float, less: float) -> np.ndarray:
    """Tables of words that occur c times, a column a sample."""
    key, seats = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), seats_of(less)
    return np.stack([seats.draw(c, mass * base[:, k], uniform(key, k)) for k in range(SAMPLES)], axis=1)


def _forget(spark, since: int = 0, until: int = 0) -> None:
    """Drop scratch tables that nothing reads any more; shuffles of ended jobs go when the driver collects its garbage."""
    release(spark, since, until)
    spark.sparkContext._jvm.System.gc()


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    spark = docs.sparkSession
    held_out = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 10 == 0)
    size, begun = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))), F.count_if(~held_out)).first()
    shards = max(LEAST_SHARDS, -(-(size or 0) // SHARD_BYTES))
    blocks = materialize(_write_blocks(docs, shards), "blocks", "kind")
    united = _vocabulary(blocks)
    vocab, places = united.where("kind = 1").select("word", "c", "shard", "place"), united.where("kind = 0").select("shard", "block", "blob")
    total, types = vocab.agg(F.sum("c"), F.count("*")).first()
    total, types = total or 0, types or 0
    numbers = mark()
    named = _numbered(vocab)
    steps = vocab.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect()  # as many as there are counts
    many = np.array([r.c for r in steps], np.int64)
    counts = np.cumsum([0, *(r.n for r in steps)])[:-1], many
    names = Buckets(types, max(1, -(-total // BUCKET_TOKENS)))
    _forget(spark)
    seats = _seat_pairs(blocks, _told(named, places, id=names.unknown), names, counts, total, shards)
    _forget(spark)
    begin = seats.where("kind = 2").first()
    begin = begin.value if begin else 1.0
    words = mark()
    rare = materialize(_customers(named, seats, shards), "words")
    _forget(spark, numbers, numbers + 1)
    tokens, kinds, once, twice = rare.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    tokens, less = tokens or 0, discount(kinds, once, twice)

    first = spark.sparkContext.broadcast(Spelling(*_spelling_counts(rare, F.lit(1))))  # at most 65536 * 257 entries
    mass = CONCENTRATION + less * kinds

    def seat(batches):
        for b in batches:
            words, c = byte_texts(b.column(0)), b.column(1).to_numpy()
            if words:
                t = seat_words(words, c, spell(words, first.value), mass, less)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, t.size + 1, SAMPLES, dtype=np.int32)), pa.array(t.ravel()))
                yield pa.record_batch([b.column(0), b.column(1), lists, *b.columns[2:]], names=["word", "c", "t", *_CARRIED])

    seated = materialize(rare.select("word", "c", *_CARRIED).mapInArrow(seat, f"word binary, c long, t array<long>, {_CARRIED_TYPES}"), "seated")
    _forget(spark, words, words + 1)
    taken = seated.agg(*(F.sum(F.get("t", F.lit(k))) for k in range(SAMPLES))).first()
    open_ = CONCENTRATION + less * np.array([x or 0 for x in taken], np.float64)
    mean = F.greatest(F.lit(1), F.round(sum(F.get("t", F.lit(k)) for k in range(SAMPLES)) / SAMPLES))
    spelling = spark.sparkContext.broadcast(Spelling(*_spelling_counts(seated, mean)))

    def price(batches):
        for b in batches:
            words, c = byte_texts(b.column(0)), b.column(1).to_numpy()
            if words:
                t = b.column(2).values.to_numpy().reshape(-1, SAMPLES)
                base = spell(words, spelling.value)
                p = ((c[:, None] - less * t + open_ * base) / (tokens + CONCENTRATION)).mean(axis=1)
                sums = pa.array([base.sum(axis=0).tolist(), *[None] * (len(words) - 1)], pa.list_(pa.float64()))  # of the batch
                yield pa.record_batch([b.column(0), pa.array(np.log10(p)), sums, *b.columns[3:]], names=["word", "log_p", "base", *_CARRIED])

    priced = materialize(seated.mapInArrow(price, f"word binary, log_p double, base array<double>, {_CARRIED_TYPES}"), "priced")
    _forget(spark, words + 1, words + 2)
    known = [min(x or 0.0, 1 - 1e-9) for x in priced.agg(*(F.sum(F.get("base", F.lit(k))) for k in range(SAMPLES))).first()]
    unknown = float(np.log10((open_ * (1 - np.array(known))).mean() / (tokens + CONCENTRATION)))
    prices = priced.select("shard", "place", F.col("tokens").alias("c"), "log_p", "id", "open")
    told = _told(prices, places, c=0, log_p=unknown, id=names.unknown, open=1.0)
    packed = blocks.where("kind = 0").select("block", "shard", "blob")
    replies = seats.where("kind = 0").select(F.col("at").alias("block"), "bucket", "blob")
    floor = np.log10(total + 0.1 * (types + 1))

    def finish(group: pa.Table) -> pa.Table:
        blobs, answers = {}, {}
        for shard, bucket, blob in zip(*(group.column(k).to_pylist() for k in ("shard", "bucket", "blob"))):
            (answers if shard is None else blobs)[bucket if shard is None else shard] = blob
        ids, sizes, places = _unpack(blobs.pop(-1), np.int64, np.int64, np.int32)
        c, log_p, number, new = _by_shard(blobs, np.int64, np.float64, np.int64, np.float64)
        pairs, pair = np.unique(names.pairs(sizes, number[places])[1], return_inverse=True)
        pair = pair.astype(np.int32) - int((pairs < 0).sum())  # -1 if a word is unknown
        pairs = pairs[pairs >= 0]
        seated = np.ones((2, len(pairs)))  # tokens of a pair less its discounts, the concentration
        for bucket, at in names.dealt(pairs):
            head, n, tables = _unpack(answers[bucket], np.float64, np.uint8, np.uint8)
            seated[0, at], seated[1, at] = _unplanes(n) - head[0] * _unplanes(tables) / SAMPLES, head[1]
        start = np.cumsum(sizes) - sizes
        out = np.empty((3, len(ids)))
        value = np.stack([c > 0, np.log10(c + 0.1) - floor])
        for i, j in _spans(sizes, 1 << 19):  # whole documents, for bounded arrays
            span = slice(start[i], start[j - 1] + sizes[j - 1])
            own = places[span]
            hit = np.flatnonzero(pair[span] >= 0)
            at = pair[span][hit]
            before, begins = np.r_[own[:1], own[:-1]], start[i:j] - start[i]
            mass, follow = new[before], c[before]
            mass[begins], follow[begins] = begin, begun
            p = mass * 10.0 ** log_p[own]
            p[hit] += seated[0, at] / (follow[hit] + seated[1, at])
            paid = np.log10(p)
            for k, x in enumerate((value[0][own], value[1][own], paid)):
                out[k, i:j] = np.add.reduceat(x, begins)
        keys = [None if k == _NULL else k for k in ids.tolist()]
        return pa.table({
            "doc_id": pa.array(keys, pa.int64()), "held_out": pa.array([is_held_out(k) for k in keys]), "n_tokens": sizes,
            "n_known": out[0].astype(np.int64), "train_tokens": np.full(len(ids), int(total)), "base_score": out[1], "score": out[2],
        })

    return told.unionByName(packed).unionByName(replies, allowMissingColumns=True).groupBy("block").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _spans(sizes: np.ndarray, most: int):
    """Ranges [i, j) of documents with about `most` tokens."""
    upto, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
