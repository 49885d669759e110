"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Words are cut where no piece of the vocabulary reaches across: before a run of blanks, and before a
newline if no piece holds one. All words that a batch
needs and the cache lacks are laid out as one flat symbol array. Each round finds the minimum rank
of adjacent pairs per word (a segmented minimum, leftmost first), merges that pair in all words at
once, and compacts the array; words without a pair leave it. Words of many symbols are merged with
a heap instead, in n log n steps. Symbols outside the vocabulary become byte pieces.

The model must be a BPE model with byte fallback, the identity normaliser and a dummy prefix; others
are refused. Null and empty texts have no ids and decode to the empty text. Each row is encoded
alone, so repeated rows repeat their result, and an empty table gives no rows. U+2581 in a text
encodes, and so decodes, as a blank. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, chunks, small_batches, table, trimmed

MODEL_FILE = "piece_bpe_32k.model"
_NORMAL, _USER, _BYTE = 1, 4, 6
_BLANK = "▁"
#: Cached words; the cache is emptied beyond it. Longer words are not cached.
CACHE_WORDS, CACHE_CHARS = 150_000, 48
#: Symbols of a word that is merged in rounds; longer ones use a heap.
ROUND_SYMBOLS = 256
_NONE = np.int64(1 << 62)


def _fields(data: bytes):
    """(field, value) pairs of a protocol-buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


class Codec:
    """Encoder and decoder of one model; caches words, so keep one per process."""

    def __init__(self, data: bytes):
        pieces, trainer, norm = [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, _NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                norm = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1) or any(p[2] == _USER for p in pieces):
            raise ValueError("the model is not BPE with byte fallback, identity normaliser and dummy prefix")
        scores = {s: x for s, x, kind in pieces if kind == _NORMAL}
        self.byte_id = {int(s[3:5], 16): i for i, (s, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.surface = [bytes([int(s[3:5], 16)]) if kind == _BYTE else s.replace(_BLANK, " ").encode() if kind == _NORMAL else b"" for s, _, kind in pieces]
        ids = {s: i for i, (s, _, kind) in enumerate(pieces) if kind == _NORMAL}
        # symbols: vocabulary pieces, then characters that only occur inside of them
        chars = sorted({c for s in ids for c in s} - ids.keys())
        symbol = ids | {c: len(pieces) + k for k, c in enumerate(chars)}
        self.count = len(pieces) + len(chars)
        self.chars = chars
        self.of_char = np.full(0x110000, -1, np.int64)
        for s, k in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = k
        self.n_pieces = len(pieces)
        rank = {x: k for k, x in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = sorted((symbol[s[:k]] * self.count + symbol[s[k:]], rank[scores[s]], ids[s]) for s in ids for k in range(1, len(s)) if s[:k] in symbol and s[k:] in symbol)
        self.pair = np.array([p[0] for p in pairs] or [-1], np.int64)
        self.rank = np.array([p[1] for p in pairs] or [0], np.int64)
        self.merged = np.array([p[2] for p in pairs] or [0], np.int64)
        if any(_BLANK in s.lstrip(_BLANK) for s in ids):
            raise ValueError("pieces of the model hold a blank after another character")
        self.cut_lines = not any("\n" in s for s in ids)
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, bytes] = {}

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and merged symbol of adjacent symbols."""
        key = left * self.count + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], _NONE), self.merged[at]

    def _rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words of a flat symbol array at once; word numbers the symbols' words in order."""
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def look(at: np.ndarray) -> None:
            """Renew rank and merged symbol of the pairs that start at `at`."""
            right = np.minimum(at + 1, len(sym) - 1)
            rank[at], merged[at] = self._lookup(sym[at], sym[right])
            rank[at[(right == at) | (word[at] != word[right])]] = _NONE

        rank, merged = np.empty(len(sym), np.int64), np.empty(len(sym), np.int64)
        look(np.arange(len(sym)))
        while n := len(sym):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(np.where(rank < _NONE, rank * n + np.arange(n), _NONE), start)
            keep = np.repeat(low != _NONE, np.diff(np.r_[start, n]))
            out.append((sym[~keep], word[~keep]))
            at = low[low != _NONE] % n
            sym[at] = merged[at]
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            sym, word, rank, merged = sym[keep], word[keep], rank[keep], merged[keep]
            look(at)
            back = at[at > 0] - 1
            look(back)
        sym, word = (np.concatenate(x) for x in zip(*out)) if out else (sym, word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _heap(self, sym: np.ndarray) -> np.ndarray:
        """Merge one long word, best pair first."""
        sym = sym.copy()
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, merged = self._lookup(sym[:-1], sym[1:])
        heap = [(int(r), i, int(sym[i]), int(sym[i + 1]), int(m)) for i, (r, m) in enumerate(zip(rank, merged)) if r < _NONE]
        heapq.heapify(heap)
        alive = np.ones(n, bool)

        def push(i: int, j: int) -> None:
            r, m = self._lookup(sym[i : i + 1], sym[j : j + 1])
            if r[0] < _NONE:
                heapq.heappush(heap, (int(r[0]), i, int(sym[i]), int(sym[j]), int(m[0])))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            if not alive[i] or sym[i] != a or (j := int(after[i])) >= n or sym[j] != b:
                continue
            sym[i], alive[j] = m, False
            after[i] = k = int(after[j])
            if k < n:
                before[k] = i
                push(i, k)
            if before[i] >= 0:
                push(int(before[i]), i)
        return sym[alive]

    def _learn(self, keys: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids (as little-endian int32) and decoded bytes of words."""
        text = [key if key[:1] == "\n" and self.cut_lines else _BLANK + key.replace(" ", _BLANK) for key in keys]
        code = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(t) for t in text])
        end = np.cumsum(size)
        sym, word = self.of_char[code], np.repeat(np.arange(len(keys)), size)
        sym = np.where(sym < 0, -1 - code, sym)
        short = np.repeat(size <= ROUND_SYMBOLS, size)
        parts = [self._rounds(sym[short], word[short])]
        for k in np.flatnonzero(size > ROUND_SYMBOLS):
            merged = self._heap(sym[end[k] - size[k] : end[k]])
            parts.append((merged, np.full(len(merged), k)))
        if len(parts) > 1:
            sym, word = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(word, kind="stable")
            sym, word = sym[order], word[order]
        else:
            sym, word = parts[0]
        edge = np.searchsorted(word, np.arange(len(keys) + 1))
        odd = set(word[(sym < 0) | (sym >= self.n_pieces)].tolist())
        flat, numbers = sym.astype("<i4").tobytes(), sym.tolist()
        learned = {}
        for k, (key, a, b) in enumerate(zip(keys, edge.tolist(), edge[1:].tolist())):
            if k in odd:
                ids = []
                for x in numbers[a:b]:
                    if 0 <= x < self.n_pieces:
                        ids.append(x)
                    else:
                        ids += [self.byte_id[y] for y in (chr(-1 - x) if x < 0 else self.chars[x - self.n_pieces]).encode()]
                learned[key] = np.array(ids, "<i4").tobytes(), b"".join(map(self.surface.__getitem__, ids))
            else:
                learned[key] = flat[4 * a : 4 * b], b"".join(map(self.surface.__getitem__, numbers[a:b]))
        return learned

    def words(self, text: str) -> list[str]:
        """Keys of the words of a non-empty text: without the first blank, or with the newline before them."""
        text = " " + text.replace(_BLANK, " ")
        if "  " in text:
            found = re.findall(r" +[^ \n]*|\n[^ \n]*" if self.cut_lines else r" +[^ ]*", text)
            return [x[1:] if x[0] == " " else x for x in found]
        return (text.replace("\n", " \n") if self.cut_lines else text)[1:].split(" ")

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
        """Ids and decoded UTF-8 of each text."""
        split = [self.words(t) if t else [] for t in texts]
        if len(self.ids) > CACHE_WORDS:
            self.ids.clear()
            self.text.clear()
        need = list({w for ws in split for w in ws if w not in self.ids})
        extra: list[str] = []
        for i in range(0, len(need), 1 << 14):
            for key, (ids, text) in self._learn(need[i : i + (1 << 14)]).items():
                self.ids[key], self.text[key] = ids, text
                if len(key) > CACHE_CHARS:
                    extra.append(key)
        ids = [np.frombuffer(b"".join(map(self.ids.__getitem__, ws)), "<i4") for ws in split]
        decoded = [b"".join(map(self.text.__getitem__, ws))[1:] for ws in split]
        for key in extra:
            del self.ids[key], self.text[key]
        return ids, decoded

    def decode(self, ids) -> str:
        """The text of any ids."""
        data = b"".join(map(self.surface.__getitem__, ids))
        return (data[1:] if data[:1] == b" " and len(ids) and self.surface[ids[0]][:1] == b" " else data).decode(errors="replace")


_codecs: dict[int, Codec] = {}


def codec(data: bytes) -> Codec:
    key = hash(data)
    if key not in _codecs:
        _codecs[key] = Codec(data)
    return _codecs[key]


def encode_decode(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text of these ids)."""

    def run(batches):
        own = codec(model)
        for b in batches:
            texts = [t.decode() for t in byte_texts(b.column(1))]
            for i, j in chunks([len(t) for t in texts], 1 << 21):
                ids, decoded = own.encode(texts[i:j])
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.record_batch(
                    [b.column(0)[i:j], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())), pa.array([d.decode() for d in decoded], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    given = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string"))
    return small_batches(given).mapInArrow(trimmed(run), "doc_id long, ids array<int>, decoded string")


def model_bytes(path: str | None = None) -> bytes:
    """The model's file, read on the driver and shipped with the tasks (half a megabyte)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL_FILE)
    with open(path, "rb") as f:
        return f.read()


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), model_bytes())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
