"""Language identification by a byte convolutional network, trained and applied in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes, all of them, the last one padded with
zeros. Filters of several widths run over a window's one-hot bytes; each filter's maximum over the
window, rectified, feeds a softmax. A text's prediction is the mean of its windows' softmax
outputs, weighted by their bytes. A filter over one-hot bytes is a sum of table rows, and applying
it takes one table of byte pairs for each two positions of its width.

Training reads a bounded sample: about TRAIN_DOCS documents of each label by hash, and at most
TRAIN_WINDOWS windows of each, evenly spread over the whole text. Held-out documents (crc32 of
doc_id mod 4 is 2) and null labels are never read for it.

A null text, or one without a letter, is `und` with score 0; so is every text where no labelled
document can be learned from. Repeated rows get equal results; a null doc_id is not held out. An
empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, chunks, small_batches, table, trimmed

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
TRAIN_DOCS, TRAIN_WINDOWS = 500, 4
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 64, 0.01, 1e-5, 7
UNKNOWN = "und"
_CHUNK = 1 << 17


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode()))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class ByteNetwork:
    """Tables (width, byte, filter) per width, and the softmax layer on the pooled filters."""

    def __init__(self, labels: list[str], rng: np.random.Generator):
        self.labels = labels
        self.kernels = [rng.normal(0, 0.3, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.weight = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.offset = np.zeros(len(labels), np.float32)

    def fit(self, windows: np.ndarray, label: np.ndarray, rng: np.random.Generator) -> None:
        """Adam on cross-entropy; only the maximum's position passes a gradient to a filter."""
        params = [*self.kernels, *self.bias, self.weight, self.offset]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, n_w = 0, len(WIDTHS)
        for _ in range(EPOCHS):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), BATCH):
                x, y = windows[order[i : i + BATCH]], label[order[i : i + BATCH]]
                tops, places = [], []
                for k, kernel, b in zip(WIDTHS, self.kernels, self.bias):
                    out = sum(kernel[j][x[:, j : WINDOW - k + 1 + j]] for j in range(k)) + b
                    place = out.argmax(axis=1)
                    tops.append(np.take_along_axis(out, place[:, None, :], 1)[:, 0])
                    places.append(place)
                top = np.concatenate(tops, 1)
                hidden = np.maximum(top, 0)
                p = _softmax(hidden @ self.weight + self.offset)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ self.weight.T) * (top > 0)
                grads = []
                for w, (k, kernel) in enumerate(zip(WIDTHS, self.kernels)):
                    g = np.zeros_like(kernel)
                    own = back[:, w * FILTERS : (w + 1) * FILTERS]
                    filters = np.broadcast_to(np.arange(FILTERS), own.shape)
                    for j in range(k):
                        np.add.at(g[j], (np.take_along_axis(x, places[w] + j, 1), filters), own)
                    grads.append(g)
                grads += [back[:, w * FILTERS : (w + 1) * FILTERS].sum(0) for w in range(n_w)]
                grads += [hidden.T @ p + DECAY * self.weight, p.sum(0)]
                step += 1
                for q, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def tables(self) -> list[list[np.ndarray]]:
        """Per width: a table of byte pairs for each two positions, and one of bytes for an odd last one."""
        out = []
        for k, kernel, b in zip(WIDTHS, self.kernels, self.bias):
            parts = [(kernel[j][:, None, :] + kernel[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, k - 1, 2)]
            parts += [kernel[k - 1]] * (k % 2)
            parts[0] = parts[0] + b
            out.append([np.ascontiguousarray(p) for p in parts])
        return out

    def predict(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Softmax outputs of windows (n, WINDOW)."""
        n = len(windows)
        flat = np.concatenate([windows.ravel(), np.zeros(max(WIDTHS), np.uint8)]).astype(np.int64)
        pair = flat[:-1] * 256 + flat[1:]
        size, hidden = n * WINDOW, []
        one, two = np.empty((size, FILTERS), np.float32), np.empty((size, FILTERS), np.float32)
        for k, parts in zip(WIDTHS, tables):
            for j, part in enumerate(parts):
                index = (pair if len(part) == 65536 else flat)[2 * j : 2 * j + size]
                np.take(part, index, axis=0, out=two if j else one, mode="clip")
                if j:
                    np.add(one, two, out=one)
            hidden.append(one.reshape(n, WINDOW, FILTERS)[:, : WINDOW - k + 1].max(axis=1))
        return _softmax(np.maximum(np.concatenate(hidden, 1), 0) @ self.weight + self.offset)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _windows(data: bytes) -> np.ndarray:
    n = -(-len(data) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def training_windows(docs: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Windows and labels of the training sample."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), []
    share = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, min(1.0, TRAIN_DOCS / r["count"]))))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    picked = labelled.withColumn("_h", place).where(F.col("_h") < share[F.col("lang")] * (1 << 30))
    most = 2 * TRAIN_DOCS * len(counts)

    def cut(batches):
        for b in batches:
            rows = []
            for text, lang in zip(byte_texts(b.column(0)), b.column(1).to_pylist()):
                if has_letter(text):
                    w = _windows(text)
                    for i in sorted({len(w) * k // TRAIN_WINDOWS for k in range(TRAIN_WINDOWS)}):
                        rows.append((w[i].tobytes(), lang))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["w", "lang"])

    sample = picked.orderBy("_h", "doc_id").limit(most).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = sorted((bytes(r.w), r.lang) for r in sample.mapInArrow(cut, "w binary, lang string").collect())
    return np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, WINDOW), [r[1] for r in rows]


def train(docs: DataFrame) -> ByteNetwork | None:
    windows, langs = training_windows(docs)
    if not langs:
        return None
    labels = sorted(set(langs))
    rng = np.random.default_rng(SEED)
    net = ByteNetwork(labels, rng)
    index = {k: i for i, k in enumerate(labels)}
    net.fit(windows, np.array([index[k] for k in langs]), rng)
    return net


def predictions(texts: list[bytes], net: ByteNetwork | None, tables) -> tuple[list[str], np.ndarray]:
    """Label and score of each text."""
    labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [k for k, t in enumerate(texts) if net is not None and has_letter(t)]
    n_windows = [-(-len(texts[k]) // WINDOW) for k in known]
    for i, j in chunks([n * WINDOW for n in n_windows], _CHUNK):
        data = np.concatenate([_windows(texts[k]) for k in known[i:j]])
        p = np.concatenate([net.predict(data[a : a + _CHUNK // WINDOW], tables) for a in range(0, len(data), _CHUNK // WINDOW)])
        start = np.r_[0, np.cumsum(n_windows[i:j])[:-1]]
        last = start + np.array(n_windows[i:j]) - 1
        weight = np.full(len(data), WINDOW, float)
        weight[last] = [(len(texts[k]) - 1) % WINDOW + 1 for k in known[i:j]]
        mean = np.add.reduceat(p * weight[:, None], start) / np.add.reduceat(weight, start)[:, None]
        best = mean.argmax(axis=1)
        for k, b, row in zip(known[i:j], best, mean):
            labels[k], scores[k] = net.labels[b], min(1.0, float(row[b]))
    return labels, scores


def identify(docs: DataFrame, net: ByteNetwork | None, *keep: str) -> DataFrame:
    """The columns `keep`, then lang_pred and score."""
    tables = net.tables() if net else None
    shared = docs.sparkSession.sparkContext.broadcast((net, tables))  # about six megabytes, whatever the input

    at = keep.index("text") if "text" in keep else len(keep)
    given = docs.select(*keep) if at < len(keep) else docs.select(*keep, F.col("text").cast("string").alias("_text"))

    def run(batches):
        own, by_pair = shared.value
        for b in batches:
            labels, scores = predictions(byte_texts(b.column(at)), own, by_pair)
            yield pa.record_batch([*b.columns[: len(keep)], pa.array(labels, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return small_batches(given).mapInArrow(trimmed(run), f"{schema}, lang_pred string, score double")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    return identify(docs, train(docs), "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
