"""A byte-level convolutional network in numpy: filters of several widths, max pooling, softmax.

Every byte is a symbol of its own; 0xFF, which UTF-8 never has, pads and adds nothing. A filter of width w adds one weight per offset
and symbol. For scoring, the weights of two neighbouring offsets are summed into one table over symbol pairs, so that all
filters of widths 2 to 4 cost two table rows a byte.

Training reads every window of a sample of whole documents, bounded in rows and in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Texts, blocks, record_batch

SYMBOLS, PAD = 256, 255
WIDTHS = (2, 3, 4)
#: Steps that training takes at least.
LEAST_STEPS = 200
#: Windows convolved at once; keeps the intermediate table in cache.
_AT_ONCE = 64
#: Windows cut at once: what a task holds for a text of any length.
CUT_AT_ONCE = 1024


def windows_of(texts: Texts, length: int, stride: int, at_once: int = CUT_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of the windows (padded with ``PAD``), their text numbers and their numbers of bytes, ``at_once`` windows at a time.

    Windows start every ``stride`` bytes until the text is covered; an empty text has one window of padding.
    """
    sizes = np.diff(texts.offsets)
    n = np.maximum(1, -(-(sizes - (length - stride)) // stride))
    last = np.cumsum(n)
    data = texts.data if len(texts.data) else np.zeros(1, np.uint8)
    for low in range(0, int(last[-1]) if len(n) else 0, at_once):
        window = np.arange(low, min(low + at_once, int(last[-1])))
        doc = np.searchsorted(last, window, "right")
        start = texts.offsets[doc] + (window - (last - n)[doc]) * stride
        used = np.clip(texts.offsets[doc + 1] - start, 0, length)
        inside = np.arange(length) < used[:, None]
        at = np.minimum(start[:, None] + np.arange(length), len(data) - 1)
        yield np.where(inside, data[at], np.uint8(PAD)), doc, used


class ByteCNN:
    def __init__(self, classes: int, filters: int = 8, seed: int = 7):
        random = np.random.default_rng(seed)
        self.filters = filters
        total = filters * len(WIDTHS)
        #: weights[offset, symbol, filter]; filter columns are grouped by width, offsets beyond a width stay 0
        self.weights = np.zeros((max(WIDTHS), SYMBOLS, total), np.float32)
        for k, w in enumerate(WIDTHS):
            self.weights[:w, :PAD, k * filters : (k + 1) * filters] = random.normal(0, 0.3, (w, SYMBOLS - 1, filters))
        self.bias = np.zeros(total, np.float32)
        self.out = random.normal(0, 0.2, (total, classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        first = (w[0][:, None] + w[1][None]).reshape(SYMBOLS**2, -1)
        return first, np.ascontiguousarray((w[2][:, None] + w[3][None]).reshape(SYMBOLS**2, -1)[:, self.filters :])

    def _convolve(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        pad = np.full((len(x), x.shape[1] + 3), PAD, np.int32)
        pad[:, : x.shape[1]] = x
        pair = (pad[:, :-1] << 8) | pad[:, 1:]
        n = x.shape[1]
        out = np.take(tables[0], pair[:, :n], axis=0, mode="clip")
        out[:, :, self.filters :] += np.take(tables[1], pair[:, 2 : n + 2], axis=0, mode="clip")
        return out

    def _direct(self, x: np.ndarray) -> np.ndarray:
        """_convolve without tables, which change with every step of training."""
        n = x.shape[1]
        pad = np.pad(x, ((0, 0), (0, 3)), constant_values=PAD)
        out = self.weights[0][pad[:, :n]]
        for k in range(1, max(WIDTHS)):
            some = self.filters * max(0, k - 1)  # columns of narrower filters have no such offset
            out[:, :, some:] += self.weights[k][:, some:][pad[:, k : n + k]]
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        tables, parts = self._tables(), []
        for at in range(0, len(x), _AT_ONCE):
            pooled = self._convolve(x[at : at + _AT_ONCE], tables).max(axis=1)
            parts.append(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias)
        return np.concatenate(parts)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> "ByteCNN":
        """Adam on the cross-entropy; each class weighs the same, its windows as ``weight`` says. Filters learn at the maximum's position alone.

        A small sample is read more often, for ``LEAST_STEPS`` steps.
        """
        epochs = max(epochs, -(-LEAST_STEPS * batch // max(len(x), 1)))
        random = np.random.default_rng(seed)
        classes = np.bincount(y, weights=weight, minlength=len(self.out_bias))
        weight = (weight * len(y) / (np.count_nonzero(classes) * np.maximum(classes, 1e-9))[y]).astype(np.float32)
        names = ("weights", "bias", "out", "out_bias")
        first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
        used = [k // self.filters for k in range(len(self.bias))]
        for epoch in range(epochs):
            order = random.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                xs, n = x[rows], len(rows)
                conv = self._direct(xs)
                place = conv.argmax(axis=1)
                pooled = np.take_along_axis(conv, place[:, None], 1)[:, 0] + self.bias
                hidden = np.maximum(pooled, 0)
                p = softmax(hidden @ self.out + self.out_bias)
                p[np.arange(n), y[rows]] -= 1
                p *= weight[rows, None] / n
                back = (p @ self.out.T) * (pooled > 0)
                grads = {"out": hidden.T @ p, "out_bias": p.sum(axis=0), "bias": back.sum(axis=0), "weights": np.zeros_like(self.weights)}
                padded = np.pad(xs, ((0, 0), (0, 3)), constant_values=PAD)
                cell = place[:, :, None] + np.arange(max(WIDTHS))
                cell = padded[np.arange(n)[:, None, None], cell].astype(np.int64) * len(used) + np.arange(len(used))[None, :, None]
                for k in range(max(WIDTHS)):
                    some = np.flatnonzero(np.array(WIDTHS)[used] > k)
                    grads["weights"][k] = np.bincount(cell[:, some, k].ravel(), back[:, some].ravel(), SYMBOLS * len(used)).reshape(SYMBOLS, -1)
                grads["weights"][:, PAD] = 0
                step += 1
                speed = rate * (1 - 0.9 * epoch / max(epochs - 1, 1))
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grads[k]
                    second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                    value = getattr(self, k)
                    value -= (speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _sample(docs: DataFrame, labelled: DataFrame, max_rows: int, max_bytes: int) -> list[tuple[object, str]]:
    """(doc_id, label) of the first documents by the hash of doc_id, at most ``max_rows`` rows and ``max_bytes`` bytes of whole texts.

    Texts that alone pass the bound are left out. The sample ends before the first text that the rest of the bound does not hold, so that no other text
    is passed over for its length. At most max_rows rows of three short columns reach the driver.
    """
    first = labelled.select("doc_id", F.col("label").cast("string").alias("label")).where("label is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).where("size > 0").groupBy("doc_id").agg(F.sum("size").alias("size")).where(F.col("size") <= max_bytes)
    chosen, room = [], max_bytes
    for r in sizes.join(F.broadcast(first), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label").collect():
        if r["size"] > room:
            break
        chosen.append((r["doc_id"], r["label"]))
        room -= r["size"]
    return chosen


def training_windows(docs: DataFrame, labelled: DataFrame, max_rows: int, max_bytes: int, length: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Symbols, label numbers and weights of all windows of a bounded sample of ``labelled`` (doc_id, label), and the labels.

    A window weighs its share of its document, so that each document counts alike. About max_bytes * length / stride bytes reach the driver.
    """
    schema = pa.schema([("label", pa.string()), ("weight", pa.float64()), ("x", pa.binary())])
    chosen = _sample(docs, labelled, max_rows, max_bytes)
    if not chosen:
        return np.zeros((0, length), np.uint8), np.zeros(0, int), np.zeros(0), []
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = docs.sparkSession.createDataFrame(chosen, f"doc_id {kind}, label string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            labels, covered = batch.column("label").to_pylist(), np.zeros(texts.n)
            for _, doc, used in windows_of(texts, length, stride):
                covered += np.bincount(doc, used, texts.n)
            for x, doc, used in windows_of(texts, length, stride):
                some = np.flatnonzero(used)
                yield record_batch(schema, [labels[k] for k in doc[some]], used[some] / covered[doc[some]], [row.tobytes() for row in x[some]])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # max_rows rows of two short columns
    table = rows.select("label", "text").mapInArrow(cut, "label string, weight double, x binary").toArrow()
    found = sorted(zip(table["label"].to_pylist(), table["x"].to_pylist(), table["weight"].to_pylist(), strict=True))  # whatever order tasks end in
    labels = sorted({k for k, _, _ in found})
    x = np.array([np.frombuffer(b, np.uint8) for _, b, _ in found], np.uint8).reshape(-1, length)
    return x, np.array([labels.index(k) for k, _, _ in found], int), np.array([w for _, _, w in found]), labels
