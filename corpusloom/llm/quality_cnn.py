"""Quality classifier: a byte convolutional network over overlapping chunks that cover the whole text.

Filters are max-pooled within a chunk; the chunks' log-odds are averaged, weighted by their bytes, into one probability.
Null and empty texts have one chunk of padding. With no training row, or one label alone, every score is the share of
label 1 (0.5 if there is none). Repeated rows get a row each, ties equal scores, null ids are allowed, an empty table gives no rows, and no
column but doc_id and text is read. A task holds ``CUT_AT_ONCE`` chunks of a text of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytecnn import ByteCNN, training_windows, windows_of
from .text import Texts, blocks, record_batch

CHUNK, STRIDE = 512, 256
#: Bounds of the training sample, in documents and in bytes of their whole texts.
MAX_ROWS, MAX_BYTES = 8_000, 6 << 20


class QualityModel:
    def __init__(self, net: ByteCNN | None, constant: float = 0.5):
        self.net, self.constant = net, constant

    def scores(self, texts: Texts) -> np.ndarray:
        if not self.net:
            return np.full(texts.n, self.constant)
        odds, total = np.zeros(texts.n), np.zeros(texts.n)
        for x, doc, used in windows_of(texts, CHUNK, STRIDE):
            z, weight = self.net.logits(x).astype(float), np.maximum(used, 1)
            odds += np.bincount(doc, (z[:, 1] - z[:, 0]) * weight, texts.n)
            total += np.bincount(doc, weight, texts.n)
        odds /= np.maximum(total, 1)
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def train(docs: DataFrame, labelled: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> QualityModel:
    """``labelled``: (doc_id, label 0 or 1) of the documents that may be learnt from."""
    x, y, weight, labels = training_windows(docs, labelled.where("label in (0, 1)"), max_rows, max_bytes, CHUNK, CHUNK)
    if len(labels) < 2:
        return QualityModel(None, float(labels[0]) if labels else 0.5)
    return QualityModel(ByteCNN(2, filters=16).fit(x, y, weight, epochs=6))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every document: the probability of label 1."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundreds of kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            yield record_batch(schema, batch.column("doc_id"), shared.value.scores(texts))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
