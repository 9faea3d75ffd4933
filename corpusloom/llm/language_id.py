"""Language identification by a byte convolutional network over fixed-length windows of the whole text.

Window probabilities are averaged by the bytes that the windows cover. Texts that are null or have no letter are ``und`` with
score 0; the text's first language in order of name wins a tie. With no training row every text is ``und``. Repeated rows get a row each
(as training rows of one doc_id they count each), null ids are allowed, an empty table gives no rows, and no column but doc_id and text is
read. A task holds ``CUT_AT_ONCE`` windows of a text of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytecnn import PAD, ByteCNN, softmax, training_windows, windows_of
from .text import Texts, blocks, record_batch

WINDOW = 512
#: Bounds of the training sample, in documents and in bytes of their whole texts.
MAX_ROWS, MAX_BYTES = 6_000, 4 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class LanguageModel:
    def __init__(self, net: ByteCNN | None, languages: list[str]):
        self.net, self.languages = net, languages

    def predict(self, texts: Texts) -> tuple[list[str], np.ndarray]:
        letters = texts.per_text(_LETTER[texts.data]) > 0
        wide = texts.per_text(texts.data >= 128) > 0
        for i in np.flatnonzero(wide & ~letters):
            letters[i] = any(map(str.isalpha, texts.bytes(i).decode()))
        if not self.net:
            return ["und"] * texts.n, np.zeros(texts.n)
        total = np.zeros((texts.n, len(self.languages)))
        for x, doc, used in windows_of(texts, WINDOW, WINDOW):
            p = softmax(self.net.logits(x).astype(float)) * used[:, None]
            total += np.stack([np.bincount(doc, p[:, k], texts.n) for k in range(p.shape[1])], 1)
        total /= np.maximum(np.diff(texts.offsets), 1)[:, None]
        best = total.argmax(axis=1)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, letters)], np.where(letters, np.clip(total[np.arange(texts.n), best], 0, 1), 0.0)


def train(docs: DataFrame, labelled: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> LanguageModel:
    """``labelled``: (doc_id, label) of the documents that may be learnt from."""
    x, y, weight, languages = training_windows(docs, labelled, max_rows, max_bytes, WINDOW, WINDOW)
    if not languages:
        return LanguageModel(None, [])
    # short pieces too, as many texts are short: of one window in two, a piece from its start
    random = np.random.default_rng(11)
    some = np.flatnonzero(random.random(len(x)) < 0.5)
    short = x[some]
    for row, keep in zip(short, random.integers(16, WINDOW, len(short))):
        row[keep:] = PAD
    net = ByteCNN(len(languages)).fit(np.concatenate([x, short]), np.concatenate([y, y[some]]), np.concatenate([weight, weight[some]]), epochs=4)
    return LanguageModel(net, languages)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every document from its whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some tens of kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            yield record_batch(schema, batch.column("doc_id"), *shared.value.predict(texts))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
