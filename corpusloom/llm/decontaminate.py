"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by their number of distinct shingles into classes of doubling size, each with an index of its own. A class keeps the bottom-k
MinHash values of its items with k = floor((1 - t) * largest size) + 1. An item of which a share t or more lies in a
document has at most floor((1 - t) * size) shingles elsewhere, so at least one of its k values is a shingle of that
document: the search misses nothing, whatever the document's length. Each candidate is then verified by the containment of all
its distinct shingles (64-bit hashes).

Words are maximal runs of Unicode letters and digits after lower-casing, so quotes, dashes and spaces of any script separate them.
Items under five words are one shingle of their own length; null, empty or wordless items match nothing. Repeated rows of either table
give a row for each pair of rows; ids may be null, but ``decontaminate`` drops by doc_id and keeps rows without one. A containment equal to the
threshold counts. Texts of any length are handled; a task holds the words of one text. No other column is read, whatever its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import materialize
from .text import Texts, Words, blocks, record_batch

SHINGLE = 5
#: Items that are searched for in one pass over the documents; more items take more passes.
ITEMS_PER_BLOCK = 20_000
#: Shingles of the items in one pass; this bounds what a task holds (8 bytes each, twice).
SHINGLES_PER_BLOCK = 4_000_000

_SPACE = np.arange(256) == 0x20


@lru_cache(maxsize=1)
def _code_points() -> np.ndarray:
    """The lower-case letter or digit of every code point, a space for all others."""
    points = [chr(c) for c in range(0x110000)]
    lower = (ord(c.lower()[0]) if c.isalnum() else 0x20 for c in points)
    out = np.fromiter(lower, np.uint32, len(points))
    out[ord("ς")] = ord("σ")  # both are the lower-case letter of one capital
    return out


def _folded_words(texts: Texts) -> Words:
    try:
        text = texts.data.tobytes().decode()
        first = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])[texts.offsets]  # code points before each text
    except UnicodeDecodeError:
        parts = [texts.bytes(i).decode(errors="replace") for i in range(texts.n)]
        text, first = "".join(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
    points = _code_points()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    sizes = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
    data = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
    return Words(Texts.of(data, np.concatenate([[0], np.cumsum(sizes)])[first]), _SPACE)


def item_shingles(items: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(item_id, width, shingles): the sorted distinct shingle hashes of every item that has a word."""
    schema = pa.schema([("item_id", pa.int64()), ("width", pa.int32()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            words = _folded_words(texts)
            hashes = words.hashes()
            widths = np.minimum(words.count, width)
            found = {int(w): words.windows(hashes, int(w)) for w in set(widths.tolist()) if w}
            rows = []
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                if w := int(widths[i]):
                    at, h = found[w]
                    rows.append((item, w, np.unique(h[words.doc[at] == i]).view(np.int64)))
            yield record_batch(schema, *(list(x) for x in zip(*rows, strict=True))) if rows else record_batch(schema, [], [], [])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, width int, shingles array<long>")


class ItemIndex:
    """Sketches and shingles of one block of items, by shingle width."""

    def __init__(self, table: pa.Table, threshold: float):
        self.threshold = threshold
        self.items = table["item_id"].to_pylist()
        self.shingles = [np.array(x, np.int64).view(np.uint64) for x in table["shingles"].to_pylist()]
        widths = table["width"].to_pylist()
        #: by shingle width and size class: sorted sketch values, their items, and a bitmap that passes over most other values
        self.classes = {}
        kinds = [(w, (len(own) - 1).bit_length()) for w, own in zip(widths, self.shingles, strict=True)]
        for w, size in sorted(set(kinds)):
            keys, owners = [], []
            for i in (i for i, x in enumerate(kinds) if x == (w, size)):
                k = min(len(self.shingles[i]), int((1 - threshold) * (1 << size) + 1e-9) + 1)
                keys.append(np.sort(self.shingles[i])[:k])
                owners.append(np.full(k, i))
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys, kind="stable")
            maybe = np.zeros(1 << max(16, min(24, 4 + len(keys).bit_length())), bool)
            maybe[keys & np.uint64(len(maybe) - 1)] = True
            self.classes[w, size] = keys[order], owners[order], maybe

    def candidates(self, kind: tuple[int, int], h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct (document, item number) pairs that share a sketch value of one class."""
        keys, owners, maybe = self.classes[kind]
        at = np.flatnonzero(maybe[h & np.uint64(len(maybe) - 1)])
        low, high = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
        n = high - low
        which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.unique(np.stack([np.repeat(doc[at], n), owners[which]], 1), axis=0)

    def matches(self, texts: Texts) -> Iterator[tuple[int, int, int, int]]:
        """(document, item number, shared, size) of the verified matches."""
        words = _folded_words(texts)
        hashes = words.hashes()
        for w in sorted({w for w, _ in self.classes}):
            at, h = words.windows(hashes, w)
            doc = words.doc[at]
            pairs = np.concatenate([self.candidates(kind, h, doc) for kind in self.classes if kind[0] == w])
            for d in np.unique(pairs[:, 0]):
                low, high = np.searchsorted(doc, [d, d + 1])
                own = np.unique(h[low:high])
                for _, i in pairs[pairs[:, 0] == d]:
                    mine = self.shingles[i]
                    place = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                    shared = int((own[place] == mine).sum())
                    if shared >= self.threshold * len(mine) - 1e-9:
                        yield int(d), int(i), shared, len(mine)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) for every document and item with containment >= threshold.

    Items are taken in blocks of a bounded size (by hash of their id), one pass over the documents each; a block
    is sent to the tasks, the documents are never shuffled. Empty tables give no rows.
    """
    shingled = materialize(item_shingles(items), "benchmark-shingles")
    n, total = shingled.agg(F.count("*"), F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()
    passes = max(1, -(-n // items_per_block), -(-total // SHINGLES_PER_BLOCK))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_shingles", pa.int64())])
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for block in range(passes):
        table = shingled.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == block).toArrow()
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(table, threshold))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch, texts in blocks(batches):
                if rows := list(index.value.matches(texts)):
                    d, i, shared, size = map(list, zip(*rows, strict=True))
                    yield record_batch(schema, batch.column("doc_id").take(pa.array(d)), [index.value.items[x] for x in i], shared, size)

        part = materialize(columns.mapInArrow(run, "doc_id long, item_id long, n_shared long, n_shingles long"), "contaminated-pairs")
        index.destroy()  # the driver and the executors hold one block at a time
        found = part if found is None else found.unionByName(part)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Documents that hold no benchmark item."""
    hit = materialize(contaminated(docs, items, threshold).select(F.col("doc_id").alias("contaminated_doc_id")).distinct(), "contaminated")
    return docs.join(hit, docs["doc_id"].cast("long") == hit["contaminated_doc_id"], "left_anti")
