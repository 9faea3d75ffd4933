"""Exact substring dedup by seed and extend: words covered by a repeat of ``LENGTH`` words or more are removed from all
documents but the one with the least doc_id.

Seeds are winnowed anchors: of the 3-word grams of every 13-word window, the longest in bytes (then the least hash, then the
first) is selected. The choice depends on the window's words alone, so a window that two documents share has the same
anchor at the same place in both. Anchors found in one document only are dropped; each occurrence of the others is extended both ways over all
windows that select it (up to 10 words on each side, a run):

* Runs with equal words are one class. If an earlier document has the class, the whole run is a repeat. Copies of any number
  meet here, one row each.
* Where an anchor has several classes, the first document of each joins the anchor's first document. The match is extended from the anchor
  to both sides, window by window, as far as the words agree.
* Windows that do not agree with it are compared among themselves: the first document that has a window, at this anchor, has priority.

No step makes pairs of occurrences. Overlapping matches unite to maximal repeats. Windows agree if their anchors (64 bits) and their
words (another 64 bits) have equal hashes. Null and empty texts have no word. ``doc_id`` names one text; repeated rows of a document get the same
result each. Rows without doc_id are kept whole and nothing repeats them. Ties do not occur: of equal windows that of the least doc_id stays.
Texts of any length are handled; a task holds the words of one text. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import materialize
from .text import WINDOW_FACTORS, Texts, blocks, mix, record_batch

LENGTH = 13
GRAM = 3


class Runs:
    """Runs of windows by anchor for the texts of one block."""

    def __init__(self, texts: Texts, length: int = LENGTH):
        self.words = words = texts.words()
        self.hashes = hashes = words.hashes()
        n = len(hashes) - length + 1
        self.length = length
        self.window = np.flatnonzero(words.doc[:n] == words.doc[length - 1 :]) if n > 0 else np.zeros(0, np.int64)
        if not len(self.window):
            self.low = self.high = self.doc = self.at = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        size = (words.end - words.start).astype(np.uint64)
        m = len(hashes) - GRAM + 1
        gram = sum(hashes[k : k + m] * WINDOW_FACTORS[k] for k in range(GRAM))
        gram = mix(gram)
        long = np.minimum(sum(size[k : k + m] for k in range(GRAM)), np.uint64(255))
        rank = ((np.uint64(255) - long) << np.uint64(56)) | (gram >> np.uint64(8))
        grams = length - GRAM + 1
        at = self.window + np.lib.stride_tricks.sliding_window_view(rank, grams)[self.window].argmin(axis=1)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        #: first and last window of each run, as word numbers of the block
        self.low, self.high = self.window[first], self.window[last]
        self.at, self.anchor, self.doc = at[first], gram[at[first]], words.doc[self.low]

    def keyed(self, anchors: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return anchors ^ mix(doc.astype(np.uint64) + np.uint64(1))

    def content(self, which: np.ndarray) -> np.ndarray:
        """Hash of all words of the runs ``which``."""
        factor = 0xD6E8FEB86659FD93
        n = len(self.hashes)
        powers, back = np.full(n + 1, factor, np.uint64), np.full(n + 1, pow(factor, -1, 1 << 64), np.uint64)
        powers[0] = back[0] = 1
        powers, back = np.multiply.accumulate(powers), np.multiply.accumulate(back)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * powers[:n])])
        low, end = self.low[which], self.high[which] + self.length
        return mix((total[end] - total[low]) * back[low] + (end - low).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def window_hashes(self) -> np.ndarray:
        """Hash of every window, by its first word number."""
        n = len(self.hashes) - self.length + 1
        h = np.zeros(n, np.uint64)
        for k in range(self.length):
            h += self.hashes[k : k + n] * WINDOW_FACTORS[k]
        return mix(h)


def anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(anchor, doc_id): the distinct anchors of every document."""
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            runs = Runs(texts, length)
            _, one = np.unique(runs.keyed(runs.anchor, runs.doc), return_index=True)
            yield record_batch(schema, runs.anchor[one].view(np.int64), batch.column("doc_id").take(pa.array(runs.doc[one])))

    return docs.mapInArrow(run, "anchor long, doc_id long")


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """Runs of the anchors in column ``shared``: their content hash, place, number of windows, the anchor's place in them and the windows' hashes."""
    schema = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("doc_id", pa.int64()), ("low", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("windows", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            runs, shared = Runs(texts, length), batch.column("shared")
            owner = np.repeat(np.arange(texts.n), shared.value_lengths().to_numpy(zero_copy_only=False))
            wanted = runs.keyed(shared.flatten().to_numpy().view(np.uint64), owner)
            which = np.flatnonzero(np.isin(runs.keyed(runs.anchor, runs.doc), wanted))
            if not len(which):
                continue
            h = runs.window_hashes().astype("<u8")
            low, high = runs.low[which], runs.high[which]
            windows = [h[a : b + 1].tobytes() for a, b in zip(low.tolist(), high.tolist())]
            place = (low - runs.words.first[runs.doc[which]]).astype(np.int32)
            doc = batch.column("doc_id").take(pa.array(runs.doc[which]))
            yield record_batch(schema, runs.anchor[which].view(np.int64), runs.content(which).view(np.int64), doc, place, (high - low + 1).astype(np.int32), (runs.at[which] - low).astype(np.int32), windows)

    return docs.mapInArrow(run, "anchor long, run long, doc_id long, low int, n int, off int, windows binary")


def _extended(rows: DataFrame) -> DataFrame:
    """(anchor, window, doc_id, low, agrees): every window of runs that are laid beside the first run of their anchor (first_doc, first_off,
    first_windows), and whether an earlier document's window agrees with it."""
    schema = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("doc_id", pa.int64()), ("low", pa.int32()), ("agrees", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, first = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i8") for c in ("windows", "first_windows"))
            n, m = (np.array([len(x) // 8 for x in batch.column(c).to_pylist()], np.int64) for c in ("windows", "first_windows"))
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            shift = (batch.column("first_off").to_numpy() - batch.column("off").to_numpy())[row]
            beside = step + shift  # windows at the same distance from the anchor
            inside = (beside >= 0) & (beside < m[row])
            agrees = np.zeros(len(row), bool)
            agrees[inside] = own[inside] == first[((np.cumsum(m) - m)[row] + beside)[inside]]
            doc = batch.column("doc_id").to_numpy()
            agrees &= (doc > batch.column("first_doc").to_numpy())[row]
            yield record_batch(schema, batch.column("anchor").to_numpy()[row], own, doc[row], (batch.column("low").to_numpy()[row] + step).astype(np.int32), agrees)

    return rows.mapInArrow(run, "anchor long, window long, doc_id long, low int, agrees boolean")


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, low, n): repeats of an earlier document, as first word and number of words; they may overlap.

    Tables that are joined on a hash are written first: both sides of such a join are then plain exchanges, whose hot
    keys (a passage in a third of all documents) Spark splits.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = anchors(docs, length)  # read twice; cheaper to find again than to keep on disk
    shared = materialize(found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"), "substring-shared")
    by_doc = materialize(found.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("shared")), "substring-seeds")  # anchors of one document
    runs = materialize(_runs(docs.join(by_doc, "doc_id"), length), "substring-runs")
    classes = materialize(runs.groupBy("anchor", "run").agg(F.min("doc_id").alias("first")), "substring-classes")
    several = materialize(classes.groupBy("anchor").agg(F.count("*").alias("n"), F.min_by("run", F.struct("first", "run")).alias("first_run")).where("n > 1").select("anchor", "first_run"), "substring-several")
    classes = materialize(classes.join(several, "anchor", "left"), "substring-runs-first")
    first = F.col("doc_id") == F.col("first")
    judged = runs.join(classes, ["anchor", "run"]).where(~first | F.col("first_run").isNotNull())
    judged = judged.select("anchor", "doc_id", "low", "n", "off", (~first).alias("repeat"), (first & (F.col("run") == F.col("first_run"))).alias("is_first"), F.when(first, F.col("windows")).alias("windows"))
    judged = materialize(judged, "substring-judged")
    whole = judged.where("repeat").select("doc_id", "low", (F.col("n") + (length - 1)).alias("n"))
    firsts = judged.where("is_first").groupBy("anchor").agg(F.min_by(F.struct("doc_id", "off", "windows"), "low").alias("f"))
    firsts = materialize(firsts.select("anchor", F.col("f.doc_id").alias("first_doc"), F.col("f.off").alias("first_off"), F.col("f.windows").alias("first_windows")), "substring-firsts")
    beside = judged.where("not repeat and not is_first").select("anchor", "doc_id", "low", "off", "windows").join(firsts, "anchor")
    windows = materialize(_extended(beside), "substring-windows")
    agreed = windows.where("agrees").select("doc_id", "low", F.lit(length).alias("n"))
    rest = windows.where("not agrees")
    earliest = materialize(rest.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("anchor", "window", "first"), "substring-windows-first")
    single = rest.join(earliest, ["anchor", "window"]).where("doc_id > first").select("doc_id", "low", F.lit(length).alias("n"))
    return whole.unionByName(agreed).unionByName(single)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by one space) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])
    spans = repeats(docs, length).groupBy("doc_id").agg(F.collect_list("low").alias("low"), F.collect_list("n").alias("n"))  # of one document
    spans = materialize(spans, "substring-spans").withColumnRenamed("doc_id", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            lows, ns = batch.column("low").to_pylist(), batch.column("n").to_pylist()
            words, removed, kept = [], [], []
            for i in range(texts.n):
                own = texts.bytes(i).split()
                gone = 0
                if lows[i]:
                    low, n = np.array(lows[i]), np.array(ns[i])
                    edge = np.bincount(low, minlength=len(own) + 1) - np.bincount(low + n, minlength=len(own) + 1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone = len(own) - int(keep.sum())
                    words.append(len(own))
                    own = [own[k] for k in np.flatnonzero(keep)]
                else:
                    words.append(len(own))
                removed.append(gone)
                kept.append(b" ".join(own))
            yield record_batch(schema, batch.column("doc_id"), words, removed, kept)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = docs.join(spans, docs["doc_id"] == spans["of"], "left").select("doc_id", "text", "low", "n")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    kept = remove_repeats(docs, length)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
