"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Folding lower-cases, strips accents (composed or combining), maps look-alike letters of other scripts and compatibility forms
to Latin, and undoes digit substitutions; everything else but letters becomes a space. Signs that stand for several letters
match each of them; ``!`` and ``|`` are signs only before a letter or sign. Lexicon entries are whole words and word beginnings,
weighted by the log-odds of toxic against other training documents, as counted by Spark; every entry that passes the test of
``tested`` is kept. A word counts once, with its heaviest entry, and not inside an exception phrase: besides the given ones, these are the
pairs of neighbouring words, one of which has an entry, that training documents of the other label hold more often. A logistic curve
over the total weight and the weight per length gives the score.

Null and empty texts have no match. Without training rows of both labels the lexicon is empty and every score is 0.5. Repeated rows
get a row each (equal training texts of one label count once), ties equal scores, null ids are allowed, an empty table gives no rows, and no
column but doc_id and text is read. Long texts are folded and matched in pieces with the same result.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import materialize
from .text import CHUNK_BYTES, Texts, blocks, record_batch

#: Bound of the training sample, in documents. It bounds the lexicon too: an entry occurs in several of them.
MAX_ROWS = 20_000
PREFIXES = range(4, 9)
#: Training documents that an entry or an exception needs, whatever the size of the sample.
LEAST_DOCS = 5
#: Characters of a folded text matched at once.
MATCHED_AT_ONCE = 1 << 20

# Letters of other scripts that look like Latin letters, and digits and signs written for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "b",
}
DIGITS = {"0": "o", "1": "i", "2": "z", "6": "b", "!": "i", "|": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Signs of several readings; DIGITS has the one that training counts.
READINGS = {"1": "il", "!": "il", "|": "il", "6": "bg"}
_CLASS = str.maketrans({c: sign for sign, letters in (("1", "il1!|"), ("6", "bg6")) for c in letters})
#: Blocks of combining marks.
MARKS = (*range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x2100), *range(0xFE20, 0xFE30))
_DELETED = 1
#: Phrases in which an entry is harmless whatever the training documents say, in folded form.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "circus clown", "sore loser", "pond scum", "soap scum")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    one = np.full(256, 0x20, np.uint8)
    for b in range(128):
        c = DIGITS.get(chr(b), chr(b).lower())
        if c.isalpha():
            one[b] = ord(c)
    one[128:] = np.arange(128, 256)
    wide = np.zeros(0x110000, np.uint8)
    for cp in (*range(0x80, 0xD800), *range(0xE000, 0x20000)):
        c = unicodedata.normalize("NFKD", chr(cp))[:1].lower()
        c = LOOK_ALIKES.get(c, DIGITS.get(c, c) if c.isalnum() else c)
        if c.isascii() and c.isalpha():
            wide[cp] = ord(c)
        elif not chr(cp).isalpha():
            wide[cp] = 0x20
    wide[list(MARKS)] = _DELETED
    return one, wide


_ONE, _WIDE = _tables()
_SIGN = np.isin(np.arange(256), [ord(c) for c in READINGS])
_OPTIONAL = np.isin(np.arange(256), [ord("!"), ord("|")])


def fold(texts: Texts, signs: bool = False, at_once: int = 2 * CHUNK_BYTES) -> Texts:
    """Folded copies of the texts; with ``signs``, those of several readings stay as they are."""
    if len(texts.data) <= at_once or texts.n != 1:
        return _fold(texts, signs)
    parts, low = [], 0
    while low < len(texts.data):  # a long text is cut before spaces, where folding has no reach
        high = min(low + at_once, len(texts.data))
        spaces = np.flatnonzero(texts.data[high:] == 0x20) if high < len(texts.data) else [0]
        high = high + int(spaces[0]) if len(spaces) else len(texts.data)
        parts.append(_fold(Texts.of(texts.data[low:high], np.array([0, high - low])), signs).data)
        low = high
    data = np.concatenate(parts)
    return Texts.of(data, np.array([0, len(data)]))


def _fold(texts: Texts, signs: bool) -> Texts:
    d = np.concatenate([texts.data, np.zeros(3, np.uint8)]).astype(np.int32)
    n = len(texts.data)
    out, keep = _ONE[texts.data].copy(), np.ones(n, bool)
    for least, under, size in ((0xC2, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0xF5, 4)):
        first = np.flatnonzero((d[:n] >= least) & (d[:n] < under))
        cp = d[first] & (0x7F >> size)
        for k in range(1, size):
            cp = (cp << 6) | (d[first + k] & 63)
        to = _WIDE[np.minimum(cp, 0x10FFFF)]
        at = first[to > 0]
        out[at], keep[at] = to[to > 0], to[to > 0] != _DELETED
        for k in range(1, size):
            keep[at + k] = False
    if signs:
        out = np.where(_SIGN[texts.data], texts.data, out)
    # from the right: ! and | before a space or the end of their text are spaces
    final = np.zeros(n, bool)
    final[texts.offsets[1:][texts.offsets[1:] > texts.offsets[:-1]] - 1] = True
    for i in np.flatnonzero(_OPTIONAL[texts.data])[::-1]:
        if final[i] or out[i + 1] == 0x20:
            out[i] = 0x20
    return Texts.of(out[keep], np.concatenate([[0], np.cumsum(keep)])[texts.offsets])


def _padded(texts: Texts, i: int) -> str:
    return f" {texts.bytes(i).decode()} "


def _features(text: str) -> set[str]:
    """Entries that a folded text holds: ' word ' and ' begin'."""
    found = set()
    for w in set(text.split()):
        if len(w) >= 3:
            found.add(f" {w} ")
            found.update(f" {w[:k]}" for k in PREFIXES if k <= len(w))
    return found


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, curve: tuple[float, float, float] = (0.0, 0.0, 0.0)):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self._automaton = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            held: dict[str, list] = {}
            for phrase in self.exceptions:
                held.setdefault(f" {phrase} ".translate(_CLASS), []).append((f" {phrase} ", None))
            for entry, w in self.weights.items():
                held.setdefault(entry.translate(_CLASS), []).append((entry, w))
            for key, entries in held.items():  # entries that some reading may tell apart share a key
                self._automaton.add_word(key, entries)
            self._automaton.make_automaton()
        return self._automaton

    def _matches(self, text: str) -> tuple[dict[int, float], list[tuple[int, int]]]:
        """The heaviest weight at each matched start, and the places of exception phrases."""
        best: dict[int, float] = {}
        exempt: list[tuple[int, int]] = []
        for end, entries in self.automaton.iter(text.translate(_CLASS)):
            start = end - len(entries[0][0]) + 1
            seen = text[start : end + 1]
            for entry, w in entries:
                if seen != entry and not all(a == b or b in READINGS.get(a, "") for a, b in zip(seen, entry, strict=True)):
                    continue
                if w is None:
                    exempt.append((start, end))
                elif w > best.get(start, 0.0):
                    best[start] = w
        return best, exempt

    def total(self, text: str, at_once: int = MATCHED_AT_ONCE) -> float:
        """Summed weights of the matched words outside exception phrases."""
        reach = max(map(len, [*self.weights, *self.exceptions]), default=0) + 2
        total = 0.0
        for low in range(0, len(text), at_once):  # matches that start in each part, with what reaches into it
            before = max(low - reach, 0)
            best, exempt = self._matches(text[before : low + at_once + reach])
            starts, ends = [a for a, _ in sorted(exempt)], []
            for _, b in sorted(exempt):
                ends.append(max(b, ends[-1]) if ends else b)
            for at, w in best.items():
                k = bisect_right(starts, at) - 1
                if low <= before + at < low + at_once and not (k >= 0 and at < ends[k]):
                    total += w
        return total

    def totals(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Weight and number of words of each text."""
        folded = fold(texts, signs=True)
        solid = folded.data != 0x20
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        edges = folded.offsets[:-1][folded.offsets[:-1] < len(solid)]
        begins[edges] = solid[edges]
        automaton = self.automaton
        total = np.array([self.total(_padded(folded, i)) if len(automaton) else 0.0 for i in range(texts.n)])
        return total, folded.per_text(begins)

    def scores(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = _inputs(total, words) @ np.array(self.curve)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _inputs(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / (words + 20))], 1)


def _counted(rows: DataFrame, features) -> DataFrame:
    """(entry, toxic, other): documents of either label that hold each of the features of a folded text, summed in each task first."""
    schema = pa.schema([("entry", pa.string()), ("label", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def out() -> pa.RecordBatch:
            names, labels = zip(*held, strict=True) if held else ((), ())
            return record_batch(schema, list(names), list(labels), list(held.values()))

        for batch, texts in blocks(batches):
            folded = fold(texts)
            for i, label in enumerate(batch.column("label").to_pylist()):
                held.update((x, label) for x in features(_padded(folded, i)))
            if len(held) > 500_000:
                yield out()
                held.clear()
        yield out()

    label = F.col("label").cast("int").alias("label")
    found = rows.select(label, "text").mapInArrow(run, "entry string, label int, n long")
    count = lambda k, name: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(name)
    return found.groupBy("entry").agg(count(1, "toxic"), count(0, "other"))


def _log_odds(toxic: int, other: int) -> Column:
    """Of a document that holds the entry, from the numbers of training documents."""
    odds = lambda n, total: F.log((F.col(n) + 0.5) / (total - F.col(n) + 0.5))
    return odds("toxic", toxic) - odds("other", other)


def tested(counts: DataFrame, toxic: int, other: int) -> DataFrame:
    """(entry, weight) of the entries in ``LEAST_DOCS`` toxic documents or more that are ten times as frequent there and have log-odds of 2."""
    rows = counts.where((F.col("toxic") >= LEAST_DOCS) & (F.col("other") * toxic <= 0.1 * F.col("toxic") * other)).withColumn("w", _log_odds(toxic, other))
    return rows.where("w >= 2").select("entry", F.least("w", F.lit(8.0)).alias("weight"))


def harmless_pairs(rows: DataFrame, lexicon: "Lexicon", toxic: int, other: int) -> list[str]:
    """Pairs of neighbouring words, one of which has an entry, that are more frequent in documents that are not toxic."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon.weights)  # bounded by the sample

    def pairs(text: str) -> set[str]:
        words, weights = text.split(), shared.value
        hit = [bool(weights.keys() & _features(f" {w} ")) for w in words]
        return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if x or y}

    counts = _counted(rows, pairs).where(F.col("toxic") + F.col("other") >= LEAST_DOCS)
    return sorted(r["entry"] for r in counts.where(_log_odds(toxic, other) < 0).select("entry").collect())


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, ...]:
    """Newton's method with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -60, 60)))
        ridge = 0.05 * np.eye(len(b))
        b += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - 0.05 * b)
    return tuple(b.tolist())


def train(docs: DataFrame, labelled: DataFrame, max_rows: int = MAX_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """``labelled``: (doc_id, label 0 or 1) of the documents that may be learnt from; the ``max_rows`` rows with the least
    hash of doc_id are used. The tested entries and exceptions reach the driver, texts and counts do not."""
    sample = labelled.where("label in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # max_rows rows of two numbers
    rows = materialize(rows.groupBy(F.xxhash64("text"), "label").agg(F.first("text").alias("text")), "toxicity-sample")  # copies count once
    sizes = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return Lexicon({}, exceptions)
    weights = {r["entry"]: r["weight"] for r in tested(_counted(rows, _features), toxic, other).orderBy("entry").collect()}
    lexicon = Lexicon(weights, exceptions)
    lexicon = Lexicon(weights, tuple(dict.fromkeys([*exceptions, *harmless_pairs(rows, lexicon, toxic, other)])))
    schema = pa.schema([("label", pa.int32()), ("total", pa.float64()), ("words", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            yield record_batch(schema, batch.column("label"), *shared.value.totals(texts))

    table = rows.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(run, "label int, total double, words long").toArrow()
    lexicon.curve = _logistic(_inputs(table["total"].to_numpy(), table["words"].to_numpy()), table["label"].to_numpy().astype(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, weight) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("weight", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            total, words = shared.value.totals(texts)
            yield record_batch(schema, batch.column("doc_id"), shared.value.scores(total, words), total)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, weight double")
