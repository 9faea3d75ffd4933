"""Quality rules: counting rules, and perplexity bands of an n-gram model counted by Spark over the whole corpus.

The model is modified Kneser-Ney over runs of ``ORDER`` = 5 UTF-8 bytes, one per language, of every document that passes the counting
rules; copies count as often as they occur. A run is packed in 40 bits, so its code is exact; no run is pruned and the number of
entries grows with the corpus. Entries are stored in arrays sorted by a hash of the code. Where a language has more than
``ENTRIES_AT_ONCE``, its arrays are cut by that hash, and its documents are read once for each part: a task holds one part.

Every run of a scored document was counted, so no score needs back-off. ``log_ppl`` is the negative log-probability of the whole text for each
byte of a letter or digit: signs and separators add to it and never dilute it. It is measured in robust deviations from what the
language has at that length: ``fit_lengths`` fits median and variance (from interquartile ranges) of the length classes of all
documents that pass the counting rules, as linear functions of 1 / word_chars. The band ends on either side where a normal distribution would have
``false_share`` of the documents that are found beyond (the step-up rule of Benjamini and Hochberg), so each language's tails decide
how many go.

Null or empty texts: all counts 0, ``base_failed`` true. Null languages form one language of their own. Repeated rows, equal or with
one doc_id, get a row each; ties have equal verdicts. Texts of any length are handled in blocks, but for their words, which one task holds
(16 bytes a word). Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import materialize
from .text import Texts, Words, blocks, mix, record_batch

ORDER = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])

#: Model entries that a task holds at once (12 bytes each, and 8 for each while they are sent).
ENTRIES_AT_ONCE = 4_000_000
#: Distinct runs that a counting task holds before it emits them.
COUNTED_AT_ONCE = 1_500_000
#: Bytes of text whose runs are worked on at once.
CODES_AT_ONCE = 1 << 20
#: Log-perplexity and deviations are binned to these widths for exact, order-independent quantiles and tail counts.
BIN, DEVIATION_BIN = 0.0005, 0.05
#: Deviations beyond this are counted as this.
FARTHEST = 40
#: Middle and robust deviation of a document's language at its length, and the document's distance from it.
MIDDLE = "(m0 + m1 / greatest(word_chars, 1))"
SPREAD = f"greatest(sqrt(v0 + v1 / greatest(word_chars, 1)), {BIN})"
DEVIATION = f"(log_ppl - {MIDDLE}) / {SPREAD}"
#: Rows of a few numbers that are broadcast; larger tables are joined as Spark sees fit.
SMALL_ROWS = 50_000
#: Documents that a length class needs to count in a fit.
CLASS_DOCS = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _codes(data: np.ndarray) -> np.ndarray:
    """Codes of all runs of ``ORDER`` bytes."""
    n = max(len(data) - ORDER + 1, 0)
    code = np.zeros(n, np.int64)
    for k in range(ORDER if n else 0):
        code <<= 8
        code |= data[k : n + k]
    return code


def _ranges(texts: Texts, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(text, codes) for each of the texts ``which``, a long text in parts."""
    for i in which:
        low, high = texts.offsets[i], texts.offsets[i + 1]
        for at in range(low, max(high - ORDER + 1, low), CODES_AT_ONCE):
            yield i, _codes(texts.data[at : min(at + CODES_AT_ONCE + ORDER - 1, high)])


def _by_language(langs: list[str]) -> dict[str, np.ndarray]:
    found: dict[str, list[int]] = {}
    for i, x in enumerate(langs):
        found.setdefault(x, []).append(i)
    return {x: np.array(at) for x, at in found.items()}


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes with their summed counts."""
    code, n = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(first) else n


def _base_failed(words: Words, repeats: np.ndarray) -> np.ndarray:
    return (words.count < 10) | (100 * repeats > 20 * words.count)


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, code, n): runs of every document that passes the counting rules, summed in each task before they are shuffled."""
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size: dict[str, int] = {}

        def add(lang: str, parts: list[np.ndarray]) -> None:
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            held.setdefault(lang, []).append((code, n))
            size[lang] = size.get(lang, 0) + len(code)
            if len(held[lang]) > 1 and size[lang] > 2 * len(held[lang][0][0]) + 500_000:
                held[lang] = [_merged(held[lang])]
                size[lang] = len(held[lang][0][0])

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                code, n = _merged(parts)
                yield record_batch(schema, [lang] * len(code), code, n)
            held.clear()
            size.clear()

        for batch, texts in blocks(batches):
            words = texts.words()
            passed = ~_base_failed(words, _repeat_words(words))
            for lang, which in _by_language(batch.column("lang").to_pylist()).items():
                parts, some = [], 0
                for _, code in _ranges(texts, which[passed[which]]):
                    parts.append(code)
                    some += len(code)
                    if some >= CODES_AT_ONCE:
                        add(lang, parts)
                        parts, some = [], 0
                if some:
                    add(lang, parts)
            if sum(size.values()) > COUNTED_AT_ONCE:
                yield from out()
        yield from out()

    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").mapInArrow(counts, "lang string, code long, n long")
    return rows.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def continuation_counts(counts: DataFrame) -> DataFrame:
    """(k, lang, code, n) of the runs of every order k: counts of the longest, distinct bytes before the shorter ones."""
    level, found = counts, counts.withColumn("k", F.lit(ORDER))
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("code")).agg(F.count("*").alias("n"))
        found = found.unionByName(level.withColumn("k", F.lit(k)))
    return found.select("k", "lang", "code", "n")


def _by_language_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A few numbers a language as a table, broadcast where it has at most ``SMALL_ROWS`` rows."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= SMALL_ROWS else table


def discounts(levels: DataFrame) -> DataFrame:
    """d1, d2, d3 by order and language from the counts of counts 1 to 4; 0.5 where those are too few to tell. ``ORDER`` rows a language reach the driver."""
    n = [F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.expr("n1 / (n1 + 2 * n2)")
    known = F.expr("n1 > 0 and n2 > 0 and n3 > 0")
    d = [F.when(known, F.greatest(F.lit(0.1), F.least(F.lit(k - 0.1), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(0.5).alias(f"d{k}") for k in (1, 2, 3)]
    rows = levels.groupBy("k", "lang").agg(*n).select("k", "lang", *d).collect()
    return _by_language_rows(levels.sparkSession, rows, "k int, lang string, d1 double, d2 double, d3 double")


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, code, p): interpolated probabilities of all runs from their counts.

    Lower orders use continuation counts; single bytes are mixed with the uniform distribution. A context has 256 entries at most, so
    its sums are a window.
    """
    levels = materialize(continuation_counts(counts), "ngram-levels")
    kept = F.expr("case when n = 1 then d1 when n = 2 then d2 else d3 end")
    context = Window.partitionBy("k", "lang", F.shiftright("code", 8))
    total, left = F.sum("n").over(context), F.sum("d").over(context)
    rows = levels.join(discounts(levels), ["k", "lang"]).select("k", "lang", "code", "n", kept.alias("d"))
    rows = materialize(rows.select("k", "lang", "code", ((F.col("n") - F.col("d")) / total).alias("share"), (left / total).alias("gamma")), "ngram-shares")
    p = rows.where("k = 1").select("lang", "code", (F.col("share") + F.col("gamma") / 256).alias("p"))
    for k in range(2, ORDER + 1):
        below = p.select("lang", F.col("code").alias("tail"), F.col("p").alias("below"))
        own = rows.where(F.col("k") == k).withColumn("tail", F.col("code").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
        p = own.join(below, ["lang", "tail"]).select("lang", "code", (F.col("share") + F.col("gamma") * F.col("below")).alias("p"))
    return materialize(p, "ngram-p")


class NgramArrays:
    """Hashes of codes in rising order beside log-probabilities, for some languages (or one hash range of one)."""

    def __init__(self, entries: pa.Table):
        self.arrays: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        langs = entries["lang"].combine_chunks().dictionary_encode() if entries.num_rows else pa.array([], pa.string()).dictionary_encode()
        number = np.asarray(langs.indices)
        key, value = mix(entries["code"].to_numpy().astype(np.uint64)), np.log(entries["p"].to_numpy()).astype(np.float32)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            at = np.flatnonzero(number == k)
            at = at[np.argsort(key[at])]
            bits = max(8, int(len(at)).bit_length())
            first = np.searchsorted(key[at] >> np.uint64(64 - bits), np.arange(1 << bits))
            self.arrays[lang] = key[at], value[at], first.astype(np.int32)

    def look_up(self, lang: str, code: np.ndarray) -> np.ndarray:
        """Log-probabilities of the codes, 0 for those that are not here."""
        key, value, first = self.arrays[lang]
        if not len(key):
            return np.zeros(len(code), np.float32)
        wanted = mix(code.astype(np.uint64))
        at = first[wanted >> np.uint64(65 - len(first).bit_length())]
        last = len(key) - 1
        np.minimum(at, last, out=at)
        behind = np.flatnonzero(key[at] < wanted)
        while len(behind):
            behind = behind[at[behind] < last]
            at[behind] += 1
            behind = behind[key[at[behind]] < wanted[behind]]
        return np.where(key[at] == wanted, value[at], np.float32(0))

    def totals(self, lang: str, texts: Texts, which: np.ndarray) -> np.ndarray:
        """Summed log-probability of each of the texts ``which``."""
        out, held, some = np.zeros(texts.n), [], 0
        for i, code in _ranges(texts, which):
            held.append((i, code))
            some += len(code)
            if some >= CODES_AT_ONCE:
                out, held, some = self._added(out, lang, held), [], 0
        return self._added(out, lang, held)[which] if held else out[which]

    def _added(self, out: np.ndarray, lang: str, held: list[tuple[int, np.ndarray]]) -> np.ndarray:
        owner = np.repeat([i for i, _ in held], [len(c) for _, c in held])
        return out + np.bincount(owner, self.look_up(lang, np.concatenate([c for _, c in held])), len(out))


def passes(entries: DataFrame, at_once: int = ENTRIES_AT_ONCE) -> list[tuple[list[str], int, int]]:
    """(languages, part, parts) of each reading of the documents: small languages together, a large one in parts."""
    out: list[tuple[list[str], int, int]] = []
    room = 0
    for lang, n in sorted(((r["lang"], r["count"]) for r in entries.groupBy("lang").count().collect()), key=lambda x: (-x[1], x[0])):
        if n > at_once:
            parts = -(-n // at_once)
            out += [([lang], k, parts) for k in range(parts)]
        elif n <= room:
            out[-1][0].append(lang)
            room -= n
        else:
            out.append(([lang], 0, 1))
            room = at_once - n
    return out


def document_stats(docs: DataFrame, entries: DataFrame, at_once: int = ENTRIES_AT_ONCE) -> DataFrame:
    """doc_id, lang and the counts of every document, with the ``log_ppl`` of those that pass the counting rules.

    Each reading gives every document that it concerns its part of the log-probability; the parts are added by document. A row that occurs m
    times is counted m times in each reading and comes back m times.
    """
    key = "doc_id long, lang string, digest binary, number int"
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("digest", pa.binary()), ("number", pa.int32()), *((c, pa.int64()) for c in (*COUNTS, "letters")), ("total", pa.float64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    found, judged = None, []
    for number, (langs, part, parts) in enumerate([*passes(entries, at_once), (None, 0, 1)]):
        if langs is None:  # languages without an entry
            own, model = rows.where(~F.col("lang").isin(judged)) if judged else rows, NgramArrays(pa.table({"lang": pa.array([], pa.string()), "code": pa.array([], pa.int64()), "p": pa.array([], pa.float64())}))
        else:
            judged += langs if part == 0 else []
            own = rows.where(F.col("lang").isin(langs))
            model = NgramArrays(entries.where(F.col("lang").isin(langs) & (F.pmod(F.xxhash64("code"), F.lit(parts)) == part)).toArrow())  # at_once entries or about that
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def stats(batches: Iterator[pa.RecordBatch], shared=shared, number=0 if part == 0 else number) -> Iterator[pa.RecordBatch]:
            for batch, texts in blocks(batches):
                words = texts.words()
                repeats = _repeat_words(words)
                total = np.zeros(texts.n)
                passed = ~_base_failed(words, repeats)
                for lang, which in _by_language(batch.column("lang").to_pylist()).items():
                    if lang in shared.value.arrays:
                        total[which[passed[which]]] = -shared.value.totals(lang, texts, which[passed[which]])
                chars = texts.per_text(((texts.data & 0xC0) != 0x80) & ~_SPACE[texts.data])
                digest = [hashlib.md5(texts.data[a:b], usedforsecurity=False).digest() for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist())]
                ppl = pa.array(total, mask=~(passed & (np.diff(texts.offsets) >= ORDER)))
                yield record_batch(schema, batch.column("doc_id"), batch.column("lang"), digest, [number] * texts.n, words.count, chars, texts.per_text(_SYMBOL[texts.data]), _dup_lines(texts), repeats, texts.per_text(_LETTER[texts.data]), ppl)

        read = own.mapInArrow(stats, f"{key}, {', '.join(f'{c} long' for c in (*COUNTS, 'letters'))}, total double")
        found = read if found is None else found.unionByName(read)
    copies = F.count_if(F.col("number") == 0)  # the first reading of a language has number 0
    one = found.groupBy("doc_id", "lang", "digest").agg(*(F.first(c).alias(c) for c in (*COUNTS, "letters")), copies.alias("copies"), (F.sum("total") / copies).alias("total"))
    ppl = F.round(F.col("total") / F.greatest("letters", F.lit(1)), 12).alias("log_ppl")
    return one.select("doc_id", "lang", "digest", *COUNTS, ppl, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def _dup_lines(texts: Texts) -> np.ndarray:
    out = np.zeros(texts.n, np.int64)
    for i in range(texts.n):
        lines = [x for x in texts.bytes(i).split(b"\n") if x and not x.isspace()]
        out[i] = len(lines) - len(set(lines))
    return out


def _repeat_words(words, width: int = 5) -> np.ndarray:
    """Words of each text in windows of ``width`` words that its text has twice or more."""
    at, h = words.windows(words.hashes(), width)
    if not len(at):
        return np.zeros(words.texts.n, np.int64)
    h ^= words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words.start) + 1, np.int64)
    edge[at[twice]] += 1
    edge[at[twice] + width] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(words.doc[covered], minlength=words.texts.n)


def length_classes(stats: DataFrame) -> DataFrame:
    """(lang, class, x, n, q): 1 / mean word_chars, documents and exact quartiles of the binned log-perplexities, by doubling
    length, of documents that pass the counting rules. A group holds a count for each bin, not its rows."""
    size = F.greatest("word_chars", F.lit(1))
    bins = F.floor(F.col("log_ppl") / BIN)
    groups = stats.where("not base_failed and log_ppl is not null").groupBy("lang", F.floor(F.log2(size)).alias("class"))
    return groups.agg((F.count("*") / F.sum(size)).alias("x"), F.count("*").alias("n"), F.percentile(bins, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"))


def _line(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted least squares of y on x; a constant where the x do not differ."""
    mx, my = np.average(x, weights=w), np.average(y, weights=w)
    sxx = np.sum(w * (x - mx) ** 2)
    slope = float(np.sum(w * (x - mx) * (y - my)) / sxx) if sxx > 0 else 0.0
    return float(my - slope * mx), slope


def fit_lengths(x: np.ndarray, n: np.ndarray, q1: np.ndarray, q2: np.ndarray, q3: np.ndarray) -> tuple[float, float, float, float]:
    """(m0, m1, v0, v1) of one language: centre m0 + m1 * x and variance v0 + v1 * x at x = 1 / word_chars, v0 and v1 not negative."""
    use = n >= min(CLASS_DOCS, n.max())
    x, n, q2, v = x[use], n[use].astype(float), q2[use], np.maximum((q3[use] - q1[use]) / 1.349, BIN) ** 2
    m0, m1 = _line(x, q2, n / v)
    w = n / v**2  # relative errors count alike
    v0, v1 = _line(x, v, w)
    if v1 < 0:
        v0, v1 = float(np.average(v, weights=w)), 0.0
    elif v0 < 0:
        v0, v1 = 0.0, float(np.sum(w * x * v) / np.sum(w * x * x))
    return m0, m1, v0, v1


def tail_bound(at: np.ndarray, n: np.ndarray, total: int, false_share: float) -> float:
    """The least deviation at which a normal tail over ``total`` documents is ``false_share`` of those beyond; ``n`` lie at or
    above each of the ascending ``at`` and below the next. Infinite where there is none."""
    beyond = np.cumsum(n[::-1])[::-1]
    chance = np.array([0.5 * total * math.erfc(z / math.sqrt(2)) for z in at])
    found = np.flatnonzero((at > 0) & (chance <= false_share * beyond))
    return float(at[found[0]]) if len(found) else math.inf


def perplexity_bands(stats: DataFrame, false_share: float) -> DataFrame:
    """(lang, m0, m1, v0, v1, low, high): each language's fit and its band in deviations. The driver gets a row for each length
    class and each binned deviation of a language."""
    spark = stats.sparkSession
    classes = length_classes(stats).orderBy("lang", "class").toPandas()
    fits = {lang: fit_lengths(own["x"].to_numpy(), own["n"].to_numpy(), *((np.stack(own["q"]) + 0.5) * BIN).T) for lang, own in classes.groupby("lang")}
    fitted = _by_language_rows(spark, [(k, *v) for k, v in fits.items()], "lang string, m0 double, m1 double, v0 double, v1 double")
    z = F.least(F.greatest(F.expr(DEVIATION), F.lit(-FARTHEST)), F.lit(FARTHEST))
    rows = stats.where("not base_failed and log_ppl is not null").join(fitted, "lang").groupBy("lang", F.floor(F.abs(z) / DEVIATION_BIN).alias("bin"), (z < 0).alias("below")).count().toPandas()
    bands = []
    for lang, own in rows.groupby("lang"):
        ends = []
        for side in (True, False):
            tail = own[own["below"] == side].sort_values("bin")
            ends.append(tail_bound(tail["bin"].to_numpy() * DEVIATION_BIN, tail["count"].to_numpy(), int(own["count"].sum()), false_share))
        bands.append((lang, *fits[lang], -ends[0], ends[1]))
    return _by_language_rows(spark, bands, "lang string, m0 double, m1 double, v0 double, v1 double, low double, high double")


def quality_rules(docs: DataFrame, false_share: float = 0.01) -> DataFrame:
    """One row per document: its language ('' for none) and the MD5 of its text, its counts, ``base_failed``, ``log_ppl``, the band's ``middle`` at its length with its extent below
    (``half_below``) and above (``half``), and the verdict ``kept``.

    ``kept`` is false where the counting rules fail or the log-perplexity lies outside the language's band. Texts under
    ``ORDER`` bytes have no perplexity verdict.
    """
    entries = kneser_ney(materialize(count_ngrams(docs), "ngram-counts"))
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    stats = materialize(document_stats(docs, entries).withColumn("base_failed", failed), "quality-stats")
    bands = perplexity_bands(stats, false_share)
    inside = F.expr(f"log_ppl is null or m0 is null or ({DEVIATION} > low and {DEVIATION} < high)")
    judged = stats.join(bands, "lang", "left").withColumn("kept", ~F.col("base_failed") & inside)
    return judged.select(*stats.columns, F.expr(f"{MIDDLE} as middle"), F.expr(f"-low * {SPREAD} as half_below"), F.expr(f"high * {SPREAD} as half"), "kept")
