"""Long texts in the operators that read windows, tokens and pages; repeated rows and null ids in packing and the pipeline."""

import hashlib
import zlib
from array import array
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bytecnn, language_id, packing, quality_cnn, warc

UNIT = "".join(f"word{k:03d} é漢 " for k in range(40)).encode()[:250].decode(errors="ignore").ljust(200)
UNIT += "x" * (256 - len(UNIT.encode()))


def test_windows_of_long_texts(spark):
    """A text of many equal windows scores as one of them."""
    docs = spark.createDataFrame([(1, UNIT * 2), (2, UNIT * 20_000)], "doc_id long, text string")
    assert len(UNIT.encode()) == 256 and 2 * bytecnn.CUT_AT_ONCE < 10_000
    model = language_id.LanguageModel(bytecnn.ByteCNN(3, filters=2, seed=3), ["a", "b", "c"])
    one, many = (r.score for r in language_id.identify(docs, model).orderBy("doc_id").collect())
    assert many == pytest.approx(one, abs=1e-6)
    one, many = (r.score for r in quality_cnn.score(docs, quality_cnn.QualityModel(bytecnn.ByteCNN(2, filters=2, seed=4))).orderBy("doc_id").collect())
    assert many == pytest.approx(one, abs=1e-4)


def brute_pieces(pieces, ids):
    """Each id of a document in exactly one of its pieces, in their order."""
    at = 0
    for p in sorted(pieces, key=lambda p: p.start):
        own = array("I", ids[p.start : p.start + p.length]).tobytes()
        assert p.start == at and p.ids_crc32 == zlib.crc32(own) and p.doc_tokens == len(ids)
        at += p.length
    assert at == len(ids)


def test_packing_of_long_texts_repeats_and_null_ids(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    long = " ".join(f"word{k * 7919 % 9973}" for k in range(350_000))
    rows = [(1, long), (None, "no id"), (None, "no id"), (2, "twice here"), (2, "twice here"), (3, None), (None, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path).collect()
    ids = {t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows}
    brute_pieces([p for p in got if p.doc_id == 1], ids[long])
    assert len(long) > 2 * (1 << 20)
    whole = Counter((p.doc_id, p.length, p.ids_crc32) for p in got if p.doc_id != 1 and p.length == p.doc_tokens)
    cut = sum(p.length for p in got if p.doc_id != 1 and p.length != p.doc_tokens)
    assert sum(n * k[1] for k, n in whole.items()) + cut == sum(len(ids[t]) for d, t in rows if d != 1)
    for (doc, text), n in Counter((d, t) for d, t in rows if d != 1).items():
        assert whole[doc, len(ids[text]), zlib.crc32(array("I", ids[text]).tobytes())] <= n
    filled = {}
    for p in got:
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == packing.LENGTH or at & (at - 1) == 0


def test_long_pages(spark):
    html = "<html><body>" + "<p>long page</p>" * 300_000 + "</body></html>"
    pages = spark.createDataFrame([(1, "http://a.example/x", html), (2, "http://a.example/y", None)], "page_id long, url string, html string")
    found = {r.record_id: r for r in warc.resolve_revisits(warc.records_from_pages(pages)).collect()}
    assert {r.payload_digest for r in found.values() if r.verdict == "resolved" and "/x" in r.canonical_url} == {hashlib.sha1(html.encode()).hexdigest()}


def test_repeated_rows_stay_the_same_in_any_partitions(spark):
    """Of rows with one doc_id and different texts or columns the first by text hash stays, whatever their order."""
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(4)]
    rows = [(1, texts[k % 4], "en", f"source{k}", 10) for k in range(12)] + [(2, texts[0] + " more words", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row_of_doc_id int")
    least = min(texts, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    kept = {tuple(map(tuple, pipeline.near_duplicates(spark, docs.repartition(n).orderBy(F.rand(n)), "").orderBy("doc_id").collect())) for n in (1, 3, 5)}
    assert len(kept) == 1
    first = next(iter(kept))[0]
    assert first[0] == 1 and first[1] == least and first[3] == min(r[3] for r in rows if r[1] == least)
