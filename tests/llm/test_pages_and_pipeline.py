"""Revisit resolution, and the pipeline's stages against brute force on a small table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import queries, warc

RECORD = "record_id long, url string, ts timestamp, kind string, status int, headers map<string,string>, payload_digest string"
DAY = dt.datetime(2024, 1, 1)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def brute_force(rows):
    weak = lambda t: t.removeprefix("W/")
    out = {}
    for r in (r for r in rows if r[3] == "revisit"):
        same = [s for s in rows if s[3] == "response" and s[4] == 200 and r[1] and s[1] and r[2] and s[2] and s[1].rstrip("/") == r[1].rstrip("/") and s[2] <= r[2]]
        if not same:
            out[r[0]] = (None, "no-response", None)
            continue
        s = max(same, key=lambda s: (s[2], s[0]))
        a, b = r[5] or {}, s[5] or {}
        if "etag" in a and "etag" in b:
            verdict = "resolved" if weak(a["etag"]) == weak(b["etag"]) else "validators-differ"
        elif "last-modified" in a and "last-modified" in b:
            verdict = "resolved" if a["last-modified"] == b["last-modified"] else "validators-differ"
        else:
            verdict = "unconfirmed"
        out[r[0]] = (s[0], verdict, {**b, **{k: v for k, v in a.items() if k not in warc.BODY_HEADERS}} if verdict == "resolved" else None)
    return out


def test_revisits_match_brute_force(spark):
    rows = [(1, "http://a/x", at(0), "response", 200, {"etag": '"1"', "server": "s", "content-length": "9"}, "d1"), (2, "http://a/x/", at(5), "response", 200, {"etag": '"2"'}, "d2"), (3, "http://a/x", at(5), "response", 200, {"etag": '"3"'}, "d3")]
    rows += [(10, "http://a/x", at(1), "revisit", 304, {"etag": 'W/"1"', "content-length": "0", "date": "d"}, None), (11, "http://a/x", at(5), "revisit", 304, {"etag": '"3"'}, None), (12, "http://a/x", at(90), "revisit", 304, {"etag": '"2"'}, None)]
    rows += [(13, "http://a/x", at(-1), "revisit", 304, {}, None), (14, None, at(9), "revisit", 304, {}, None), (15, "http://a/x", None, "revisit", 304, {}, None), (16, "http://a/x", at(9), "revisit", 304, {"last-modified": "x"}, None), (17, None, at(9), "response", 200, {}, "d"), (18, "http://b", at(9), "revisit", 304, None, None)]
    many = [(100 + k, "http://hot/", at(k / 7), "response" if k % 5 == 0 else "revisit", 200, {"etag": f'"{k // 10}"'}, f"p{k}") for k in range(300)]
    rows += [(4, "http://a/x", at(6), "response", 404, {"etag": '"4"'}, "d4"), (5, "http://a/x", at(6), "response", None, {"etag": '"4"'}, "d5"), (19, "http://a/x", at(7), "revisit", 304, {"etag": '"4"'}, None)]
    # a third of all records in one URL and hour, many in one second
    many += [(1000 + k, "http://hot/", at(50 + k // 4 / 3600), "response" if k % 7 == 0 else "revisit", 200, {"etag": f'"{k // 20}"'}, f"q{k}") for k in range(600)]
    for given in (rows, rows + many, rows + rows[:1]):
        found = warc.resolve_revisits(spark.createDataFrame(given, RECORD).withColumn("extra", F.lit(1)).repartition(4)).collect()
        assert {r.record_id: (r.response_id, r.verdict, r.headers) for r in found} == brute_force(given)
        assert len(found) == sum(r[3] == "revisit" for r in given) and all(r.extra == 1 for r in found)
    assert warc.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


def test_profiles_and_named_targets(spark):
    same = {"warc-profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    rows = [(1, "http://a/", at(0), "response", 200, {"etag": '"1"'}, "d1"), (2, "http://a/", at(1), "revisit", 200, {**same, "etag": '"2"'}, "d1"), (3, "http://a/", at(1), "revisit", 200, same, "d2"), (4, "http://b/", at(1), "revisit", 304, {"warc-refers-to-target-uri": "https://www.a", "etag": '"1"'}, None)]
    table = spark.createDataFrame(rows, RECORD).withColumns({"Verdict": F.lit("mine"), "bucket": F.lit(5), "second": F.lit(6)})
    found = warc.resolve_revisits(table)
    assert {r.record_id: (r.response_id, r.verdict, r.bucket, r.second) for r in found.collect()} == {2: (1, "resolved", 5, 6), 3: (1, "validators-differ", 5, 6), 4: (1, "resolved", 5, 6)}
    assert found.columns == [*warc.RESULT, "bucket", "second"]


@pytest.mark.parametrize(("url", "want"), [("HTTP://WWW.Example.COM:80/a/?b=2&a=1#top", "example.com/a?a=1&b=2"), ("https://example.com:443", "example.com"), ("https://e.com/x?utm_source=f&ref=z", "e.com/x"), ("", ""), (None, None)])
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u")).alias("c")).first().c == want


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_text_operators import brute_components, brute_contained, brute_counts, brute_fingerprint

    words = [f"{a}{b}" for a in ("riv", "sto", "gree", "wal", "und", "lig") for b in ("er", "ne", "ks", "ly", "ing", "ed")]
    item = " ".join(words[:20])
    texts = [" ".join(words[(i * 7 + k * (i + 3)) % 36] for k in range(60 + i)) + f" end{i}" for i in range(30)]
    texts += [texts[3], texts[3].upper(), texts[4] + " " + item, "too short", "same words here again now " * 20, texts[5] + ' password = "abcdefghijklmnop" x', None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    have, d = list(range(len(texts))), docs
    for name, stage in pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns
        rows = {r.doc_id: r for r in d.collect()}
        if name == "quality_rules":
            failed = {i for i in have if (c := brute_counts(texts[i]))[0] < 10 or 100 * c[4] > 20 * c[0]}
            assert failed & set(rows) == set() and len(set(have) - failed - set(rows)) <= 2
            have = sorted(rows)
        elif name == "simhash_near_dedup":
            have = sorted(set(brute_components(have, [brute_fingerprint(texts[i]) for i in have]).values()))
        elif name == "decontamination":
            hit = {i for i, _ in brute_contained([texts[i] or "" for i in have], [item])}
            have = [i for k, i in enumerate(have) if k not in hit]
        elif 35 in rows:
            assert rows[35].text == texts[5] + ' [SECRET]" x' and rows[35].n_chars == len(rows[35].text)
            assert all(r.text == texts[i] for i, r in rows.items() if i != 35)
        assert sorted(rows) == have, name
    packed = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(have)


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
