"""Every operator on tables with repeated rows, null ids, clashing column names and nothing at all."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, language_id, packing, quality_cnn, quality_rules, secret_scan, simhash, substring_dedup, toxicity

TEXT = " ".join(f"word{i}" for i in range(20))
CLASHES = "content blob fp low n shared hit kept label key words anchor run first findings score text_ chars middle half root masked_text contaminated_doc_id rule".split()
ROWS = [(1, TEXT), (1, TEXT), (2, TEXT), (None, TEXT), (3, None), (4, ""), (None, None), (5, "x" * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(None).cast("string") for c in CLASHES})


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


EVERY = sorted((i for i, _ in ROWS), key=lambda x: (x is None, x))


def test_each_row_has_a_result(spark, odd):
    labelled = odd.where("doc_id is not null").select("doc_id", F.lit("en").alias("label")).distinct()
    numbers = labelled.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    versions = odd.select("doc_id", F.lit(1).alias("version"), F.col("text").alias("content"))
    for result in (
        substring_dedup.digests(odd), simhash.near_duplicates(odd), quality_rules.quality_rules(odd), language_id.identify(odd, language_id.train(odd, labelled)),
        quality_cnn.score(odd, quality_cnn.train(odd, numbers)), toxicity.score(odd, toxicity.train(odd, numbers)), secret_scan.scan_versions(versions, ["doc_id"])[0],
    ):
        assert ids(result) == EVERY


def test_repeats_of_one_document(odd):
    got = [(r.doc_id, r.n_removed) for r in substring_dedup.digests(odd).where("doc_id <= 2").collect()]
    assert sorted(got) == [(1, 0), (1, 0), (2, 20)]
    classes = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).where("doc_id is not null").collect()}
    assert classes == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)}


def test_contaminated_columns(spark, odd):
    items = spark.createDataFrame([(0, TEXT), (0, TEXT), (None, TEXT), (1, None)], "item_id long, text string").withColumn("doc_id", F.lit(7))
    hits = decontaminate.contaminated(odd, items)
    assert {(r.doc_id, r.item_id) for r in hits.collect()} == {(1, 0), (2, 0), (None, 0), (1, None), (2, None), (None, None)}
    kept = decontaminate.decontaminate(odd, items)
    assert kept.columns == odd.columns


def test_packing_of_odd_rows(spark, odd):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    assert set(packing.pack(odd, path).toPandas()["doc_id"].dropna().astype(int)) == {1, 2, 3, 4, 5}


def test_pipeline_keeps_columns(spark, odd, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(0, "a b c d e f g h")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, empty = odd, odd.limit(0)
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns and stage(spark, empty, str(tmp_path)).count() == 0
        if name == "quality_rules":  # rows without doc_id, and null, empty and one-word texts are gone
            assert ids(docs) == [1, 1, 2]
            docs = docs.cache()
    assert ids(docs) == [1]


def test_pipeline_rules_for_odd_rows(spark, tmp_path, monkeypatch):
    """Rows of one doc_id are judged by their own texts, secrets are masked without n_chars, and clashing names are kept."""
    pipeline = pytest.importorskip("corpus_pipeline")
    names = ["n_chars_before", "N_CHARS_BEFORE_", "rejected_doc_id", "listed_doc_id", "scanned_blob", "digest"]
    rows = [(1, TEXT), (1, "short"), (2, TEXT + " password = abcdefghijklmnop"), (2, TEXT + " password = abcdefghijklmnop"), (None, TEXT)]
    wide = "lang string, m0 double, m1 double, v0 double, v1 double, low double, high double"
    monkeypatch.setattr(quality_rules, "perplexity_bands", lambda stats, share: spark.createDataFrame([("en", 0.0, 0.0, 1.0, 0.0, -math.inf, math.inf)], wide))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), **{c: F.lit(7) for c in names}})
    kept = pipeline.quality(spark, docs, str(tmp_path)).cache()
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, TEXT), (2, rows[2][1]), (2, rows[2][1])]
    unlike = kept.where("doc_id = 2").cache()
    once = pipeline.near_duplicates(spark, unlike, str(tmp_path)).cache()
    assert [r.text for r in once.collect()] == [rows[2][1]]
    for given in (once, once.withColumn("n_chars", F.length("text"))):
        masked = pipeline.secrets(spark, given, str(tmp_path))
        row = masked.first()
        assert masked.columns == given.columns and row.text == TEXT + " [SECRET]" and row.n_chars_before == 7
        assert "n_chars" not in given.columns or row.n_chars == len(row.text)


def test_one_group_of_copies_holds_a_third_of_all_rows(spark):
    """And one bucket, URL and hour: each row still has its result."""
    from test_text_operators import brute_components, brute_fingerprint, removed_by_brute_force

    texts = [TEXT] * 40 + [TEXT + f" end{i}" for i in range(20)] + [" ".join(f"u{i}w{k}" for k in range(30)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(docs).collect()}
    assert got == removed_by_brute_force(texts)
    prints = [brute_fingerprint(t) for t in texts]
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == brute_components(range(len(texts)), prints)


def test_long_texts(spark):
    """Texts over the size of a block, in the operators that cut them."""
    long = " ".join(f"word{i * 7919 % 99991}" for i in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, "tail " + long[: len(long) // 2]), (3, "password=abcdefghijklmnop " + "z" * 3_000_000)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    words = {i: len((r or "").split()) for i, r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: r.n_words for r in substring_dedup.digests(docs).collect()} == words
    assert {r.doc_id: r.n_words for r in quality_rules.quality_rules(docs).collect()} == words
    assert simhash.near_duplicates(docs).count() == 3
    masked = {r.doc_id: r.text for r in secret_scan.mask_column(docs).collect()}
    assert masked[1] == long and masked[3].startswith("[SECRET] zzz")
    item = " ".join(long.split()[390_000:390_020])
    hits = decontaminate.contaminated(docs, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in hits.collect()) == [1, 2]  # the words come again after 99,991
    lexicon = toxicity.Lexicon({" zzz": 1.0, " tail ": 2.0, " wor": 0.5})  # beginnings of words and a word
    count = lambda t: sum(w.startswith("wor") for w in t.split())
    assert {r.doc_id: r.weight for r in toxicity.score(docs, lexicon).collect()} == {1: 0.5 * count(long), 2: 2.0 + 0.5 * count(long[: len(long) // 2]), 3: 1.0}
