"""Queries that write tables and read them back, and queries of the pluggable functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import bookkeeping, chunk, context, evaluate, parse, retrieval, vectors
from corpusloom.sources import files
from corpusloom.sources.shared import shared_folder
from corpusloom.streaming import jobs

from .evaluate_queries import GOLD, _ranked
from .projections import LINES, lines
from .registry import query, table
from .search_queries import CHUNKS, _benchmark_queries, _line_chunks


@query("read_eval_cases", "SELECT item_id, text AS question, 'truth ' || item_id AS ground_truth, 'd' || (item_id % 13) AS source_doc FROM benchmark")
def read_eval_cases(spark, sf_dir):
    d = F.col("item_id").cast("string")
    case = F.struct(F.col("text").alias("question"), F.concat(F.lit("truth "), d).alias("ground_truth"), F.struct(F.concat(F.lit("d"), (F.col("item_id") % 13).cast("string")).alias("source_doc")).alias("metadata"))
    path = shared_folder(spark, "cases")
    table(spark, sf_dir, "benchmark").select(F.lit("set").alias("name"), F.array(case).alias("cases")).write.option("lineSep", "\n").json(path)
    rows = spark.read.schema("name string, cases array<struct<question:string,ground_truth:string,metadata:struct<source_doc:string>>>").json(path)
    rows = rows.select(F.explode("cases").alias("c")).select("c.question", "c.ground_truth", "c.metadata.source_doc")
    return rows.select(F.substring("ground_truth", 7, 20).cast("long").alias("item_id"), "question", "ground_truth", "source_doc")


@query("artifact_store", "SELECT doc_id, 'c' || doc_id % 4 AS config_hash, sha256(text) AS content_hash FROM documents WHERE doc_id % 4 = 2")
def artifact_store(spark, sf_dir):
    path = shared_folder(spark, "artifacts")
    files.write_artifacts(table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("c"), (F.col("doc_id") % 4).cast("string")).alias("config_hash"), F.sha2("text", 256).alias("content_hash")), path)
    return spark.read.parquet(path).where("config_hash = 'c2'").select("doc_id", "config_hash", "content_hash")


@query("write_index", "SELECT vec_id AS chunk_id, label AS kb FROM embeddings WHERE label <> 3 OR vec_id % 2 = 0")
def write_index(spark, sf_dir):
    """The points of one knowledge base are written again; the others stay."""
    path = shared_folder(spark, "index")
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit("a").alias("cfg"), F.col("label").alias("kb"))
    files.write_index(points, path)
    files.write_index(points.where("kb = 3 and chunk_id % 2 = 0"), path)
    return spark.read.parquet(path).select("chunk_id", F.col("kb").cast("int").alias("kb"))


@query("write_eval_results", f"WITH {GOLD} SELECT config, case_id, gold_rank FROM ranked")
def write_eval_results(spark, sf_dir):
    path = shared_folder(spark, "results")
    ranked = _ranked(spark, sf_dir)
    files.write_eval_results(ranked, evaluate.hit_at_k(ranked), path)
    return spark.read.schema("config string, case_id long, gold_rank long").json(f"{path}/cases").select("config", "case_id", "gold_rank")


@query("mrr", f"WITH {GOLD} SELECT config, avg(coalesce(1.0::DOUBLE / gold_rank, 0)) AS mrr FROM ranked GROUP BY config")
def mrr(spark, sf_dir):
    return evaluate.hit_at_k(_ranked(spark, sf_dir)).select("config", "mrr")


@query("doc_chunks", f"WITH {LINES} SELECT doc_id, string_agg(content, '|' ORDER BY ord) AS texts, count(*) AS n_chunks FROM lines_ GROUP BY doc_id")
def doc_chunks(spark, sf_dir):
    return bookkeeping.doc_chunks(lines(spark, sf_dir).withColumnRenamed("content", "page_content")).withColumn("texts", F.array_join("texts", "|"))


def _stream(spark, sf_dir, name, columns=None):
    """A stream of the files of a table; one that is a single file is given to the stream by a pattern."""
    path = f"{sf_dir}/{name}.parque[t]"
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(path)


def _stages(config):
    """Parsing, chunking and embedding as stages of ingest."""
    return [
        ("parsed", lambda files_: jobs.unkeyed(parse.plain_text_pages(jobs.keyed(files_.select("doc_id", "content_hash", F.regexp_replace("text", "\n", "\n\n").alias("text")))))),
        ("chunked", lambda rows: jobs.unkeyed(chunk.semantic_chunk(jobs.keyed(rows), config))),
        ("embedded", lambda rows: jobs.unkeyed(vectors.embed_chunks(rows), "chunk_id")),
    ]


@query("stream_ingest", f"WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS doc_id, regexp_replace(string_agg(content, '' ORDER BY ord), '\\s+', '', 'g') AS text, true AS embedded, 1 AS versions FROM lines_ GROUP BY doc_id")
def stream_ingest(spark, sf_dir):
    """The stream runs to the end of the table, and a second stream brings every file again, which the ledger stops; the chunks of a document in order hold its whole text but for white space."""
    files_ = _stream(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("content_hash"))
    root = shared_folder(spark, "ingest")
    for _ in range(2):
        jobs.stream_ingest(files_, _stages(chunk.ChunkConfig(chunk_overlap=0)), root, shared_folder(spark, "stream-state")).awaitTermination()
    chunks = jobs.stage_rows(spark, root, "chunked").select("doc_id", "content_hash", "chunk_id", F.struct("order", "page_content").alias("part"), F.lit(None).cast("string").alias("embedded"))
    made = jobs.stage_rows(spark, root, "embedded").where("embedding is not null").select("doc_id", F.col("chunk_id").alias("embedded"))
    # both are gathered by document at once, so that texts are moved once
    rows = chunks.unionByName(made, allowMissingColumns=True).groupBy("doc_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.collect_set("chunk_id").alias("ids"), F.collect_set("embedded").alias("embedded"), F.size(F.collect_set("content_hash")).alias("versions"))
    text = F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["page_content"]), ""), r"\s+", "").alias("text")
    return rows.where(F.size("ids") > 0).select("doc_id", text, (F.size(F.array_except("ids", "embedded")) == 0).alias("embedded"), "versions")


@query("stream_synonyms", r"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\bthe\b', 'the (la)', 'gi'), '\bof\b', 'of (de)', 'gi') AS expanded FROM conversations WHERE role = 'user'")
def stream_synonyms(spark, sf_dir):
    """The stream of all user turns, expanded with the newest version of a dictionary table that has an older and an empty one."""
    path = shared_folder(spark, "dictionary")
    for version, entries in enumerate(([("the", ["old"]), ("and", ["older"])], [], [("the", ["la"]), ("of", ["de"])])):
        jobs.write_dictionary(spark, path, version, entries)
    turns = _stream(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    output = shared_folder(spark, "stream-synonyms")
    jobs.stream_synonyms(turns, path, output, shared_folder(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(output).select("conv_id", "turn", "expanded")


@query("tokenizer_udf", "SELECT doc_id, array_to_string(string_split(text, ' '), '|') AS tokens FROM documents")
def tokenizer_udf(spark, sf_dir):
    @F.pandas_udf("array<string>")
    def tokenizer(texts):
        return texts.map(lambda t: t.split(" "))

    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tokenizer("text"), "|").alias("tokens"))


@query("term_id_udf", f"WITH {CHUNKS}, t AS (SELECT DISTINCT unnest(tokens) AS term FROM queries) SELECT term, length(term) AS term_id FROM t")
def term_id_udf(spark, sf_dir):
    @F.pandas_udf("long")
    def mapper(terms):
        return terms.str.len()

    return _benchmark_queries(spark, sf_dir).select(F.explode("tokens").alias("term")).distinct().select("term", mapper("term").alias("term_id"))


@query("parser_udf", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, len(string_split(text, chr(10))) AS n, text FROM documents")
def parser_udf(spark, sf_dir):
    rows = parse.parse_with(table(spark, sf_dir, "documents"), "text", lambda t: [("paragraph", "text", x, None, False) for x in t.split("\n")])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("order", "content"))), lambda x: x["content"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(texts, "\n").alias("text"))


@query("compress_udf", f"WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS request_id, 'c' || doc_id || ':0' AS chunk_id, string_agg(content, chr(10) || chr(10) ORDER BY ord) AS content FROM lines_ GROUP BY doc_id")
def compress_udf(spark, sf_dir):
    """All lines of a document as one batch, merged by the plug-in into its first chunk."""
    d = F.col("doc_id").cast("string")
    sorted_ = F.array_sort(F.collect_list(F.struct("order", "content")))
    batches = lines(spark, sf_dir).groupBy("doc_id").agg(sorted_.alias("l")).select(d.alias("request_id"), F.lit(0).alias("batch"), F.lit(0.3).alias("target_ratio"), F.transform("l", lambda x: F.concat(F.lit("c"), d, F.lit(":"), x["order"].cast("string"))).alias("ids"), F.transform("l", lambda x: x["content"]).alias("contents"))
    return context.compress_apply(batches, lambda texts, ratio: "\n\n".join(texts)).select("request_id", "chunk_id", "content")


@query("rerank_udf", "SELECT item_id AS request_id, CAST(length(text) AS DOUBLE) AS score FROM benchmark")
def rerank_udf(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    hits = items.select(F.col("item_id").alias("request_id"), F.lit(0).alias("kb_pos"), F.lit(0).alias("query_pos"), F.lit(1).alias("rank"), F.lit("c").alias("chunk_id"), F.lit(0.5).alias("score"), F.col("text").alias("content"))
    queries = items.select(F.col("item_id").alias("request_id"), F.lit(0).alias("query_pos"), F.lit("q").alias("query"))

    def by_length(queries, texts):
        return texts.str.len().astype(float)

    return retrieval.rerank(hits, queries, 5, by_length).select("request_id", "score")


@query("embed_udf", f"WITH {CHUNKS} SELECT chunk_id, CAST(length(content) AS DOUBLE) AS first FROM chunks")
def embed_udf(spark, sf_dir):
    import numpy as np

    def embed(texts):
        return np.array([[len(t), 1.0] for t in texts], np.float32)

    return vectors.embed_chunks(_line_chunks(spark, sf_dir).select("chunk_id", F.col("content").alias("page_content")), embed).select("chunk_id", F.col("embedding")[0].cast("double").alias("first"))


@query("evaluator_udf", """SELECT conv_id * 100 + turn AS case_id, 'answer_ratio' AS name, length(text)::DOUBLE / greatest(length(role || left(text, 50)), 1) AS score FROM conversations
UNION ALL SELECT conv_id * 100 + turn, 'n_contexts', len(string_split(text, '. ')) FROM conversations""")
def evaluator_udf(spark, sf_dir):
    truth = F.concat("role", F.substring("text", 1, 50))
    cases = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("case_id"), F.col("text").alias("answer"), F.split("text", r"\. ", -1).alias("contexts"), truth.alias("ground_truth"))
    return evaluate.evaluate_cases(cases, evaluate.length_metrics)
