"""Which passages match these questions: documents to chunks to BM25 search with page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunk, parse, retrieval, vectors

from corpusloom.sources.shared import stored

from .registry import query, table

#: Hits that are sent to the chunks and documents; more are joined with them.
HITS_SENT = 200_000


@query("flagship")
def passages_for_questions(spark: SparkSession, sf_dir: str, limit: int = 5) -> DataFrame:
    """(request_id, final_rank, chunk_id, score, page_content) for every benchmark text as a question.

    Chunks are cut and the questions' terms in them counted in one reading of the documents, and the counts kept; the documents of the hits are read once more, for their pages.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    chunks = chunk.plain_text_chunks(docs).select("chunk_id", "doc_id", "page_ids", vectors.bm25_tokens(F.col("page_content")).alias("tokens"))
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), vectors.bm25_tokens(F.col("text")).alias("tokens"))
    hits = None
    for counted, terms in vectors.counted_terms(chunks, vectors.bm25_query_weights(questions)):
        best = stored(vectors.sparse_topk_scan(counted, terms, limit * 4), "best-chunks")
        best = F.broadcast(best) if best.count() <= HITS_SENT else best
        rows = counted.select("chunk_id", "doc_id", "page_ids").join(best, "chunk_id")
        hits = rows if hits is None else hits.unionByName(rows)
    hits = stored(hits.withColumnRenamed("query_id", "request_id").withColumns({"kb_pos": F.lit(0), "query_pos": F.lit(0)}), "placed-hits")
    found_in = hits.select(F.col("doc_id").alias("_doc")).distinct()
    found_in = F.broadcast(found_in) if found_in.count() <= HITS_SENT else found_in
    near = docs.join(found_in, F.col("doc_id").cast("string") == F.col("_doc"), "left_semi")
    found = retrieval.search(hits, parse.page_text(parse.plain_text_pages(near)).withColumnRenamed("text", "content"), limit)
    return found.select("request_id", "final_rank", "chunk_id", "score", "page_content")
