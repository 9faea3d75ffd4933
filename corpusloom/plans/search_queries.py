"""Queries of vectors, retrieval, query processing and context packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import model
from corpusloom.operators import context, parse, query as q, retrieval, vectors
from corpusloom.sources.shared import stored

from .projections import ELEMENTS, LINES, elements, lines
from .registry import query, table

TOKENS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9à-öø-ÿœß]+'), lambda x: x <> '')"


def _line_chunks(spark, sf_dir):
    """The lines as chunks of their document's knowledge base, with tokens. Lines are joined with the documents only where a doc_id is repeated."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    repeated = stored(documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-documents")
    rows = lines(spark, sf_dir, "source").where("doc_id is not null")
    if not repeated.isEmpty():
        several = rows.join(repeated, "doc_id", "left_semi").drop("source").join(documents, "doc_id")
        rows = rows.join(repeated, "doc_id", "left_anti").unionByName(several)
    rows = rows.withColumnRenamed("source", "kb_id")
    ident = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("order").cast("string"))
    return rows.select("doc_id", "kb_id", "order", ident.alias("chunk_id"), "content", vectors.bm25_tokens(F.col("content")).alias("tokens"))


def _benchmark_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", vectors.bm25_tokens(F.col("text")).alias("tokens"))


CHUNKS = LINES + f""", chunks AS (SELECT l.doc_id, d.source AS kb_id, l.ord, l.doc_id || ':' || l.ord AS chunk_id, content, {TOKENS.format("content")} AS tokens FROM lines_ l JOIN documents d USING (doc_id)),
queries AS (SELECT item_id AS query_id, text, {TOKENS.format("text")} AS tokens FROM benchmark)"""
POSTINGS = CHUNKS + """, tf AS (SELECT chunk_id, len(tokens) AS n, unnest(tokens) AS term FROM chunks), postings AS (SELECT chunk_id, n, term, count(*) AS tf, count(*) * 2.5 / (count(*) + 1.5 * (0.25 + 0.75 * n / 300.0)) AS weight FROM tf GROUP BY chunk_id, n, term),
qterms AS (SELECT DISTINCT query_id, unnest(tokens) AS term FROM queries),
idf AS (SELECT term, count(*) AS n_chunks, ln(((SELECT count(*) FROM chunks) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM postings GROUP BY term)"""


@query("bm25_tokens", f"WITH {CHUNKS} SELECT chunk_id, array_to_string(tokens, ' ') AS tokens FROM chunks")
def bm25_tokens(spark, sf_dir):
    return _line_chunks(spark, sf_dir).select("chunk_id", F.array_join("tokens", " ").alias("tokens"))


@query("stable_token_id")
def stable_token_id(spark, sf_dir):
    """(term, term_id); SQL has no BLAKE2b, so tests/test_queries.py hashes every term again."""
    return vectors.term_ids(_line_chunks(spark, sf_dir).select(F.explode("tokens").alias("term")))


@query("bm25_doc_weights", f"WITH {POSTINGS} SELECT chunk_id, term, tf, CAST(weight AS DOUBLE) AS weight FROM postings")
def bm25_doc_weights(spark, sf_dir):
    return vectors.bm25_doc_weights(_line_chunks(spark, sf_dir))


@query("bm25_query_weights", f"WITH {POSTINGS} SELECT query_id, term, 1.0::DOUBLE AS weight FROM qterms")
def bm25_query_weights(spark, sf_dir):
    return vectors.bm25_query_weights(_benchmark_queries(spark, sf_dir))


@query("corpus_idf", f"WITH {POSTINGS} SELECT term, n_chunks, idf FROM idf")
def corpus_idf(spark, sf_dir):
    chunks = _line_chunks(spark, sf_dir)
    return vectors.corpus_idf(vectors.bm25_doc_weights(chunks), chunks)


SPARSE = POSTINGS + """, scored AS (SELECT query_id, chunk_id, round(sum(weight * idf), 9) AS score FROM postings JOIN qterms USING (term) JOIN idf USING (term) GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM scored) WHERE rank <= 10)"""


@query("sparse_topk", f"WITH {SPARSE} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM sparse")
def sparse_topk(spark, sf_dir):
    chunks = _line_chunks(spark, sf_dir)
    questions = vectors.query_idf(chunks, vectors.bm25_query_weights(_benchmark_queries(spark, sf_dir)))
    return vectors.sparse_topk_scan(chunks, questions, 10).withColumn("score", F.round("score", 6))


@query("sparse_topk_postings", f"WITH {SPARSE} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM sparse")
def sparse_topk_postings(spark, sf_dir):
    """The same search over stored weights of the queries' terms."""
    chunks = _line_chunks(spark, sf_dir)
    questions = vectors.bm25_query_weights(_benchmark_queries(spark, sf_dir))
    postings = stored(vectors.bm25_doc_weights(chunks).join(questions, "term", "left_semi"), "postings")
    found = vectors.sparse_topk(postings, questions, 10, vectors.corpus_idf(postings, chunks))
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


HASHED = "CAST('0x' || left(md5(w), 15) AS BIGINT)"


@query("embed_chunks", f"""WITH {CHUNKS}, words AS (SELECT chunk_id, unnest(list_filter(string_split_regex(lower(content), '\\s+'), lambda x: x <> '')) AS w FROM chunks), hashed AS (SELECT chunk_id, {HASHED} AS h FROM words),
  sums AS (SELECT chunk_id, h % 64 AS dim, sum(CASE WHEN h // 64 % 2 = 1 THEN 1 ELSE -1 END) AS v FROM hashed GROUP BY ALL)
  SELECT chunk_id, string_agg(dim || ':' || CAST(v AS INT), ',' ORDER BY dim) AS embedding FROM sums WHERE v <> 0 GROUP BY chunk_id""")
def embed_chunks(spark, sf_dir):
    rows = vectors.embed_chunks(_line_chunks(spark, sf_dir).select("chunk_id", F.col("content").alias("page_content")), vectors.hashed_counts)
    parts = F.filter(F.transform("embedding", lambda x, i: F.when(x != 0, F.concat_ws(":", i, x.cast("int")))), lambda x: x.isNotNull())
    return rows.select("chunk_id", F.array_join(parts, ",").alias("embedding")).where("embedding != ''")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("kb_id"), "embedding")


def _query_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("kb_id"), "embedding")


DOT = "list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
DENSE = f"""dense AS (SELECT * FROM (SELECT q.vec_id AS query_id, CAST(q.label AS VARCHAR) AS kb_id, c.vec_id AS chunk_id, round({DOT}, 9) AS score,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({DOT}, 9) DESC, c.vec_id) AS INT) AS rank FROM embeddings q JOIN embeddings c ON c.label = q.label WHERE q.vec_id % 100 = 0) WHERE rank <= 10)"""


@query("vector_similarity", f"""SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round({DOT}, 6) AS dot, round({DOT} / sqrt({DOT.replace("q.", "c.")} * {DOT.replace("c.embedding", "q.embedding")}), 6) AS cosine,
  round(-sqrt(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) ** 2))), 6) + 0.0 AS euclid FROM embeddings q JOIN embeddings c ON c.label = q.label WHERE q.vec_id % 100 = 0""")
def vector_similarity(spark, sf_dir):
    pairs = vectors.similar_pairs(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir))
    return pairs.select("query_id", "chunk_id", *((F.round(m, 6) + 0.0).alias(m) for m in ("dot", "cosine", "euclid")))


@query("dense_topk", f"WITH {DENSE} SELECT query_id, kb_id, chunk_id, round(score, 6) AS score, rank FROM dense")
def dense_topk(spark, sf_dir):
    return vectors.dense_topk(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


PAIRS = "SELECT a.vec_id, [a.embedding, b.embedding] AS vs FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
DOTS = "list_sum(list_transform(list_zip(q.vs[{0}], p.vs[{1}]), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@query("maxsim_topk", f"""WITH p AS ({PAIRS}), s AS (SELECT q.vec_id AS query_id, p.vec_id AS page_id, round(greatest({DOTS.format(1, 1)}, {DOTS.format(1, 2)}) + greatest({DOTS.format(2, 1)}, {DOTS.format(2, 2)}), 9) AS score FROM p q, p WHERE q.vec_id % 100 = 0)
SELECT query_id, page_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS INT) AS rank FROM s QUALIFY rank <= 5""")
def maxsim_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pages = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id").select(F.col("vec_id").alias("page_id"), F.array("embedding", "b").alias("vectors"))
    queries = pages.where("page_id % 100 = 0").withColumnRenamed("page_id", "query_id")
    return vectors.maxsim_topk(pages, queries, 5).withColumn("score", F.round("score", 6))


@query("candidate_limit", "SELECT doc_id, CAST(coalesce(CASE WHEN doc_id % 5 = 0 THEN 30 END, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 >= 1 THEN greatest((doc_id % 4 + 1) * 4, 10) ELSE (doc_id % 4 + 1) * 4 END) AS BIGINT) AS candidates FROM documents")
def candidate_limit(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.candidate_limit(d % 4 + 1, d % 3 + 1, d % 2 == 0, F.when(d % 5 == 0, 30)).cast("long").alias("candidates"))


@query("resolve_search", """
WITH r AS (SELECT conv_id AS request_id, CAST(conv_id % 120 AS INT) AS lim, CASE WHEN conv_id % 6 = 0 THEN 'hybrid' END AS mode, CASE WHEN conv_id % 3 = 0 THEN 'rr' END AS reranker,
  CASE WHEN conv_id % 2 = 0 THEN ['src1', 'src2', 'src1'] WHEN conv_id % 7 = 0 THEN ['nowhere'] ELSE ['src3'] END AS kbs FROM (SELECT DISTINCT conv_id FROM conversations)),
u AS (SELECT *, unnest(CASE WHEN len(kbs) = 3 THEN ['src1', 'src2'] ELSE kbs END) AS kb_id, generate_subscripts(CASE WHEN len(kbs) = 3 THEN ['src1', 'src2'] ELSE kbs END, 1) - 1 AS kb_pos FROM r),
j AS (SELECT u.*, CASE WHEN kb_id LIKE 'src%' THEN CASE WHEN kb_id = 'src1' THEN 'dense' ELSE 'hybrid' END END AS kb_mode, count(*) OVER w AS n FROM u WINDOW w AS (PARTITION BY request_id)),
k AS (SELECT *, bool_or(kb_mode IS NULL) OVER w AS missing, coalesce(bool_or(coalesce(mode, kb_mode) <> 'dense' AND kb_mode = 'dense') OVER w, false) AS donly FROM j WINDOW w AS (PARTITION BY request_id))
SELECT request_id, CAST(kb_pos AS INT) AS kb_pos, kb_id, coalesce(mode, kb_mode) AS mode, lim AS "limit", CAST(CASE WHEN reranker IS NOT NULL AND n >= 2 THEN greatest(lim * 4, 10) ELSE lim * 4 END AS INT) AS candidates,
  CASE WHEN NOT lim BETWEEN 1 AND 100 THEN 'limit out of range' WHEN missing THEN 'unknown knowledge base' WHEN donly THEN 'index is dense only' WHEN n >= 2 AND reranker IS NULL THEN 'several knowledge bases need a reranker' END AS error FROM k""")
def resolve_search(spark, sf_dir):
    c = F.col("conv_id")
    names = lambda *x: F.array(*map(F.lit, x))
    requests = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        c.alias("request_id"), F.when(c % 2 == 0, names("src1", "src2", "src1")).when(c % 7 == 0, names("nowhere")).otherwise(names("src3")).alias("kb_ids"), F.when(c % 6 == 0, "hybrid").alias("mode"),
        (c % 120).cast("int").alias("limit"), F.lit(None).cast("int").alias("candidates"), F.when(c % 3 == 0, "rr").alias("reranker"), F.lit(None).cast("int").alias("top_n"),
    )
    kbs = table(spark, sf_dir, "documents").select(F.col("source").alias("kb_id")).distinct().withColumn("kb_mode", F.when(F.col("kb_id") == "src1", "dense").otherwise("hybrid"))
    return retrieval.resolve_search(requests, kbs)


HITS = """hits AS (SELECT event_id, user_id AS request_id, CAST(event_id % 2 AS INT) AS kb_pos, CAST(event_id % 3 AS INT) AS query_pos, event_id AS rank, 'c' || (event_id % 97) AS chunk_id, 'd' || (event_id % (SELECT count(*) FROM documents)) AS doc_id,
  round(value % 1, 3) AS score, 'page_' || (event_id % 11) AS p1, 'page_' || (event_id % 5) AS p2 FROM events)"""


def _hits(spark, sf_dir):
    e = F.col("event_id")
    s = lambda prefix, n: F.concat(F.lit(prefix), (e % n).cast("string"))
    n = table(spark, sf_dir, "documents").count()
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), (e % 2).cast("int").alias("kb_pos"), (e % 3).cast("int").alias("query_pos"), e.alias("rank"), s("c", 97).alias("chunk_id"), s("d", n).alias("doc_id"), F.round(F.col("value") % 1, 3).alias("score"), F.array(s("page_", 11), s("page_", 5)).alias("page_ids"))


UNIQUE = HITS + ", uniq AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY request_id, chunk_id ORDER BY kb_pos, query_pos, rank) = 1), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, kb_pos, query_pos, rank) AS INT) AS position FROM uniq)"


@query("dedup_chunks", f"WITH {UNIQUE} SELECT request_id, chunk_id, kb_pos, query_pos, rank, score FROM uniq")
def dedup_chunks(spark, sf_dir):
    return retrieval.dedup_chunks(_hits(spark, sf_dir)).select("request_id", "chunk_id", "kb_pos", "query_pos", "rank", "score")


@query("rank_by_score", f"WITH {UNIQUE} SELECT request_id, chunk_id, score, position FROM ranked")
def rank_by_score(spark, sf_dir):
    return retrieval.rank_by_score(retrieval.dedup_chunks(_hits(spark, sf_dir))).select("request_id", "chunk_id", "score", "position")


PAGE_WALK = f"""RECURSIVE {UNIQUE}, walk AS (
  SELECT request_id, position, chunk_id, list_distinct([p1, p2]) AS seen, 1 AS kept, true AS took FROM ranked WHERE position = 1
  UNION ALL
  SELECT r.request_id, r.position, r.chunk_id, CASE WHEN t THEN list_distinct(list_concat(w.seen, [r.p1, r.p2])) ELSE w.seen END, w.kept + CASE WHEN t THEN 1 ELSE 0 END, t
  FROM (SELECT w.*, r.position AS rp, w.kept < 5 AND NOT (list_contains(w.seen, r.p1) AND list_contains(w.seen, r.p2)) AS t FROM walk w JOIN ranked r ON r.request_id = w.request_id AND r.position = w.position + 1) w
  JOIN ranked r ON r.request_id = w.request_id AND r.position = w.rp)"""


@query("page_dedup", f"WITH {PAGE_WALK} SELECT request_id, chunk_id, position, kept AS final_rank FROM walk WHERE took")
def page_dedup(spark, sf_dir):
    ranked = retrieval.rank_by_score(retrieval.dedup_chunks(_hits(spark, sf_dir)))
    return retrieval.page_dedup(ranked, 5).select("request_id", "chunk_id", "position", "final_rank")


PAGE_ROWS = ELEMENTS.removeprefix(LINES).removeprefix(", ") + """, pages_ AS (SELECT 'd' || doc_id AS doc_id, page_id, string_agg(content, chr(10) || chr(10) ORDER BY ord) AS content FROM elements_ WHERE NOT ignored GROUP BY ALL)"""


def _page_rows(spark, sf_dir):
    """The whole text of every page of every document."""
    rows = elements(spark, sf_dir).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return parse.page_text(rows).withColumnRenamed("text", "content")


ENRICH = f"""{LINES}, {PAGE_ROWS}, alone AS (SELECT page_id, arg_min(content, doc_id) AS content FROM pages_ GROUP BY page_id), refs AS (SELECT u.*, unnest([p1, p2]) AS page_id, generate_subscripts([p1, p2], 1) AS k FROM uniq u),
enriched AS (SELECT request_id, chunk_id, string_agg(coalesce(e.content, a.content), chr(10) || chr(10) ORDER BY k) AS page_content FROM refs r LEFT JOIN pages_ e ON e.doc_id = r.doc_id AND e.page_id = r.page_id LEFT JOIN alone a ON a.page_id = r.page_id GROUP BY ALL)"""


@query("page_enrich", f"WITH {UNIQUE}, {ENRICH} SELECT request_id, chunk_id, page_content FROM enriched")
def page_enrich(spark, sf_dir):
    return retrieval.page_enrich(retrieval.dedup_chunks(_hits(spark, sf_dir)), _page_rows(spark, sf_dir)).select("request_id", "chunk_id", "page_content")


@query("search", f"WITH {PAGE_WALK}, {ENRICH} SELECT w.request_id, w.chunk_id, kept AS final_rank, page_content FROM walk w JOIN enriched USING (request_id, chunk_id) WHERE took")
def search(spark, sf_dir):
    return retrieval.search(_hits(spark, sf_dir), _page_rows(spark, sf_dir), 5).select("request_id", "chunk_id", "final_rank", "page_content")


@query("hybrid_fuse", f"""WITH {UNIQUE}, a AS (SELECT request_id, chunk_id, position AS rank FROM ranked WHERE position <= 10), b AS (SELECT request_id, chunk_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY rank DESC) AS INT) AS r2 FROM uniq QUALIFY r2 <= 10),
b2 AS (SELECT request_id, chunk_id, r2 AS rank FROM b), f AS (SELECT request_id, chunk_id, round(coalesce(1 / (2.0 + a.rank - 1), 0) + coalesce(1 / (2.0 + b2.rank - 1), 0), 9) AS score FROM a FULL JOIN b2 USING (request_id, chunk_id))
SELECT request_id, chunk_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM f""")
def hybrid_fuse(spark, sf_dir):
    unique = retrieval.dedup_chunks(_hits(spark, sf_dir))
    first = retrieval.rank_by_score(unique).where("position <= 10").select("request_id", "chunk_id", F.col("position").alias("rank"))
    second = vectors.top_k(unique.withColumnRenamed("rank", "r"), ["request_id"], 10, [F.desc("r")]).select("request_id", "chunk_id", "rank")
    return retrieval.hybrid_fuse(first, second, ["request_id"])


@query("fan_out", """WITH k AS (SELECT DISTINCT conv_id AS request_id, unnest(['src1', 'src2']) AS kb_id, unnest([0, 1]) AS kb_pos FROM conversations), v AS (SELECT conv_id AS request_id, turn AS query_pos, text AS query FROM conversations WHERE role = 'user')
SELECT request_id, kb_id, query, CAST(row_number() OVER (PARTITION BY request_id ORDER BY kb_pos, query_pos) - 1 AS INT) AS task FROM k JOIN v USING (request_id)""")
def fan_out(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    kbs = turns.select(F.col("conv_id").alias("request_id")).distinct().select("request_id", F.posexplode(F.array(F.lit("src1"), F.lit("src2"))).alias("kb_pos", "kb_id"))
    variations = turns.where("role = 'user'").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("query_pos"), F.col("text").alias("query"))
    return retrieval.fan_out(kbs, variations).select("request_id", "kb_id", "query", "task")


def _text_hits(spark, sf_dir):
    hits = retrieval.dedup_chunks(_hits(spark, sf_dir)).withColumn("content", F.concat_ws(" ", "chunk_id", "doc_id", F.array_join("page_ids", " ")))
    queries = hits.select("request_id").distinct().select("request_id", F.lit(0).alias("query_pos"), F.concat(F.lit("c5 d3 page_4 page_"), (F.col("request_id") % 11).cast("string")).alias("query"))
    return hits, queries


RERANK = UNIQUE + """, rr AS (SELECT *, round(len(list_intersect(list_distinct(['c5', 'd3', 'page_4', 'page_' || (request_id % 11)]), [chunk_id, doc_id, p1, p2])) / len(list_distinct(['c5', 'd3', 'page_4', 'page_' || (request_id % 11)])), 6) AS s FROM uniq),
reranked AS (SELECT request_id, chunk_id, score AS vector_score, s AS rerank_score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY s DESC, kb_pos, query_pos, rank) AS INT) AS position FROM rr)"""


@query("rerank", f"WITH {RERANK} SELECT * FROM reranked WHERE position <= 20")
def rerank(spark, sf_dir):
    hits, queries = _text_hits(spark, sf_dir)
    return retrieval.rerank(hits, queries, 5).select("request_id", "chunk_id", "vector_score", F.round("rerank_score", 6).alias("rerank_score"), "position")


@query("prefilter", f"WITH {RERANK} SELECT request_id, chunk_id, position FROM reranked WHERE position <= 3")
def prefilter(spark, sf_dir):
    hits, queries = _text_hits(spark, sf_dir)
    return retrieval.prefilter(hits, queries, 3).select("request_id", "chunk_id", "position")


@query("last_user_query", "SELECT conv_id, nullif(trim(arg_max(text, turn)), '') AS query FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_query(spark, sf_dir):
    return q.last_user_query(table(spark, sf_dir, "conversations"))


@query("visible_text", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || 'end' ELSE 'a' || text || 'b' END AS text FROM conversations")
def visible_text(spark, sf_dir):
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    flat = F.to_json(F.array(part("thinking", F.lit("hm")), part("text", F.col("text")), part("text", F.lit("end"))))
    inner = F.array(part("reasoning", F.lit("why")), part("text", F.col("text")))
    nested = F.to_json(F.array(F.struct(F.lit("a").alias("text"), F.array().cast("array<struct<type:string,text:string>>").alias("content")), F.struct(F.lit(None).cast("string").alias("text"), inner.alias("content")), F.struct(F.lit("b").alias("text"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("content"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", q.visible_text(F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, flat).otherwise(nested)).alias("text"))


@query("history_window", """WITH n AS (SELECT *, string_agg(role || ': ' || text, chr(10)) OVER w AS h, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT conv_id, turn, coalesce(h, '') AS history, n >= 2 AS rewrite FROM n WHERE back = 1""")
def history_window(spark, sf_dir):
    return q.history_window(table(spark, sf_dir, "conversations"))


@query("clean_expansions", """WITH x AS (SELECT conv_id, turn, replace(text, chr(10), ' ') AS o FROM conversations) SELECT conv_id, turn, array_to_string(CASE WHEN turn % 2 = 0 THEN [trim(o), 'alpha', 'beta'] ELSE ['alpha', 'beta', trim(o)] END, '|') AS queries FROM x""")
def clean_expansions(spark, sf_dir):
    head = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    reply = F.when(F.col("turn") % 2 == 0, F.lit("1. alpha\n\n - beta\n3) alpha")).otherwise(F.concat(F.lit("1. alpha\n* beta\n"), head))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(q.clean_expansions(reply, head, 3), "|").alias("queries"))


DICTIONARY = [("the", ["la", "der"]), ("of", ["de"]), ("la", ["le"])]


@query("synonym_expand", r"""SELECT item_id, text AS query, regexp_replace(regexp_replace(regexp_replace(text, '\bthe\b', 'the (la, der)', 'gi'), '\bof\b', 'of (de)', 'gi'), '\bla\b', 'la (le)', 'gi') AS expanded FROM benchmark""")
def synonym_expand(spark, sf_dir):
    return q.synonym_expand(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query")), DICTIONARY)


def _entries(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").alias("id"), F.concat(F.lit("k"), (F.col("item_id") % 7).cast("string")).alias("keyword"), F.col("text").alias("synonym"))


@query("build_synonym_map", "SELECT 'k' || (item_id % 7) AS keyword, min(item_id) AS first_id, string_agg(text, '|' ORDER BY item_id) AS synonyms FROM benchmark GROUP BY 1")
def build_synonym_map(spark, sf_dir):
    return q.build_synonym_map(_entries(spark, sf_dir)).withColumn("synonyms", F.array_join("synonyms", "|"))


@query("synonym_search", "WITH e AS (SELECT 'k' || (item_id % 7) AS keyword, list(text) AS s FROM benchmark GROUP BY 1) SELECT keyword FROM e WHERE contains(keyword, 'the') OR len(list_filter(s, lambda x: contains(' ' || lower(x) || ' ', ' the '))) > 0")
def synonym_search(spark, sf_dir):
    entries = q.build_synonym_map(_entries(spark, sf_dir)).withColumn("description", F.lit(None).cast("string"))
    return q.synonym_search(entries, "The").select("keyword")


@query("parse_intent", "SELECT conv_id, turn, CASE WHEN contains(upper(text), 'TREE') THEN 'TREE' WHEN contains(upper(text), 'RAG') THEN 'RAG' ELSE 'CHAT' END AS intent, CASE WHEN contains(upper(text), 'FULL_TREE') THEN 'FULL_TREE' ELSE 'TARGETED_RAG' END AS strict FROM conversations")
def parse_intent(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", q.parse_intent(F.col("text")).alias("intent"), q.parse_intent(F.col("text"), True).alias("strict"))


def _ranked_hits(spark, sf_dir):
    return retrieval.page_dedup(retrieval.rank_by_score(retrieval.dedup_chunks(_hits(spark, sf_dir))), 5)


@query("reference_rows", f"WITH {PAGE_WALK}, n AS (SELECT w.request_id, w.chunk_id, w.kept, u.doc_id, u.p1, u.p2 FROM walk w JOIN uniq u USING (request_id, chunk_id) WHERE took) SELECT request_id, chunk_id, CAST(kept AS INT) AS \"index\", CASE WHEN doc_id = 'd3' THEN 'Unknown Source' ELSE doc_id END AS source, p1 || ', ' || p2 AS page FROM n")
def reference_rows(spark, sf_dir):
    none = F.lit(None).cast("string")
    hits = _ranked_hits(spark, sf_dir).select("request_id", "chunk_id", "final_rank", F.lit(" ").alias("source"), F.when(F.col("doc_id") != "d3", F.col("doc_id")).alias("filename"), none.alias("title"), none.alias("page"), none.alias("page_number"), F.col("page_ids").alias("page_numbers"))
    return context.reference_rows(hits).select("request_id", "chunk_id", "index", "source", "page")


@query("format_context", f"""WITH {PAGE_WALK}, {LINES}, {PAGE_ROWS}, texts AS (SELECT doc_id, min(content) AS content FROM pages_ GROUP BY doc_id),
n AS (SELECT w.request_id, w.chunk_id, u.doc_id, u.score, t.content, row_number() OVER (PARTITION BY w.request_id ORDER BY w.kept) AS i FROM walk w JOIN uniq u USING (request_id, chunk_id) JOIN texts t ON t.doc_id = u.doc_id WHERE took)
SELECT request_id, string_agg('[' || i || '] kb=kb doc=' || doc_id || ' chunk=' || chunk_id || ' score=' || format('{{:.4f}}', score) || chr(10) || content, chr(10) || chr(10) ORDER BY i) AS context FROM n GROUP BY request_id""")
def format_context(spark, sf_dir):
    none = F.lit(None).cast("string")
    hits = _ranked_hits(spark, sf_dir).join(_page_rows(spark, sf_dir).groupBy("doc_id").agg(F.min("content").alias("content")), "doc_id").select("request_id", "final_rank", F.lit("kb").alias("kb_id"), "doc_id", "chunk_id", "score", F.lit(None).cast("double").alias("rerank_score"), none.alias("source"), none.alias("page"), none.alias("page_content"), "content")
    return context.format_context(hits, None)


BATCHES = f"""RECURSIVE {UNIQUE}, t AS (SELECT request_id, position, score, length(chunk_id) * 200 AS n FROM ranked WHERE position <= 10), walk AS (
  SELECT request_id, position, score, n AS filled, 0 AS batch FROM t WHERE position = 1
  UNION ALL SELECT t.request_id, t.position, t.score, CASE WHEN w.filled + t.n > 2048 THEN t.n ELSE w.filled + t.n END, CASE WHEN w.filled + t.n > 2048 THEN w.batch + 1 ELSE w.batch END FROM walk w JOIN t ON t.request_id = w.request_id AND t.position = w.position + 1)"""


def _batched(spark, sf_dir):
    ranked = retrieval.rank_by_score(retrieval.dedup_chunks(_hits(spark, sf_dir))).withColumn("request_id", F.col("request_id").cast("string"))
    batches = context.token_batches(ranked.withColumn("n_tokens", F.length("chunk_id") * 200))
    return ranked.join(batches, ["request_id", "position"])


@query("token_batches", f"WITH {BATCHES} SELECT CAST(request_id AS VARCHAR) AS request_id, position, batch FROM walk")
def token_batches(spark, sf_dir):
    return _batched(spark, sf_dir).select("request_id", "position", "batch")


@query("compress_plan", f"WITH {BATCHES} SELECT CAST(request_id AS VARCHAR) AS request_id, batch, max(score) AS max_score, CASE WHEN max(score) >= 0.8 THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END AS target_ratio FROM walk GROUP BY ALL")
def compress_plan(spark, sf_dir):
    return context.compress_plan(_batched(spark, sf_dir))


@query("compress_apply", f"""WITH {BATCHES}, b AS (SELECT w.request_id, w.batch, max(w.score) OVER (PARTITION BY w.request_id, w.batch) AS s, r.chunk_id FROM walk w JOIN ranked r USING (request_id, position))
SELECT CAST(request_id AS VARCHAR) AS request_id, batch, chunk_id, CASE WHEN s >= 0.8 THEN 'text of' ELSE 'text' END AS content, NULL AS original_chunks FROM b""")
def compress_apply(spark, sf_dir):
    rows = _batched(spark, sf_dir)
    lists = rows.groupBy("request_id", "batch").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))).alias("l"), F.max("score").alias("s"))
    lists = lists.select("request_id", "batch", F.when(F.col("s") >= 0.8, 0.8).otherwise(0.3).alias("target_ratio"), F.transform("l", lambda x: x["chunk_id"]).alias("ids"), F.transform("l", lambda x: F.concat(F.lit("text of "), x["chunk_id"])).alias("contents"))
    return context.compress_apply(lists, model.shorten)


@query("pack_budget", "WITH b AS (SELECT o_orderkey, o_orderkey % 5000 - 300 AS before FROM orders) SELECT o_orderkey, CASE WHEN before > 0 AND before - floor(before * 0.1) - 100 > 0 THEN CAST(before - floor(before * 0.1) - 100 AS BIGINT) END AS budget FROM b")
def pack_budget(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", context.pack_budget(F.col("o_orderkey") % 5000, F.lit(100), F.lit(200)).alias("budget"))


@query("repack")
def repack(spark, sf_dir):
    return context.repack(lines(spark, sf_dir), 200)


def _outermost(block):
    """The first and the last word of a block by code points: those of several blocks' summaries are those of the blocks."""
    words = block.split()
    return f"{min(words)} {max(words)}"


@query("tree_reduce", f"""WITH {LINES}, w AS (SELECT doc_id, unnest(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) AS word FROM lines_)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, min(word) || ' ' || max(word) AS summary, NULL AS error FROM w GROUP BY doc_id""")
def tree_reduce(spark, sf_dir):
    """The root depends on every block of every level."""
    return context.tree_reduce(lines(spark, sf_dir), 200, _outermost).select("doc_id", "summary", "error")


@query("session_gate", """WITH a AS (SELECT conv_id AS thread_id, turn, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN 'PENDING' WHEN (conv_id + turn) % 3 = 0 OR conv_id % 11 = 3 THEN 'FAILED' ELSE 'COMPLETED' END AS status, 'f' || turn AS filename FROM conversations),
g AS (SELECT thread_id, coalesce(string_agg(filename, ',' ORDER BY turn) FILTER (status = 'PENDING'), '') AS pending, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (status = 'COMPLETED'), '') AS doc_ids,
  coalesce(string_agg(filename, ',' ORDER BY turn) FILTER (status = 'FAILED'), '') AS failed FROM a GROUP BY thread_id) SELECT *, CASE WHEN pending <> '' THEN 'blocked' WHEN doc_ids = '' THEN 'error' ELSE 'ready' END AS state FROM g""")
def session_gate(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    status = F.when((c % 5 == 0) & (t == 1), "PENDING").when(((c + t) % 3 == 0) | (c % 11 == 3), "FAILED").otherwise("COMPLETED")
    rows = table(spark, sf_dir, "conversations").select(c.alias("thread_id"), t.alias("position"), status.alias("status"), F.concat(F.lit("f"), t.cast("string")).alias("filename"), t.alias("doc_id"), F.lit("kb").alias("kb_id"))
    return context.session_gate(rows).select("thread_id", *(F.array_join(x, ",").alias(x) for x in ("pending", "doc_ids", "failed")), "state")
