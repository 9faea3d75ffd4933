"""Batch retrieval: many requests at once over candidate lists."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.tokens import token_truncate
from corpusloom.sources.shared import stored

#: Page ids that are sent to the pages; more are joined with them.
PAGES_SENT = 200_000


def candidate_limit(limit: Column, kb_count: Column, reranked: Column, asked: Column) -> Column:
    """Candidates per knowledge base: as asked, else four times the limit, at least ten when several are reranked."""
    return F.coalesce(asked, F.when(reranked & (kb_count >= 2), F.greatest(limit * 4, F.lit(10))).otherwise(limit * 4))


def resolve_search(requests: DataFrame, kbs: DataFrame) -> DataFrame:
    """One row per request and knowledge base, with its search mode and candidate limit, and an ``error`` for the whole request.

    requests: request_id, kb_ids, mode (null: the knowledge base's), limit, candidates, reranker, top_n. kbs: kb_id, kb_mode. A
    knowledge base named twice counts once, at its first place.
    """
    rows = requests.select("*", F.posexplode(F.array_distinct("kb_ids")).alias("kb_pos", "kb_id")).join(kbs, "kb_id", "left")
    per = Window.partitionBy("request_id")
    n = F.count("*").over(per)
    rows = rows.withColumns({"kb_count": n, "missing": F.max(F.col("kb_mode").isNull()).over(per), "dense_only": F.max((F.coalesce("mode", "kb_mode") != "dense") & (F.col("kb_mode") == "dense")).over(per)})
    reranked = F.col("reranker").isNotNull()
    error = (
        F.when(~F.col("limit").between(1, 100), "limit out of range").when(~F.col("candidates").between(1, 500), "candidates out of range").when(F.col("missing"), "unknown knowledge base")
        .when(F.coalesce("dense_only", F.lit(False)), "index is dense only").when((F.col("kb_count") >= 2) & ~reranked, "several knowledge bases need a reranker")
        .when(reranked & (F.col("top_n") < F.col("limit")), "top_n under limit")
    )
    return rows.select("request_id", "kb_pos", "kb_id", F.coalesce("mode", "kb_mode").alias("mode"), "limit", candidate_limit(F.col("limit"), F.col("kb_count"), reranked, F.col("candidates")).cast("int").alias("candidates"), error.alias("error"))


def hybrid_fuse(dense: DataFrame, sparse: DataFrame, keys: list[str], k: float = 2.0) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists: the sum of 1 / (k + rank from 0)."""
    a, b = dense.select(*keys, "chunk_id", F.col("rank").alias("_d")), sparse.select(*keys, "chunk_id", F.col("rank").alias("_s"))
    score = F.coalesce(1 / (k + F.col("_d") - 1), F.lit(0.0)) + F.coalesce(1 / (k + F.col("_s") - 1), F.lit(0.0))
    fused = a.join(b, [*keys, "chunk_id"], "full").withColumn("score", F.round(score, 9))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id"))).drop("_d", "_s")


def fan_out(kbs: DataFrame, variations: DataFrame) -> DataFrame:
    """Every (knowledge base, query variation) of a request, numbered in that order. Both lists are a request's own."""
    return kbs.join(variations, "request_id").withColumn("task", F.row_number().over(Window.partitionBy("request_id").orderBy("kb_pos", "query_pos")) - 1)


def without_failed(hits: DataFrame, failures: DataFrame) -> DataFrame:
    """Hits of the searches that worked: those of a failed (request_id, kb_pos, query_pos) are dropped, the request's others stay."""
    return hits.join(failures.select("request_id", "kb_pos", "query_pos").distinct(), ["request_id", "kb_pos", "query_pos"], "left_anti")


def dedup_chunks(hits: DataFrame) -> DataFrame:
    """Of equal chunk_ids in a request the first in (kb_pos, query_pos, rank), found by a partial aggregate."""
    rest = [c for c in hits.columns if c not in ("request_id", "chunk_id")]
    first = hits.groupBy("request_id", "chunk_id").agg(F.min_by(F.struct(*rest), F.struct("kb_pos", "query_pos", "rank")).alias("_h"))
    return first.select("request_id", "chunk_id", "_h.*")


def rank_by_score(hits: DataFrame) -> DataFrame:
    """position: by falling score, equal scores in the order they came."""
    return hits.withColumn("position", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "kb_pos", "query_pos", "rank")))


def overlap_score(queries: pd.Series, texts: pd.Series) -> pd.Series:
    """Share of the query's words that the text has: a deterministic stand-in for a reranking model."""
    return pd.Series([len((q := set(a.lower().split())) & set(b.lower().split())) / max(len(q), 1) for a, b in zip(queries, texts)])


def rerank(hits: DataFrame, queries: DataFrame, limit: int, score: Callable[[pd.Series, pd.Series], pd.Series] = overlap_score, top_n: int | None = None, max_tokens: int = 400) -> DataFrame:
    """Hits scored against the first query of their request; the old score is kept as vector_score.

    Scorers see ``max_tokens`` of a text; rows that they leave null are dropped. max(top_n, 4 * limit) stay.
    """
    model = F.pandas_udf(score, "double")
    rows = hits.join(queries.where("query_pos = 0").select("request_id", "query"), "request_id").withColumn("rerank_score", model("query", token_truncate(F.col("content"), F.lit("en"), max_tokens)))
    rows = rows.where("rerank_score is not null").withColumn("vector_score", F.col("score")).withColumn("score", F.col("rerank_score"))
    keep = max(top_n or 0, limit * 4)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "kb_pos", "query_pos", "rank"))).where(F.col("position") <= keep).drop("query")


def prefilter(hits: DataFrame, queries: DataFrame, limit: int, score: Callable = overlap_score) -> DataFrame:
    """The ``limit`` best hits by reranking, before compression."""
    return rerank(hits, queries, limit, score).where(F.col("position") <= limit)


def page_dedup(ranked: DataFrame, limit: int) -> DataFrame:
    """Walk each request's hits by position and skip those whose pages were all seen; stop at ``limit``.

    Only a request's few candidates are folded. Hits without page_ids always stay.
    """
    cols = [c for c in ranked.columns if c != "request_id"]
    rows = F.array_sort(F.collect_list(F.struct("position", F.col("page_ids").alias("pages"), F.col("chunk_id").alias("id"))))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        none = F.size(F.coalesce(x["pages"], F.array())) == 0
        take = (F.size(s["kept"]) < limit) & (none | (F.size(F.array_except(F.coalesce(x["pages"], F.array().cast("array<string>")), s["seen"])) > 0))
        return F.when(take, F.struct(F.when(none, s["seen"]).otherwise(F.array_union(s["seen"], x["pages"])).alias("seen"), F.concat(s["kept"], F.array(x["position"])).alias("kept"))).otherwise(s)

    kept = ranked.groupBy("request_id").agg(F.aggregate(rows, start, step, lambda s: s["kept"]).alias("_kept")).select("request_id", F.posexplode("_kept").alias("_n", "position"))
    return ranked.join(kept, ["request_id", "position"]).select("request_id", *cols, (F.col("_n") + 1).alias("final_rank"))


def page_enrich(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """page_content: the texts of a hit's pages in their order, by (doc_id, page_id), else by page_id alone (the page of the least doc_id).

    The page ids of the hits go to the pages before any text is gathered or moved, as long as there are not too many of them; beyond that they are joined with them.
    Pages are then gathered by document, with those of other documents that its hits name, and hits go to their document: a text is moved once for a
    document, not for each hit.
    """
    hits = stored(hits, "hits")
    refs = hits.select("doc_id", F.explode("page_ids").alias("page_id")).where("page_id is not null").distinct()
    wanted = refs.select("page_id").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= PAGES_SENT else wanted
    pages = stored(pages.join(wanted, "page_id", "left_semi").select("doc_id", "page_id", "content"), "hit-pages")
    own = pages.where("content is not null and doc_id is not null")
    missing = stored(refs.join(own.select("doc_id", "page_id"), ["doc_id", "page_id"], "left_anti"), "missing-pages")
    first = pages.select("doc_id", "page_id").join(missing.select("page_id").distinct(), "page_id", "left_semi").groupBy("page_id").agg(F.min("doc_id").alias("doc_id"))
    alone = stored(own.join(first, ["doc_id", "page_id"]).select("page_id", "content").dropDuplicates(["page_id"]), "pages-alone")
    texts = own.unionByName(missing.join(alone, "page_id")).groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.collect_list(F.struct("page_id", "content"))).alias("_pages"))
    found = F.flatten(F.transform("page_ids", lambda p: F.transform(F.filter("_pages", lambda x: x["page_id"] == p), lambda x: x["content"])))
    rows = hits.join(texts, hits["doc_id"].eqNullSafe(texts["_doc"]), "left")
    return rows.withColumn("page_content", F.nullif(F.array_join(found, "\n\n"), F.lit(""))).drop("_doc", "_pages")


def search(hits: DataFrame, pages: DataFrame, limit: int, queries: DataFrame | None = None, score: Callable | None = None) -> DataFrame:
    """Candidates to results: first of equal chunks, ranking (reranking if ``score`` is given), page dedup, page texts."""
    unique = dedup_chunks(hits)
    ranked = rerank(unique, queries, limit, score) if score else rank_by_score(unique)
    return page_enrich(page_dedup(ranked, limit), pages)
