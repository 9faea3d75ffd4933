"""A sweep over ingest configurations: the same documents chunked in several ways, searched for all cases at once, scored against gold documents."""

from __future__ import annotations

import time
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.blocks import by_blocks, cut
from corpusloom.sources.shared import stored

from . import chunk, evaluate, parse, vectors

#: Characters of passages that one automaton looks for.
PASSAGE_CHARS = 16 << 20
#: Hits that are sent to the chunks; more are joined with them.
HITS_SENT = 200_000


def gold_documents(docs: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, gold_doc): the least doc_id whose text holds the case's passage; cases without one have no row.

    docs: doc_id long, text. cases: case_id long, passage. Every text is read once for a whole block of passages; a task gives one
    row for each passage that it met.
    """

    def scan(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine, least = ahocorasick.Automaton(), {}
            for passage, ids in shared.value.items():
                machine.add_word(passage, ids)
            machine.make_automaton()
            for batch in batches if len(machine) else ():
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    for ids in {id(ids): ids for _, ids in machine.iter(text)}.values():
                        for case in ids:
                            least[case] = min(least.get(case, doc_id), doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int64()), pa.array(list(least.values()), pa.int64())], names=["case_id", "gold_doc"])

        return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "case_id long, gold_doc long")

    def load(part: DataFrame) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {}
        for r in part.toLocalIterator():
            found.setdefault(r.passage, []).append(r.case_id)
        return found

    cases = cases.where("passage != ''").select(F.col("case_id").cast("long").alias("case_id"), "passage")
    chars = cases.agg(F.sum(F.length("passage"))).first()[0] or 0
    return by_blocks(docs.sparkSession, cut(cases, "case_id", max(1, -(-chars // PASSAGE_CHARS))), load, scan).groupBy("case_id").agg(F.min("gold_doc").alias("gold_doc"))


def index_configurations(chunks: DataFrame, questions: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Chunks (config, chunk_id, tokens and any columns) with the terms of the questions (case_id long, tokens) counted, in one reading."""
    return vectors.counted_terms(chunks, vectors.bm25_query_weights(questions.select(F.col("case_id").alias("query_id"), "tokens")))


def search_index(index: list[tuple[DataFrame, DataFrame]], k: int, totals: DataFrame | None = None) -> DataFrame:
    """(config, case_id, chunk_id, score, rank): the k best chunks of each configuration for every question, weighted by that configuration's own term statistics. totals: config, n_chunks, if they are known."""
    found = None
    for counted, terms in index:
        counted = counted.select("config", "chunk_id", "n", "terms", "counts")
        weighted = vectors.query_idf(counted.select("config", F.col("terms").alias("tokens")), terms, "config", totals)
        rows = vectors.sparse_topk_scan(counted, weighted, k, group="config").withColumnRenamed("query_id", "case_id")
        found = rows if found is None else found.unionByName(rows)
    return found


def search_configurations(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """``search_index`` of chunks (config, chunk_id, tokens) for questions (case_id long, tokens)."""
    return search_index(index_configurations(chunks.select("config", "chunk_id", "tokens"), questions), k)


def token_recall(tokens: Column, contexts: Column) -> Column:
    """Share of a question's distinct tokens that its contexts (an array of token arrays) hold: a stand-in for a judge of answers."""
    asked = F.array_distinct(tokens)
    return F.coalesce(F.size(F.array_intersect(asked, F.flatten(contexts))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


def results(chunks: DataFrame, hits: DataFrame, cases: DataFrame, shown: int = 5) -> DataFrame:
    """A row for each configuration and case: gold_rank, correctness (of the best hit) and faithfulness (of the first ``shown``).

    chunks: config, chunk_id, tokens. hits: config, case_id, rank, chunk_id, doc_id. cases: case_id, gold_doc, tokens. The hits shown go to the chunks, as long
    as there are not too many; chunks are not moved.
    """
    ranked = evaluate.doc_rank(hits, cases.select("case_id", "gold_doc"))
    best = hits.where(F.col("rank") <= shown).select("config", "case_id", "rank", "chunk_id")
    best = F.broadcast(best) if best.count() <= HITS_SENT else best
    shown_ = chunks.select("config", "chunk_id", "tokens").join(best, ["config", "chunk_id"]).groupBy("config", "case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tokens"))), lambda x: x["tokens"]).alias("_c"))
    rows = ranked.join(shown_, ["config", "case_id"], "left").join(cases.select("case_id", "tokens"), "case_id")
    context = F.coalesce("_c", F.array().cast("array<array<string>>"))
    return rows.select("config", "case_id", "gold_doc", "gold_rank", token_recall(F.col("tokens"), F.slice(context, 1, 1)).alias("correctness"), token_recall(F.col("tokens"), context).alias("faithfulness"))


def invalid(config: chunk.ChunkConfig) -> str | None:
    """Why a configuration cannot be ingested."""
    if config.chunk_size <= 0:
        return "chunk size is not positive"
    return "overlap is not under the chunk size" if not 0 <= config.chunk_overlap < config.chunk_size else None


def run(docs: DataFrame, cases: DataFrame, configs: dict[str, chunk.ChunkConfig], k: int = 20) -> DataFrame:
    """Scorecard of the configurations: what they made, how they ranked the gold documents and how long it took; an error for those that failed.

    docs: doc_id, text. cases: case_id, passage (also the question). Configurations differ in size and overlap; blocks are made once, with the other settings of the first, and kept;
    chunks are cut from them in one pass that counts the terms of the cases, and those of the hits once more. ingest_sec is the wall-clock of chunking and counting for all configurations, split_sec a configuration's own task seconds, mean_latency_sec the search's wall-clock for each case and configuration.
    """
    spark = docs.sparkSession
    good = {name: c for name, c in configs.items() if not invalid(c)}
    known = spark.createDataFrame([(name, c.chunk_size, c.chunk_overlap, invalid(c)) for name, c in configs.items()], "config string, chunk_size int, chunk_overlap int, failed string")
    cases = cases.join(gold_documents(docs, cases), "case_id", "left").withColumn("tokens", vectors.bm25_tokens(F.col("passage")))
    cases = stored(cases.select(F.col("case_id").cast("long").alias("case_id"), "gold_doc", "tokens"), "sweep-cases")
    start = time.time()
    like = next(iter(good.values()), chunk.ChunkConfig())
    elements = stored(parse.plain_text_pages(docs), "sweep-elements")
    blocks = stored(chunk.merge_micro(chunk.breadcrumb(elements, like), like).select("doc_id", "block", "text"), "sweep-blocks")
    tokenised = lambda cut_, *more: cut_.select("config", "chunk_id", *more, vectors.bm25_tokens(F.col("page_content")).alias("tokens"))
    index = index_configurations(tokenised(chunk.split_configurations(blocks, good), F.length("page_content").alias("chars"), "split_sec"), cases)
    stats = stored(index[0][0].groupBy("config").agg(F.count("*").alias("n_chunks"), F.avg("chars").alias("mean_chars"), F.sum("split_sec").alias("split_sec")), "sweep-chunks")
    ingest_sec, start = time.time() - start, time.time()
    hits = stored(search_index(index, k, stats).withColumn("doc_id", F.substring_index("chunk_id", ":chunk:", 1).cast("long")), "sweep-hits")
    latency = (time.time() - start) / max(1, len(good) * cases.count())
    described = known.join(F.broadcast(stats), "config", "left").withColumn("ingest_sec", F.when(F.col("failed").isNull(), ingest_sec))  # a row for each configuration
    # the chunks of the hits alone are cut once more
    name = F.split("chunk_id", ":")
    places = hits.select(name[0].alias("doc_id"), name[2].cast("int").alias("block")).distinct()
    places = F.broadcast(places) if places.count() <= HITS_SENT else places
    near = chunk.split_configurations(blocks.join(places, ["doc_id", "block"], "left_semi"), good)
    scored = results(tokenised(near), hits, cases).withColumn("latency_sec", F.lit(latency))
    return evaluate.sweep_scorecard(described, scored).withColumn("error", F.coalesce("failed", "error")).drop("failed")
