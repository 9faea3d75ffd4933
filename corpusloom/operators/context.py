"""Retrieved chunks to prompts: references, context packing, compression, tree reduction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.ordered import ordered_fold
from corpusloom.functions.packing import greedy_groups
from corpusloom.functions.split import PLAIN_SEPARATORS, estimate_tokens, split_text

# Fixed values
MAX_CONTEXT_CHARS, MAX_CHUNKS, MAX_BATCH_TOKENS = 16_000, 10, 2048
HIGH_SCORE, HIGH_RATIO, LOW_RATIO = 0.8, 0.8, 0.3


def _filled(*columns: str) -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns))


def reference_rows(hits: DataFrame) -> DataFrame:
    """Numbered citations. hits: request_id, final_rank, source, filename, title, page, page_number, page_numbers."""
    page = F.coalesce(_filled("page", "page_number"), F.nullif(F.array_join("page_numbers", ", "), F.lit("")))
    return hits.withColumns({"index": F.row_number().over(Window.partitionBy("request_id").orderBy("final_rank")), "source": F.coalesce(_filled("source", "filename", "title"), F.lit("Unknown Source")), "page": page}).drop("filename", "title", "page_number", "page_numbers")


def format_section(index: Column) -> Column:
    """One chunk as a numbered context section."""
    bits = F.concat(F.when(F.col("source").isNotNull(), F.concat(F.lit(" source="), "source")).otherwise(""), F.when(F.col("page").isNotNull(), F.concat(F.lit(" page="), "page")).otherwise(""))
    rerank = F.when(F.col("rerank_score").isNotNull(), F.format_string(" rerank_score=%.4f", "rerank_score")).otherwise("")
    head = F.format_string("[%d] kb=%s doc=%s chunk=%s score=%.4f", index, F.col("kb_id"), F.col("doc_id"), F.col("chunk_id"), F.col("score"))
    return F.concat(head, rerank, bits, F.lit("\n"), F.coalesce("page_content", "content"))


def pack_sections(sections: list[str], limit: int, count_separator: bool) -> str:
    """Sections up to ``limit`` characters; one that does not fit is cut at its last full stop or line end, if late enough."""
    out, used = [], 0
    for s in sections:
        gap = 2 if count_separator and out else 0
        left = limit - used - gap
        if left <= 0:
            break
        if len(s) > left:
            s = s[:left]
            stop = max(s.rfind("."), s.rfind("\n"))
            s = (s[: stop + 1] if stop > int(left * 0.6) else s).rstrip()
            if count_separator and not s:
                continue
        out.append(s)
        used += len(s) + gap
    return "\n\n".join(out)


def format_context(hits: DataFrame, limit: int | None = MAX_CONTEXT_CHARS, count_separator: bool = False) -> DataFrame:
    """(request_id, context) of each request's hits in order (a few rows a request), packed on the JVM as pack_sections does; whole sections if ``limit`` is None."""
    numbered = hits.withColumn("_i", F.row_number().over(Window.partitionBy("request_id").orderBy("final_rank")))
    sections = numbered.select("request_id", "_i", format_section(F.col("_i")).alias("_s"))
    lists = sections.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"]).alias("_l"))
    shown = F.col("_l") if limit is None else _packed(F.col("_l"), limit, 2 if count_separator else 0)
    return lists.select("request_id", F.array_join(shown, "\n\n").alias("context"))


#: What str.rstrip takes off.
_SPACE_AT_END = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+\\z"


def _packed(sections: Column, limit: int, gap: int) -> Column:
    """The sections that fit, as pack_sections cuts them; ``gap`` is what a separator counts."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(True).alias("on"))

    def step(s: Column, x: Column) -> Column:
        between = F.when(F.size(s["out"]) > 0, gap).otherwise(0)
        left = F.lit(limit) - s["used"] - between
        head = x.substr(F.lit(1), left)
        last = F.reverse(head)
        # characters up to the last full stop or line end: all but those before the first of the reversed head
        after = F.array_min(F.filter(F.array(F.instr(last, "."), F.instr(last, "\n")), lambda at: at > 0))
        stop = left - after + 1
        cut = F.regexp_replace(F.when(stop - 1 > F.floor(left * 0.6), head.substr(F.lit(1), stop)).otherwise(head), _SPACE_AT_END, "")
        piece = F.when(F.length(x) > left, cut).otherwise(x)
        fits = s["on"] & (left > 0)
        keep = fits & ((F.length(x) <= left) | (F.length(cut) > 0)) if gap else fits
        kept = F.struct(F.concat(s["out"], F.array(piece)).alias("out"), (s["used"] + F.length(piece) + between).alias("used"), F.lit(True).alias("on"))
        return F.when(keep, kept).otherwise(F.struct(s["out"].alias("out"), s["used"].alias("used"), fits.alias("on")))

    return F.aggregate(sections, start, step, lambda s: s["out"])


def token_batches(hits: DataFrame, max_tokens: int = MAX_BATCH_TOKENS, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """(request_id, position, batch): the first ``max_chunks`` hits in greedy batches; a larger chunk is its own batch.

    hits: request_id, position, n_tokens.
    """

    rows = hits.where(F.col("position") <= max_chunks).select(F.col("request_id").cast("string").alias("request_id"), F.col("position").cast("int").alias("position"), F.col("n_tokens").cast("long").alias("n_tokens"))
    return greedy_groups(rows, "request_id", "position", "n_tokens", max_tokens, "batch").withColumn("batch", F.col("batch") - 1)


def compress_plan(batches: DataFrame) -> DataFrame:
    """Target ratio of every batch: gentler where a chunk scores high."""
    return batches.groupBy("request_id", "batch").agg(F.max("score").alias("max_score")).withColumn("target_ratio", F.when(F.col("max_score") >= HIGH_SCORE, HIGH_RATIO).otherwise(LOW_RATIO))


def compress_apply(batches: DataFrame, compress: Callable[[list[str], float], list[str] | str]) -> DataFrame:
    """Compressed contents of (request_id, batch, target_ratio, ids array, contents array).

    A reply of the same length maps one to one; any other is merged into the first chunk, which records the originals; on a failure
    the originals stay.
    """
    schema = "request_id string, batch int, chunk_id string, content string, original_chunks array<string>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                ids, texts = list(r.ids), list(r.contents)
                try:
                    reply = compress(texts, r.target_ratio)
                except Exception:  # noqa: BLE001  a model's failure of any kind keeps the originals
                    reply = texts
                if isinstance(reply, list) and len(reply) == len(ids):
                    rows += [(r.request_id, r.batch, i, t, None) for i, t in zip(ids, reply)]
                elif reply:
                    rows.append((r.request_id, r.batch, ids[0], reply if isinstance(reply, str) else "\n\n".join(reply), ids))
                else:
                    rows += [(r.request_id, r.batch, i, t, None) for i, t in zip(ids, texts)]
            yield pd.DataFrame(rows, columns=["request_id", "batch", "chunk_id", "content", "original_chunks"])

    return batches.select(F.col("request_id").cast("string").alias("request_id"), F.col("batch").cast("int").alias("batch"), "target_ratio", "ids", "contents").mapInPandas(run, schema)


def pack_budget(window: Column, prompt: Column, output: Column) -> Column:
    """Tokens left for text after prompt, output and a margin of 10 % and 100; null if none are left."""
    before = window - prompt - output
    left = before - (F.floor(before * 0.1) + 100)
    return F.when((before > 0) & (left > 0), left).cast("long")


def _within(text: str, budget: int) -> list[str]:
    """The text, or its parts, each within the budget of estimated tokens where separators allow."""
    if estimate_tokens(text) <= budget:
        return [text]
    parts = split_text(text, budget * 4, int(budget * 0.4), PLAIN_SEPARATORS)
    return [x for p in parts for x in ([p] if estimate_tokens(p) <= budget else split_text(p, int(budget * 2.8), 0, PLAIN_SEPARATORS))]


def repack_texts(texts: list[str], budget: int) -> list[str]:
    """Texts cut to the budget (in estimated tokens) and packed greedily with a blank line between."""
    packs: list[list[str]] = []
    room, gap = 0, estimate_tokens("\n\n")
    for part in (x for t in texts for x in _within(t, budget)):
        need = estimate_tokens(part)
        if packs and need + gap <= room:
            packs[-1].append(part)
            room -= need + gap
        else:
            packs.append([part])
            room = budget - need
    return ["\n\n".join(p) for p in packs]


def repack(texts: DataFrame, budget: int) -> DataFrame:
    """(doc_id, block, content) of (doc_id, order, content)."""

    def step(doc: str, contents: list[str]) -> list[tuple]:
        return [(doc, k, block) for k, block in enumerate(repack_texts(contents, budget))]

    rows = texts.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("order").cast("int").alias("order"), "content")
    return ordered_fold(rows, "doc_id", "order", "content", step, "doc_id string, block int, content string", {"block": "int32"})


def first_sentence(text: str) -> str:
    """The first sentence, at most 200 characters: a deterministic stand-in for a summarising model."""
    return text.split(". ")[0][:200]


def reduce_texts(texts: list[str], budget: int, summarise: Callable[[str], str], max_depth: int) -> tuple[str | None, int, str | None]:
    """The summary of one document's texts, the level it was reached at, and an error in place of a summary if a level does not shrink or ``max_depth`` is passed."""
    for depth in range(max_depth):
        blocks = repack_texts(texts, budget)
        texts = [summarise(b) for b in blocks]
        if len(blocks) == 1:
            return texts[0], depth, None
        if sum(map(len, texts)) >= sum(map(len, blocks)):
            return None, depth, "summaries do not shrink"
    return None, max_depth, "too many levels"


def tree_reduce(texts: DataFrame, budget: int, summarise: Callable[[str], str] = first_sentence, max_depth: int = 20) -> DataFrame:
    """(doc_id, summary, depth, error): blocks of every document summarised level by level until one is left.

    All levels of a document run where its texts are: one shuffle and one sort for any depth.
    """

    def step(doc: str, contents: list[str]) -> list[tuple]:
        return [(doc, *reduce_texts(contents, budget, summarise, max_depth))]

    rows = texts.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("order").cast("int").alias("order"), "content")
    return ordered_fold(rows, "doc_id", "order", "content", step, "doc_id string, summary string, depth int, error string", {"depth": "int32"})


def session_gate(attachments: DataFrame) -> DataFrame:
    """Per thread: its state, pending names, finished documents, first knowledge base and failed names.

    attachments: thread_id, position, status, filename, doc_id, kb_id.
    """
    name = F.coalesce(F.nullif("filename", F.lit("")), F.lit("Unknown file"))
    pick = lambda cond, value: F.transform(F.array_sort(F.filter(F.collect_list(F.when(cond & value.isNotNull(), F.struct("position", value.alias("v")))), lambda x: x.isNotNull())), lambda x: x["v"])
    status = F.col("status")
    grouped = attachments.groupBy("thread_id").agg(
        pick(status.isin("PENDING", "PROCESSING"), name).alias("pending"), pick(status == "COMPLETED", F.col("doc_id").cast("string")).alias("doc_ids"),
        F.min_by(F.when(status == "COMPLETED", F.col("kb_id")), F.when((status == "COMPLETED") & F.col("kb_id").isNotNull(), F.col("position"))).alias("kb_id"), pick(status == "FAILED", name).alias("failed"),
    )
    state = F.when(F.size("pending") > 0, "blocked").when(F.size("doc_ids") == 0, "error").otherwise("ready")
    return grouped.withColumn("state", state)
