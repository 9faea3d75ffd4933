"""Elements to chunks: breadcrumbs, merging of small blocks, splitting, navigation."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.split import split_keeping_images
from corpusloom.functions.tokens import token_count, token_truncate
from corpusloom.sources.shared import stored

from .parse import _open_headings, page_text, plain_text_pages


@dataclass(frozen=True)
class ChunkConfig:
    chunk_size: int = 450
    chunk_overlap: int = 50
    breadcrumb_depth: int = 3
    include_root: bool = True
    separator: str = " > "
    merge_max_chars: int = 300


MERGEABLE = ("list", "list_item", "caption", "footnote")
MIN_TOKENS, MIN_CHARS = 50, 100


def trim_breadcrumb(headings: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """The last ``breadcrumb_depth`` headings; the root takes the first place if it would be lost."""
    depth = config.breadcrumb_depth
    if not depth:
        return F.array().cast("array<string>")
    tail = F.slice(headings, -depth, depth)
    if not config.include_root:
        return F.when(F.size(headings) <= depth, headings).otherwise(tail)
    root = F.element_at(headings, 1)
    rooted = F.when(F.array_contains(tail, root), tail).otherwise(F.concat(F.array(root), F.slice(tail, 2, max(depth - 1, 1)) if depth > 1 else F.array().cast("array<string>")))
    return F.when(F.size(headings) <= depth, headings).otherwise(rooted)


def breadcrumb(elements: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Blocks: every visible element that is no heading, with its open headings and ``text`` = "a > b: content"."""
    stripped = F.regexp_replace(F.trim("content"), r"^#{1,6}\s+", "")
    rows, live = _open_headings(elements, stripped)
    headings = F.transform(F.filter(F.array(*live), lambda h: h.isNotNull()), lambda h: h["value"])
    rows = rows.where(~F.col("ignored") & (F.col("type") != "heading") & (F.trim("content") != "")).withColumn("breadcrumb", trim_breadcrumb(headings, config))
    content = F.trim("content")
    if "asset_uri" in elements.columns:  # images stand as Markdown
        alt = F.regexp_replace(content, r"([\[\]])", r"\\$1")
        content = F.when((F.col("type") == "image") & (F.coalesce("asset_uri", F.lit("")) != ""), F.concat(F.lit("!["), alt, F.lit("]("), "asset_uri", F.lit(")"))).otherwise(content)
    text = F.when(F.size("breadcrumb") > 0, F.concat(F.array_join("breadcrumb", config.separator), F.lit(": "), content)).otherwise(content)
    return rows.select("doc_id", "element_id", "order", "type", F.col("level").cast("int").alias("level"), "page_id", "breadcrumb", content.alias("raw_text"), text.alias("text"))


#: What Python and Unicode count as white space at the ends of a text.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def merge_micro(blocks: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Neighbouring small blocks of one kind run together.

    Both must be list items, lists, captions or footnotes with equal breadcrumb and level; the left one must end on the page the right one
    starts on, and the merged text must not pass ``merge_max_chars``. Neighbours that can never merge cut a document into runs; a run is
    folded once, for pages and sizes. One shuffle by document serves all of it.
    """
    space = F.lit(SPACE)
    by_doc = Window.partitionBy("doc_id").orderBy("order")
    small = F.col("type").isin(*MERGEABLE)
    like_before = small & F.lag(small).over(by_doc) & (F.col("breadcrumb") == F.lag("breadcrumb").over(by_doc)) & F.col("level").eqNullSafe(F.lag("level").over(by_doc))
    stripped = F.rtrim(F.ltrim("raw_text", space), space)
    rows = blocks.withColumns({"doc_id": F.col("doc_id").cast("string"), "order": F.col("order").cast("int")})
    rows = rows.withColumn("_new", (~F.coalesce(like_before, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(by_doc))
    member = F.struct("order", "element_id", "type", F.nullif("page_id", F.lit("")).alias("page"), "text", stripped.alias("strip"), F.rtrim("text", space).alias("rstrip"), F.length("raw_text").alias("raw"))
    runs = rows.groupBy("doc_id", "_run").agg(F.first("breadcrumb").alias("breadcrumb"), F.array_sort(F.collect_list(member)).alias("_m"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["rows"] > 0) & (s["page"].isNull() | x["page"].isNull() | (s["page"] == x["page"])) & (s["size"] + 1 + x["raw"] <= config.merge_max_chars)
        grown = s["bare"] + 1 + F.length(x["strip"])
        merged = F.struct(grown.alias("size"), F.when(x["strip"] == "", s["bare"]).otherwise(grown).alias("bare"), F.coalesce(x["page"], s["page"]).alias("page"), (s["rows"] + 1).alias("rows"), s["done"].alias("done"))
        done = F.when(s["rows"] > 0, F.concat(s["done"], F.array(s["rows"]))).otherwise(s["done"])
        return F.when(fits, merged).otherwise(F.struct(F.length(x["text"]).alias("size"), F.length(x["rstrip"]).alias("bare"), x["page"].alias("page"), F.lit(1).alias("rows"), done.alias("done")))

    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("bare"), F.lit(None).cast("string").alias("page"), F.lit(0).alias("rows"), F.array().cast("array<int>").alias("done"))
    lengths = F.when(F.size("_m") == 1, F.array(F.lit(1))).otherwise(F.aggregate("_m", start, step, lambda s: F.concat(s["done"], F.array(s["rows"]))))
    runs = runs.withColumn("_n", lengths)
    ends = F.transform("_n", lambda n, k: F.aggregate(F.slice("_n", 1, k + 1), F.lit(0), lambda t, x: t + x))
    groups = F.transform(F.arrays_zip(F.col("_n").alias("n"), ends.alias("end")), lambda g: F.slice("_m", g["end"] - g["n"] + 1, g["n"]))
    found = runs.select("doc_id", "_run", "breadcrumb", F.posexplode(F.when(F.size("_n") == 1, F.array("_m")).otherwise(groups)).alias("_g", "_m"))
    first = F.col("_m")[0]
    later = F.transform(F.slice("_m", F.lit(2), F.size("_m") - 1), lambda x: x["strip"])
    joined = F.concat(F.array_join(F.concat(F.array(first["rstrip"]), F.filter(later, lambda x: x != "")), "\n"), F.when(F.element_at(later, -1) == "", "\n").otherwise(""))
    several = F.size("_m") > 1
    pages = F.array_distinct(F.filter(F.transform("_m", lambda x: x["page"]), lambda p: p.isNotNull()))
    block = F.row_number().over(Window.partitionBy("doc_id").orderBy("_run", "_g")) - 1
    return found.select(
        "doc_id", block.alias("block"), F.when(several, joined).otherwise(first["text"]).alias("text"), F.when(several, "merged").otherwise(first["type"]).alias("type"), "breadcrumb",
        F.transform("_m", lambda x: x["element_id"]).alias("element_ids"), F.transform("_m", lambda x: x["order"]).alias("orders"), F.transform("_m", lambda x: x["type"]).alias("types"), pages.alias("page_ids"),
    )


def summary_prefix(docs: DataFrame, config: ChunkConfig = ChunkConfig(), tokens: bool = False) -> DataFrame:
    """doc_id, prefix and chunk budget from (doc_id, summary, lang): half a chunk at most goes to the summary."""
    half = config.chunk_size // 2
    summary = F.coalesce("summary", F.lit(""))
    cut = token_truncate(summary, F.col("lang"), half - 1) if tokens else F.substring(summary, 1, half)
    shown = F.when(F.length(cut) < F.length(summary), F.concat(cut, F.lit("..."))).otherwise(cut)
    prefix = F.when(summary == "", "").otherwise(F.concat(F.lit("[Document Summary: "), shown, F.lit("]\n\n")))
    used = token_count(prefix, F.col("lang")) if tokens else F.length(prefix)
    return docs.select("doc_id", prefix.alias("prefix"), F.when(prefix == "", config.chunk_size).otherwise(F.greatest(F.lit(MIN_TOKENS if tokens else MIN_CHARS), config.chunk_size - used)).cast("int").alias("budget"))


def semantic_chunk(elements: DataFrame, config: ChunkConfig = ChunkConfig(), prefixes: DataFrame | None = None, fallback: DataFrame | None = None) -> DataFrame:
    """Chunks of every document: breadcrumbs, merging, then splitting of what is over the budget.

    ``prefixes``: doc_id, prefix, budget. ``fallback``: doc_id, markdown of documents that may have no block. All steps are keyed by
    document, so one shuffle serves them.
    """
    blocks = merge_micro(breadcrumb(elements, config), config)
    if fallback is not None:
        empty = fallback.withColumn("doc_id", F.col("doc_id").cast("string")).join(blocks.select("doc_id").distinct(), "doc_id", "left_anti").where(F.trim("markdown") != "")
        none = F.array().cast("array<string>")
        blocks = blocks.unionByName(empty.select("doc_id", F.lit(0).alias("block"), F.trim("markdown").alias("text"), F.lit("unknown").alias("type"), none.alias("breadcrumb"), none.alias("element_ids"), F.array().cast("array<int>").alias("orders"), F.array(F.lit("unknown")).alias("types"), none.alias("page_ids")))
    if prefixes is not None:
        blocks = blocks.join(prefixes.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "left")
        prefix, budget = F.coalesce("prefix", F.lit("")), F.coalesce("budget", F.lit(config.chunk_size))
    else:
        prefix, budget = F.lit(""), F.lit(config.chunk_size)
    blocks = blocks.where(F.trim("text") != "").withColumns({"_budget": budget.cast("int"), "_prefix": prefix})
    blocks = _cut(blocks.repartition("doc_id").sortWithinPartitions("doc_id", "block"), config.chunk_overlap)
    rows = blocks.select("*", F.posexplode("_parts").alias("part_index", "_part")).withColumn("part_count", F.size("_parts"))
    order = F.col("_before") + F.col("part_index") + 1
    return rows.select(
        F.format_string("%s:chunk:%04d", "doc_id", order).alias("chunk_id"), "doc_id", order.alias("order"), F.concat("_prefix", "_part").alias("page_content"), "type", "breadcrumb",
        "element_ids", "orders", "types", "page_ids", "part_index", "part_count", (F.col("part_count") > 1).alias("is_split"),
    )


def plain_text_chunks(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(chunk_id, doc_id, order, page_content, page_ids): ``semantic_chunk`` of ``plain_text_pages``, in one pass over the documents and without moving a text.

    Paragraphs stand under no heading and never merge, so each is a block, and blocks leave the row of their document together and in order. Documents whose id
    stands in several rows, which are chunked as one, go the way of other elements.
    """
    named = docs.where("doc_id is not null")
    ident = F.xxhash64(F.col("doc_id").cast("string"))
    repeated = stored(named.groupBy(ident.alias("_id")).agg(F.count("*").alias("_rows")).where("_rows > 1").select("_id"), "repeated-documents")
    of, none = ident == F.col("_id"), repeated.isEmpty()
    blocks = plain_text_pages(named if none else named.join(repeated, of, "left_anti"))
    blocks = _cut(blocks.select("doc_id", "page_id", F.col("content").alias("text"), F.lit(config.chunk_size).alias("_budget")), config.chunk_overlap)
    rows = blocks.select("doc_id", "page_id", "_before", F.posexplode("_parts").alias("_k", "page_content")).withColumn("order", F.col("_before") + F.col("_k") + 1)
    rows = rows.select(F.format_string("%s:chunk:%04d", "doc_id", "order").alias("chunk_id"), "doc_id", "order", "page_content", F.array("page_id").alias("page_ids"))
    return rows if none else rows.unionByName(semantic_chunk(plain_text_pages(named.join(repeated, of, "left_semi")), config).select(rows.columns))


def _cut(blocks: DataFrame, overlap: int) -> DataFrame:
    """Blocks with ``_parts``, what their text is cut to where it is over ``_budget``, in place of the text, and ``_before``, the number of parts of the blocks before in their document.

    One Python pass over the blocks of a partition, a batch at a time. Blocks of a document lie together and in their order.
    """
    kept = [c for c in blocks.columns if c not in ("text", "_budget")]
    schema = blocks.select(kept).schema.add("_parts", T.ArrayType(T.StringType())).add("_before", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, count = None, 0
        for batch in batches:
            parts, before = [], []
            for name, text, size in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("_budget").to_pylist()):
                if name != doc:
                    doc, count = name, 0
                parts.append(split_keeping_images(text, size, overlap) if len(text) > size else [text.strip(" ")])
                before.append(count)
                count += len(parts[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(parts, pa.list_(pa.string())), pa.array(before, pa.int32())], names=schema.names)

    return blocks.mapInArrow(run, schema)


def split_configurations(blocks: DataFrame, configs: dict[str, ChunkConfig]) -> DataFrame:
    """Merged blocks cut under several sizes and overlaps in one pass over them, without a shuffle: config, chunk_id, doc_id, page_content, split_sec.

    A chunk is named by its block and part, which sort as the chunks do; split_sec are the task seconds that its block took, shared among its chunks.
    """

    @F.pandas_udf("parts array<string>, seconds double")
    def split(texts: pd.Series, sizes: pd.Series, overlaps: pd.Series) -> pd.DataFrame:
        rows = []
        for text, size, overlap in zip(texts, sizes, overlaps):
            start = time.perf_counter()
            parts = split_keeping_images(text, int(size), int(overlap)) if len(text) > size else [text.strip()]
            rows.append((parts, (time.perf_counter() - start) / max(1, len(parts))))
        return pd.DataFrame(rows, columns=["parts", "seconds"])

    each = F.array(*(F.struct(F.lit(name).alias("config"), F.lit(c.chunk_size).alias("size"), F.lit(c.chunk_overlap).alias("overlap")) for name, c in configs.items()))
    rows = blocks.where(F.trim("text") != "").select("doc_id", "block", "text", F.explode(each).alias("_c")).withColumn("_s", split("text", "_c.size", "_c.overlap"))
    rows = rows.select("_c.config", "doc_id", "block", F.col("_s.seconds").alias("split_sec"), F.posexplode("_s.parts").alias("_k", "page_content"))
    return rows.select("config", F.format_string("%s:chunk:%06d:%04d", "doc_id", "block", "_k").alias("chunk_id"), "doc_id", "page_content", "split_sec")


def chunk_navigation(chunks: DataFrame) -> DataFrame:
    """Neighbours of every chunk, its places on its pages and whether it is first or last on any of them."""
    by_doc = Window.partitionBy("doc_id").orderBy("order")
    linked = chunks.select("doc_id", "chunk_id", "order", F.lag("chunk_id").over(by_doc).alias("previous_chunk_id"), F.lead("chunk_id").over(by_doc).alias("next_chunk_id"))
    on_page = Window.partitionBy("doc_id", "page_id")
    places = chunks.select("doc_id", "chunk_id", "order", F.posexplode("page_ids").alias("k", "page_id"))
    places = places.withColumns({"index": F.row_number().over(on_page.orderBy("order")), "count": F.count("*").over(on_page)})
    each = F.struct("k", "page_id", "index", "count")
    flags = places.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list(each)).alias("page_positions"), F.bool_or(F.col("index") == 1).alias("first_on_page"), F.bool_or(F.col("index") == F.col("count")).alias("last_on_page"))
    off = F.lit(False)
    return linked.join(flags, ["doc_id", "chunk_id"], "left").withColumns({"first_on_page": F.coalesce("first_on_page", off), "last_on_page": F.coalesce("last_on_page", off)})


def chunk_metadata(chunks: DataFrame, pages: DataFrame | None = None, elements: DataFrame | None = None) -> DataFrame:
    """Range of source elements, distinct pages in first-seen order with their numbers, distinct source types and the elements' boxes.

    ``pages`` (doc_id, page_id, page_no) gives the page numbers; without it they are read off the ids. ``elements`` (doc_id, order, bbox) gives the boxes.
    """
    ids = F.array_distinct("page_ids")
    rows = chunks.select("doc_id", "chunk_id", "orders", F.array_min("orders").alias("element_order_start"), F.array_max("orders").alias("element_order_end"), ids.alias("page_ids"), F.array_distinct("types").alias("source_types"))
    if pages is None:
        rows = rows.withColumn("page_numbers", F.transform("page_ids", lambda p: F.regexp_extract(p, r"(\d+)$", 1).cast("int")))
    else:
        of_doc = pages.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("page_id", "page_no"))).alias("_numbers"))  # pages of one document
        known = F.transform("page_ids", lambda p: F.col("_numbers")[p])
        rows = rows.join(of_doc, "doc_id", "left").withColumn("page_numbers", F.array_distinct(F.filter(known, lambda n: n.isNotNull()))).drop("_numbers")
    if elements is not None:
        placed = chunks.select("doc_id", "chunk_id", F.posexplode("orders").alias("_k", "order")).join(elements.where("bbox is not null").select("doc_id", "order", "bbox"), ["doc_id", "order"])
        boxes = placed.groupBy("doc_id", "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "bbox"))), lambda x: x["bbox"]).alias("source_bboxes"))
        rows = rows.join(boxes, ["doc_id", "chunk_id"], "left").withColumn("source_bboxes", F.coalesce("source_bboxes", F.array().cast(boxes.schema["source_bboxes"].dataType)))
    return rows.drop("orders")


def page_chunk(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """One chunk per page with an image; the numbers in the ids count all pages."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")) - 1
    rows = pages.withColumn("order", order).where(F.coalesce("image_path", F.lit("")) != "").join(page_text(elements), ["doc_id", "page_id"], "left")
    return rows.select(F.format_string("%s:vchunk:%04d", F.col("doc_id").cast("string"), "order").alias("chunk_id"), "doc_id", "order", "page_id", "page_no", "image_path", F.coalesce("text", F.lit("")).alias("page_content"))


def chunk_stats(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Number and mean length of the chunks of every key: many short ones show over-fragmentation."""
    return chunks.groupBy(*keys).agg(F.count("*").alias("n_chunks"), F.avg(F.length("page_content")).alias("mean_chars"))
