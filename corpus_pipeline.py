"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secret scans, packing.

Each stage reads what the one before kept. All but the last return the columns of ``documents``; the last returns packed pieces.
Extra columns pass through under any name. ``STAGES`` names the stages in their order.

Odd rows: a row without doc_id cannot be told from others in any later stage or packed piece, so the first stage drops it. Of rows
that share a doc_id the first stage judges each by its own text and language, and the second keeps the first by the MD5 of its text, then by all its columns,
if the group's document is theirs. Null and empty texts fail the counting rules. Ties between near-duplicates go to the least doc_id. A table without ``n_chars``
gets none. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, packing, quality_rules, secret_scan, simhash
from corpusloom.llm.staging import materialize


def _only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Documents whose doc_id is listed, or with left_anti is not; ids hold one row per document at most."""
    ids = ids.select(F.col("doc_id").alias("listed_doc_id"))
    return docs.join(ids, docs["doc_id"] == ids["listed_doc_id"], how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counting rules or the perplexity bands reject go, as do rows without doc_id."""
    judged = quality_rules.quality_rules(docs.where("doc_id is not null"))
    rejected = materialize(judged.where("not kept").select(F.col("doc_id").alias("rejected_doc_id"), F.col("lang").alias("rejected_lang"), F.col("digest").alias("rejected_digest")).distinct(), "rejected")
    same = (docs["doc_id"] == rejected["rejected_doc_id"]) & (F.coalesce(docs["lang"], F.lit("")) == rejected["rejected_lang"])
    same &= F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))) == rejected["rejected_digest"]
    return docs.where(docs["doc_id"].isNotNull()).join(rejected, same, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least doc_id; of its repeated rows the first by text hash and columns."""
    found = materialize(simhash.near_duplicates(docs), "near-duplicates")
    by_id = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    by_id = materialize(by_id.where("doc_id != component_id or rows > 1"), "near-duplicate-ids")
    once = _only(docs, by_id, "left_anti")
    repeated = _only(docs, by_id.where("doc_id = component_id"))
    place = "row_of_doc_id"
    while place in {c.lower() for c in docs.columns}:
        place += "_"
    order = F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.to_json(F.struct(*(F.col(f"`{c}`").alias(str(k)) for k, c in enumerate(docs.columns))))
    first = repeated.withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col(place) == 1).drop(place)
    return once.unionByName(first)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars follows where a text changed."""
    sizes = [c for c in docs.columns if c.lower() == "n_chars"]
    if not sizes:
        return secret_scan.mask_column(docs)
    before = "n_chars_before"
    while before in {c.lower() for c in docs.columns}:
        before += "_"
    masked = secret_scan.mask_column(docs.withColumn(before, F.length("text")))
    size = F.when(F.length("text").eqNullSafe(F.col(before)), F.col(sizes[0])).otherwise(F.length("text")).cast(docs.schema[sizes[0]].dataType)
    return masked.select(*(size.alias(c) if c == sizes[0] else F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("decontamination", decontamination), ("secret_scan", secrets), ("packing", pack)]

#: SQL cannot express the perplexity model, SimHash components or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
