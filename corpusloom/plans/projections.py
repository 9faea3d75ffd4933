"""Roles that the given tables play, each in Spark and as a SQL common table expression of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

STATUSES = ("READY", "QUEUED", "PARSING", "CHUNKING", "EMBEDDING", "FAILED", "COMPLETED", "PENDING_REPARSE", "PENDING_RECHUNK", "PENDING_REEMBED", "DELETING")


def lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """doc_id, order, content: the non-blank lines of every document; with ``more`` columns of it in front."""
    trimmed = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "documents").select(*more, "doc_id", F.posexplode(trimmed).alias("order", "content"))


LINES = """lines_ AS (
  SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS content,
         generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1) - 1 AS ord
  FROM documents)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element rows made of the lines: every tenth a heading, some list items, every tenth an ignored footer."""
    at = F.col("order") % 10
    kind = F.when(at == 0, "heading").when(at.isin(3, 4, 5), "list_item").when(at == 9, "page_footer").otherwise("paragraph")
    return lines(spark, sf_dir).select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_el_"), F.col("order").cast("string")).alias("element_id"), "order", kind.alias("type"), "content",
        F.when(kind == "heading", 1 + F.floor(F.col("order") / 10).cast("int") % 3).alias("level"), (kind == "page_footer").alias("ignored"),
        F.concat(F.lit("page_"), (1 + F.floor(F.col("order") / 7)).cast("string")).alias("page_id"),
    )


ELEMENTS = (
    LINES
    + """, elements_ AS (
  SELECT doc_id, doc_id || '_el_' || ord AS element_id, ord,
         CASE WHEN ord % 10 = 0 THEN 'heading' WHEN ord % 10 IN (3, 4, 5) THEN 'list_item' WHEN ord % 10 = 9 THEN 'page_footer' ELSE 'paragraph' END AS type,
         content, CASE WHEN ord % 10 = 0 THEN CAST(1 + (ord // 10) % 3 AS INT) END AS level, ord % 10 = 9 AS ignored, 'page_' || (1 + ord // 7) AS page_id
  FROM lines_)"""
)


def kb_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the rows of knowledge bases: kb_id is the source, the status follows doc_id."""
    names = F.array(*map(F.lit, STATUSES))
    created = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 97 % 86400)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("kb_id"), F.concat(F.lit("file"), (F.col("doc_id") % 400).cast("string"), F.lit(".txt")).alias("name"), names[(F.col("doc_id") % 11).cast("int")].alias("status"),
        F.sha2(F.col("text"), 256).alias("file_hash"), created.alias("created_at"), "n_chars", "text", "lang",
    )


KB_DOCS = (
    """kb_docs AS (
  SELECT doc_id, source AS kb_id, 'file' || (doc_id % 400) || '.txt' AS name, ["""
    + ", ".join(f"'{s}'" for s in STATUSES)
    + """][doc_id % 11 + 1] AS status, sha256(text) AS file_hash,
         TIMESTAMP '2024-01-01 00:00:00' + (doc_id * 97 % 86400) * INTERVAL 1 SECOND AS created_at, n_chars, text, lang
  FROM documents)"""
)
