"""Bookkeeping over documents, knowledge bases, files and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.ranking import numbered

# Fixed values
RUNNING = ("QUEUED", "PARSING", "CHUNKING", "EMBEDDING", "PENDING_REPARSE", "PENDING_RECHUNK", "PENDING_REEMBED", "DELETING")
PROCESSING = ("PARSING", "CHUNKING", "EMBEDDING")
PRIORITIES = {"critical": 5, "high": 4, "medium": 3, "low": 2, "lowest": 1}
QUEUED_MINUTES, ACTIVE_MINUTES, STUCK_LIMIT = 5, 15, 100
ORPHAN_HOURS = 24


def kb_status(kbs: DataFrame, docs: DataFrame) -> DataFrame:
    """Status of every knowledge base from the statuses of its documents. kbs: kb_id, status. docs: kb_id, status."""
    of = docs.groupBy("kb_id").agg(F.bool_or(F.col("status").isin(*RUNNING)).alias("running"), F.bool_or(F.col("status") == "FAILED").alias("failed"), F.bool_and(F.col("status") == "COMPLETED").alias("done"))
    status = (
        F.when(F.col("status") == "DELETING", "DELETING").when(F.col("done").isNull(), "READY").when(F.col("running"), "RUNNING")
        .when(F.col("failed"), "FAILED").when(F.col("done"), "COMPLETED").otherwise("READY")
    )
    return kbs.join(of, "kb_id", "left").select("kb_id", status.alias("status"))


def kb_stats(docs: DataFrame) -> DataFrame:
    """Counts and bytes by knowledge base. docs: kb_id, status, info (JSON with size_bytes)."""
    size = F.get_json_object("info", "$.size_bytes").cast("long")
    return docs.groupBy("kb_id").agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status").isin(*PROCESSING)).alias("processing"),
        F.count_if(F.col("status") == "FAILED").alias("failed"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"),
    )


def kb_overview(kbs: DataFrame) -> DataFrame:
    """One row over all knowledge bases: how many there are, how many can be searched, and the number of embedding models. kbs: status, model."""
    return kbs.agg(F.count("*").alias("kbs"), F.count_if(F.col("status").isin("READY", "COMPLETED")).alias("ready"), F.countDistinct(F.nullif("model", F.lit(""))).alias("models"))


def priority(name: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in PRIORITIES.items() for x in kv))[name], F.lit(3))


def fair_queue(docs: DataFrame) -> DataFrame:
    """``turn``: the round in which a waiting document is served, one of each knowledge base a round, oldest first.

    One base may own most documents; its rows are numbered over many partitions.
    """
    waiting = docs.where(F.col("status").isin("QUEUED", "PENDING_REPARSE")).select("doc_id", "kb_id", "created_at")
    return numbered(waiting, ["kb_id"], ["created_at", "doc_id"], "turn")


def next_in_queue(docs: DataFrame) -> DataFrame:
    """The oldest waiting document of each knowledge base, by a partial aggregate."""
    waiting = docs.where(F.col("status").isin("QUEUED", "PENDING_REPARSE"))
    return waiting.groupBy("kb_id").agg(F.min_by("doc_id", F.struct("created_at", "doc_id")).alias("doc_id"))


def stuck_docs(docs: DataFrame, now: Column, limit: int = STUCK_LIMIT) -> DataFrame:
    """Documents silent for too long, oldest first; they go back to QUEUED."""
    silent = (F.unix_timestamp(now) - F.unix_timestamp("updated_at")) / 60
    stuck = ((F.col("status") == "QUEUED") & (silent > QUEUED_MINUTES)) | (F.col("status").isin(*PROCESSING) & (silent > ACTIVE_MINUTES))
    return docs.where(stuck).orderBy("updated_at", "doc_id").limit(limit).select("doc_id", F.col("status").alias("old_status"), F.lit("QUEUED").alias("status"))


def expired_kbs(kbs: DataFrame, now: Column) -> DataFrame:
    return kbs.where(F.col("is_temp") & (F.col("expires_at") <= now))


def delete_cascade(targets: DataFrame, dependents: dict[str, DataFrame], key: str = "kb_id") -> dict[str, DataFrame]:
    """What remains of each dependent table when the targets go."""
    ids = targets.select(key).distinct()
    return {name: df.join(ids, key, "left_anti") for name, df in dependents.items()}


def orphan_files(files: DataFrame, session_links: DataFrame, docs: DataFrame, now: Column) -> DataFrame:
    """Files older than a day that no session binds and no document's hash refers to."""
    old = files.where(F.unix_timestamp(now) - F.unix_timestamp("created_at") > ORPHAN_HOURS * 3600)
    return old.join(session_links.select("file_id").distinct(), "file_id", "left_anti").join(docs.select("file_hash").distinct(), "file_hash", "left_anti")


def listing(rows: DataFrame, where: dict[str, object] | None = None, like: dict[str, str] | None = None, order: list[Column] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows by equality and case-insensitive containment, ordered and paged."""
    for name, value in (where or {}).items():
        rows = rows.where(F.col(name) == value)
    for name, part in (like or {}).items():
        rows = rows.where(F.col(name).ilike(f"%{part}%"))
    rows = rows.orderBy(*order) if order else rows
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit is not None else rows


def page_directory(rows: DataFrame, order: dict[str, bool], size: int) -> DataFrame:
    """(page, the order columns): the key each page of a listing begins with. ``order``: columns and whether they rise; together they are unique.

    Rows are counted by ranges of the order, so no task sorts them all; a directory has a row a page.
    """
    numbered_rows = numbered(rows.select(*order), [], [F.asc(c) if rises else F.desc(c) for c, rises in order.items()], "_n")
    return numbered_rows.where((F.col("_n") - 1) % size == 0).select(F.floor((F.col("_n") - 1) / size).cast("int").alias("page"), *order)


def _from(order: dict[str, bool], key: dict[str, object]) -> Column:
    """Rows at or behind a key."""
    names = list(order)
    found = F.lit(True)
    for k, name in reversed(list(enumerate(names))):
        value = F.lit(key[name])
        behind = F.col(name) > value if order[name] else F.col(name) < value
        found = behind | ((F.col(name) == value) & found)
    first, value = F.col(names[0]), F.lit(key[names[0]])
    return (first >= value if order[names[0]] else first <= value) & found  # a range of the first column, which a scan can use


def listing_page(rows: DataFrame, directory: DataFrame, order: dict[str, bool], page: int) -> DataFrame:
    """The rows of one page in their order: those from its key up to the next page's, so what comes before is not read where files or groups of rows have ranges."""
    keys = {r.page: r.asDict() for r in directory.where(F.col("page").isin(page, page + 1)).collect()}  # two rows
    if page not in keys:
        return rows.limit(0)
    rows = rows.where(_from(order, keys[page]))
    rows = rows.where(~_from(order, keys[page + 1])) if page + 1 in keys else rows
    return rows.orderBy(*(F.asc(c) if rises else F.desc(c) for c, rises in order.items()))


def record_stage(docs: DataFrame, stage: str, outcome: Column, metrics: Column, seconds: Column, at: Column) -> DataFrame:
    """One history row per document of a finished stage."""
    return docs.select(F.lit("document").alias("resource_type"), F.col("doc_id").cast("string").alias("resource_id"), F.col("kb_id").alias("group_id"), F.lit(stage).alias("stage"), outcome.alias("outcome"), metrics.alias("metrics"), seconds.alias("duration_seconds"), at.alias("created_at"))


def doc_chunks(chunks: DataFrame) -> DataFrame:
    """Texts of a document's chunks in order, and their number."""
    rows = F.array_sort(F.collect_list(F.struct("order", "page_content")))
    return chunks.groupBy("doc_id").agg(F.transform(rows, lambda x: x["page_content"]).alias("texts"), F.count("*").alias("n_chunks"))
