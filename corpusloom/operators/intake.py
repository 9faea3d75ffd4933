"""Intake and change detection: which files are new, changed, cached or stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values
ALLOWED_EXTENSIONS = (".pdf", ".html", ".htm", ".md", ".docx", ".txt")
MAX_FILE_BYTES = 10 * 1024 * 1024
STALE_INFO_KEYS = ("parsing_config_hash", "chunking_config_hash", "chunking_summary_hash", "chunk_count", "original_file_path", "parsed_data_path", "chunked_data_path")
TEXT_EXTENSIONS = (".txt", ".md", ".markdown", ".html", ".htm")
CONFIG_HASH_LENGTH = 16


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))


def content_dedup(files: DataFrame, order: list[str]) -> DataFrame:
    """The first file of every content hash keeps it; ``reuses`` names that file for later ones.

    The first file is found by a partial aggregate over hashes alone; contents are not shuffled.
    """
    hashed = files.withColumn("content_hash", F.sha2(F.col("content"), 256)).drop("content")
    first = hashed.groupBy("content_hash").agg(F.min_by("file_id", F.struct(*order)).alias("first_file"))
    return hashed.join(first, "content_hash").withColumn("is_first", F.col("file_id") == F.col("first_file"))


def versioned_upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert of files by (kb_id, name): action, resulting hash and status, and the hash to clean up.

    current: kb_id, name, file_hash, status. incoming: kb_id, name, file_hash.
    New files are queued; unchanged files stay, failed ones being queued again; changed files are overwritten and queued, and
    their old artifacts become cleanup targets.
    """
    old = current.select("kb_id", "name", F.col("file_hash").alias("old_hash"), F.col("status").alias("old_status"))
    both = incoming.select("kb_id", "name", F.col("file_hash").alias("new_hash")).join(old, ["kb_id", "name"], "full")
    action = (
        F.when(F.col("new_hash").isNull(), "untouched").when(F.col("old_hash").isNull(), "insert").when(F.col("old_hash") != F.col("new_hash"), "overwrite")
        .when(F.col("old_status") == "FAILED", "requeue").otherwise("keep")
    )
    status = F.when(action.isin("insert", "overwrite", "requeue"), "QUEUED").otherwise(F.col("old_status"))
    return both.select("kb_id", "name", action.alias("action"), F.coalesce("new_hash", "old_hash").alias("file_hash"), status.alias("status"), F.when(action == "overwrite", F.col("old_hash")).alias("cleanup_hash"))


def drop_stale_info(info: Column) -> Column:
    """A document's info map without the keys that an overwrite invalidates."""
    return F.map_filter(info, lambda k, _: ~k.isin(*STALE_INFO_KEYS))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with sorted keys and no spaces; null fields are left out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def config_hash(fields: dict[str, Column]) -> Column:
    return F.substring(F.sha2(canonical_json(fields), 256), 1, CONFIG_HASH_LENGTH)


def resolve_embedding_config(configs: DataFrame, default_model: str) -> DataFrame:
    """Defaults of model, sparse_model (by language, for sparse and hybrid modes only) and multivector_model; ``error`` where
    multi-vector search is asked for in another mode than dense."""
    sparse = F.col("retrieval_mode").isin("sparse", "hybrid")
    return configs.withColumns({
        "model": F.coalesce("model", F.lit(default_model)),
        "multivector_model": F.when(F.col("use_multivector"), F.coalesce("multivector_model", F.lit("vidore/colpali-v1.2-merged"))),
        "sparse_model": F.when(sparse, F.coalesce(F.nullif("sparse_model", F.lit("")), F.when(F.col("language") == "ko", "ko-kiwi-bm25").otherwise("en-bm25"))),
        "error": F.when(F.col("use_multivector") & (F.col("retrieval_mode") != "dense"), "multi-vector search is dense only"),
    })


def effective_config(docs: DataFrame, kbs: DataFrame) -> DataFrame:
    """A document's own configs where set, else those of its knowledge base."""
    joined = docs.join(kbs.select("kb_id", F.col("parsing_config").alias("_p"), F.col("chunking_config").alias("_c")), "kb_id", "left")
    return joined.withColumns({"parsing_config": F.coalesce("parsing_config", "_p"), "chunking_config": F.coalesce("chunking_config", "_c")}).drop("_p", "_c")


def cache_split(docs: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """``cached`` tells whether an artifact with the same (null-safe) keys exists."""
    own = artifacts.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct().withColumn("_hit", F.lit(True))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return docs.join(own, on, "left").withColumn("cached", F.col("_hit").isNotNull()).drop("_hit", *(f"_{k}" for k in keys))


def config_change_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """kb_id, flags of the changed parts and the status that documents fall back to: reparse before rechunk before reembed."""
    parts = ("parsing", "chunking", "embedding")
    left = old.select("kb_id", *(F.col(f"{p}_hash").alias(f"_{p}") for p in parts))
    joined = new.join(left, "kb_id")
    flags = {f"{p}_changed": ~F.col(f"{p}_hash").eqNullSafe(F.col(f"_{p}")) for p in parts}
    target = F.when(flags["parsing_changed"], "PENDING_REPARSE").when(flags["chunking_changed"], "PENDING_RECHUNK").when(flags["embedding_changed"], "PENDING_REEMBED")
    return joined.select("kb_id", *(c.alias(k) for k, c in flags.items()), target.alias("target_status"))


def propagate_config(docs: DataFrame, changes: DataFrame, mode: str) -> DataFrame:
    """Effect of a knowledge base's config change on its documents.

    INHERITED_ONLY: documents without an override of a changed part (all, if the embedding changed) get the target status.
    FORCE_ALL: overrides are dropped and all get it. NEW_ONLY: defaults of before are frozen into empty overrides, statuses stay;
    an embedding change is an error then. changes: kb_id, flags, target_status, old_parsing, old_chunking.
    """
    joined = docs.join(changes, "kb_id")
    error = F.lit(None).cast("string")
    parsing, chunking, status = F.col("parsing_config"), F.col("chunking_config"), F.col("status")
    if mode == "FORCE_ALL":
        parsing = chunking = F.lit(None).cast("string")
        status = F.coalesce("target_status", "status")
    elif mode == "INHERITED_ONLY":
        inherits = F.col("embedding_changed") | (F.col("parsing_changed") & parsing.isNull()) | (F.col("chunking_changed") & chunking.isNull())
        status = F.when(inherits, F.coalesce("target_status", "status")).otherwise(status)
    elif mode == "NEW_ONLY":
        error = F.when(F.col("embedding_changed"), "an embedding change applies to all documents")
        parsing = F.when(F.col("parsing_changed"), F.coalesce(parsing, "old_parsing")).otherwise(parsing)
        chunking = F.when(F.col("chunking_changed"), F.coalesce(chunking, "old_chunking")).otherwise(chunking)
    else:
        raise ValueError(mode)
    return joined.select("doc_id", "kb_id", parsing.alias("parsing_config"), chunking.alias("chunking_config"), status.alias("status"), error.alias("error"))


def reprocess_mode(docs: DataFrame, requested: str = "AUTO") -> DataFrame:
    """mode and error of every document: AUTO follows a pending status; rechunking and reembedding need a parsed artifact."""
    auto = F.when(F.col("status") == "PENDING_REPARSE", "REPARSE").when(F.col("status") == "PENDING_RECHUNK", "RECHUNK").when(F.col("status") == "PENDING_REEMBED", "REEMBED")
    mode = auto if requested == "AUTO" else F.lit(requested)
    error = F.when(mode.isNull(), "not pending").when((mode != "REPARSE") & F.nullif("parsed_data_path", F.lit("")).isNull(), "no parsed artifact")
    return docs.withColumns({"mode": mode, "error": error})


def route_parser(name: Column, provider: Column, default: str, overrides: dict[str, str]) -> Column:
    """Parser of a file: the extension's override, the knowledge base's provider, or for text formats the native one, or ``default``."""
    ext = extension(name)
    by_extension = F.create_map(*(x for k, v in overrides.items() for x in (F.lit(k), F.lit(v))))[ext] if overrides else F.lit(None).cast("string")
    return F.coalesce(by_extension, provider, F.when(ext.isin(*TEXT_EXTENSIONS), "native_text"), F.lit(default))


def route_attachment(mime: Column) -> Column:
    m = F.lower(mime)
    text = m.startswith("text/") | m.contains("pdf") | m.contains("word") | m.contains("document") | m.contains("html")
    return F.when(m.startswith("image/"), "vision").when(m.startswith("audio/"), "audio").when(text, "temp_kb").otherwise("context")


def newest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
