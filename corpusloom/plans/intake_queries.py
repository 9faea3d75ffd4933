"""Queries of intake, change detection and bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import bookkeeping, intake

from .projections import KB_DOCS, kb_docs
from .registry import query, table


@query("content_dedup", """
SELECT file_id, content_hash, first_value(file_id) OVER (PARTITION BY content_hash ORDER BY file_id) AS first_file,
       file_id = first_value(file_id) OVER (PARTITION BY content_hash ORDER BY file_id) AS is_first
FROM (SELECT doc_id AS file_id, sha256(text) AS content_hash FROM documents)""")
def content_dedup(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    return intake.content_dedup(files, ["file_id"])


UPSERT_ROLES = f"""WITH {KB_DOCS}, current_ AS (
  SELECT kb_id, name, arg_min(file_hash, doc_id) AS file_hash, arg_min(status, doc_id) AS status FROM kb_docs WHERE doc_id % 3 <> 0 GROUP BY ALL
), incoming AS (
  SELECT kb_id, name, CASE WHEN min(doc_id) % 2 = 0 THEN arg_min(file_hash, doc_id) ELSE sha256('v2' || min(doc_id)) END AS file_hash FROM kb_docs WHERE doc_id % 5 <> 1 GROUP BY ALL
)"""


def _upsert_roles(spark, sf_dir):
    docs = kb_docs(spark, sf_dir)
    current = docs.where("doc_id % 3 != 0").groupBy("kb_id", "name").agg(F.min_by("file_hash", "doc_id").alias("file_hash"), F.min_by("status", "doc_id").alias("status"))
    incoming = docs.where("doc_id % 5 != 1").groupBy("kb_id", "name").agg(F.min("doc_id").alias("d"), F.min_by("file_hash", "doc_id").alias("h"))
    changed = F.sha2(F.concat(F.lit("v2"), F.col("d").cast("string")), 256)
    return current, incoming.select("kb_id", "name", F.when(F.col("d") % 2 == 0, F.col("h")).otherwise(changed).alias("file_hash"))


@query("versioned_upsert", UPSERT_ROLES + """
SELECT kb_id, name, action, coalesce(new_hash, old_hash) AS file_hash,
       CASE WHEN action IN ('insert', 'overwrite', 'requeue') THEN 'QUEUED' ELSE old_status END AS status, CASE WHEN action = 'overwrite' THEN old_hash END AS cleanup_hash
FROM (SELECT *, CASE WHEN new_hash IS NULL THEN 'untouched' WHEN old_hash IS NULL THEN 'insert' WHEN old_hash <> new_hash THEN 'overwrite'
                     WHEN old_status = 'FAILED' THEN 'requeue' ELSE 'keep' END AS action
      FROM (SELECT kb_id, name, file_hash AS new_hash FROM incoming) FULL JOIN (SELECT kb_id, name, file_hash AS old_hash, status AS old_status FROM current_) USING (kb_id, name))""")
def versioned_upsert(spark, sf_dir):
    return intake.versioned_upsert(*_upsert_roles(spark, sf_dir))


@query("config_hash", """
SELECT doc_id, substr(sha256('{"chunk_overlap":' || (doc_id % 60) || ',"chunk_size":' || (doc_id % 7 * 100 + 200) || CASE WHEN doc_id % 4 = 0 THEN ',"separator":"' || lang || '"' ELSE '' END || '}'), 1, 16) AS config_hash
FROM documents""")
def config_hash(spark, sf_dir):
    size, overlap = F.col("doc_id") % 7 * 100 + 200, F.col("doc_id") % 60
    fields = {"chunk_size": size, "chunk_overlap": overlap, "separator": F.when(F.col("doc_id") % 4 == 0, F.col("lang"))}
    return table(spark, sf_dir, "documents").select("doc_id", intake.config_hash(fields).alias("config_hash"))


@query("resolve_embedding_config", """
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'm' || doc_id % 5 END AS model, lang = 'en' AS use_multivector, ['dense', 'sparse', 'hybrid'][doc_id % 3 + 1] AS retrieval_mode,
                  CASE WHEN doc_id % 7 = 0 THEN 'own' END AS sparse_model, CASE WHEN lang = 'de' THEN 'ko' ELSE 'en' END AS language FROM documents)
SELECT doc_id, retrieval_mode, use_multivector, language, coalesce(model, 'base') AS model, CASE WHEN use_multivector THEN 'vidore/colpali-v1.2-merged' END AS multivector_model,
       CASE WHEN retrieval_mode <> 'dense' THEN coalesce(sparse_model, CASE WHEN language = 'ko' THEN 'ko-kiwi-bm25' ELSE 'en-bm25' END) END AS sparse_model,
       CASE WHEN use_multivector AND retrieval_mode <> 'dense' THEN 'multi-vector search is dense only' END AS error FROM c""")
def resolve_embedding_config(spark, sf_dir):
    modes = F.array(F.lit("dense"), F.lit("sparse"), F.lit("hybrid"))
    configs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("m"), (F.col("doc_id") % 5).cast("string"))).alias("model"), (F.col("lang") == "en").alias("use_multivector"),
        F.lit(None).cast("string").alias("multivector_model"), modes[(F.col("doc_id") % 3).cast("int")].alias("retrieval_mode"), F.when(F.col("doc_id") % 7 == 0, "own").alias("sparse_model"),
        F.when(F.col("lang") == "de", "ko").otherwise("en").alias("language"),
    )
    return intake.resolve_embedding_config(configs, "base")


CONFIG_ROLES = """own AS (
  SELECT doc_id, kb_id, status, CASE WHEN doc_id % 3 = 0 THEN '{"provider":"own"}' END AS parsing_config, CASE WHEN doc_id % 4 = 0 THEN '{"chunk_size":300}' END AS chunking_config FROM kb_docs
), kbs AS (
  SELECT kb_id, '{"provider":"' || kb_id || '"}' AS parsing_config, '{"chunk_size":450}' AS chunking_config, CAST(substr(kb_id, 4) AS BIGINT) AS k FROM (SELECT DISTINCT kb_id FROM kb_docs)
)"""


def _config_roles(spark, sf_dir):
    docs = kb_docs(spark, sf_dir).select("doc_id", "kb_id", "status", F.when(F.col("doc_id") % 3 == 0, '{"provider":"own"}').alias("parsing_config"), F.when(F.col("doc_id") % 4 == 0, '{"chunk_size":300}').alias("chunking_config"))
    kbs = docs.select("kb_id").distinct().select("kb_id", F.concat(F.lit('{"provider":"'), "kb_id", F.lit('"}')).alias("parsing_config"), F.lit('{"chunk_size":450}').alias("chunking_config"), F.substring("kb_id", 4, 9).cast("long").alias("k"))
    return docs, kbs


@query("effective_config", f"""WITH {KB_DOCS}, {CONFIG_ROLES}
SELECT o.kb_id, doc_id, status, coalesce(o.parsing_config, k.parsing_config) AS parsing_config, coalesce(o.chunking_config, k.chunking_config) AS chunking_config FROM own o LEFT JOIN kbs k USING (kb_id)""")
def effective_config(spark, sf_dir):
    return intake.effective_config(*_config_roles(spark, sf_dir))


@query("cache_split", f"""WITH {KB_DOCS}, a AS (SELECT DISTINCT file_hash, CASE WHEN doc_id % 2 = 0 THEN kb_id END AS config_hash FROM kb_docs WHERE doc_id % 3 = 0)
SELECT doc_id, d.file_hash, d.config_hash, a.file_hash IS NOT NULL AS cached
FROM (SELECT doc_id, file_hash, CASE WHEN doc_id % 2 = 0 THEN kb_id END AS config_hash FROM kb_docs) d LEFT JOIN a ON a.file_hash = d.file_hash AND a.config_hash IS NOT DISTINCT FROM d.config_hash""")
def cache_split(spark, sf_dir):
    docs = kb_docs(spark, sf_dir).select("doc_id", "file_hash", F.when(F.col("doc_id") % 2 == 0, F.col("kb_id")).alias("config_hash"))
    return intake.cache_split(docs, docs.where("doc_id % 3 = 0"), ["file_hash", "config_hash"])


CHANGES = """changes AS (
  SELECT kb_id, k % 4 = 0 AS parsing_changed, k % 3 = 0 AS chunking_changed, k % 5 = 0 AS embedding_changed,
         CASE WHEN k % 4 = 0 THEN 'PENDING_REPARSE' WHEN k % 3 = 0 THEN 'PENDING_RECHUNK' WHEN k % 5 = 0 THEN 'PENDING_REEMBED' END AS target_status,
         parsing_config AS old_parsing, chunking_config AS old_chunking FROM kbs)"""


def _changes(kbs):
    old = kbs.select("kb_id", F.lit("a").alias("parsing_hash"), F.lit("a").alias("chunking_hash"), F.lit("a").alias("embedding_hash"))
    new = kbs.select("kb_id", *(F.when(F.col("k") % n == 0, "b").otherwise("a").alias(f"{p}_hash") for p, n in (("parsing", 4), ("chunking", 3), ("embedding", 5))))
    return intake.config_change_set(old, new)


@query("config_change_set", f"WITH {KB_DOCS}, {CONFIG_ROLES}, {CHANGES} SELECT kb_id, parsing_changed, chunking_changed, embedding_changed, target_status FROM changes")
def config_change_set(spark, sf_dir):
    return _changes(_config_roles(spark, sf_dir)[1])


@query("propagate_config", f"""WITH {KB_DOCS}, {CONFIG_ROLES}, {CHANGES}, j AS (SELECT doc_id, o.kb_id, status, o.parsing_config, o.chunking_config, c.* EXCLUDE (kb_id) FROM own o JOIN changes c USING (kb_id))
SELECT 'INHERITED_ONLY' AS mode, doc_id, kb_id, parsing_config, chunking_config,
       CASE WHEN embedding_changed OR (parsing_changed AND parsing_config IS NULL) OR (chunking_changed AND chunking_config IS NULL) THEN coalesce(target_status, status) ELSE status END AS status, NULL AS error FROM j
UNION ALL SELECT 'FORCE_ALL', doc_id, kb_id, NULL, NULL, coalesce(target_status, status), NULL FROM j
UNION ALL SELECT 'NEW_ONLY', doc_id, kb_id, CASE WHEN parsing_changed THEN coalesce(parsing_config, old_parsing) ELSE parsing_config END,
                 CASE WHEN chunking_changed THEN coalesce(chunking_config, old_chunking) ELSE chunking_config END, status, CASE WHEN embedding_changed THEN 'an embedding change applies to all documents' END FROM j""")
def propagate_config(spark, sf_dir):
    docs, kbs = _config_roles(spark, sf_dir)
    changes = _changes(kbs).join(kbs.select("kb_id", F.col("parsing_config").alias("old_parsing"), F.col("chunking_config").alias("old_chunking")), "kb_id")
    parts = [intake.propagate_config(docs, changes, mode).withColumn("mode", F.lit(mode)) for mode in ("INHERITED_ONLY", "FORCE_ALL", "NEW_ONLY")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("reprocess_mode", f"""WITH {KB_DOCS}, m AS (SELECT doc_id, status, CASE WHEN doc_id % 2 = 0 THEN 'p/' || doc_id END AS parsed_data_path,
  CASE status WHEN 'PENDING_REPARSE' THEN 'REPARSE' WHEN 'PENDING_RECHUNK' THEN 'RECHUNK' WHEN 'PENDING_REEMBED' THEN 'REEMBED' END AS mode FROM kb_docs)
SELECT *, CASE WHEN mode IS NULL THEN 'not pending' WHEN mode <> 'REPARSE' AND parsed_data_path IS NULL THEN 'no parsed artifact' END AS error FROM m""")
def reprocess_mode(spark, sf_dir):
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("p/"), F.col("doc_id").cast("string")))
    return intake.reprocess_mode(kb_docs(spark, sf_dir).select("doc_id", "status", path.alias("parsed_data_path")))


FILE_NAMES = "url || ['.html', '.PDF', '.docx', '.txt', ''][page_id % 5 + 1]"


def _file_name():
    endings = F.array(*map(F.lit, (".html", ".PDF", ".docx", ".txt", "")))
    return F.concat("url", endings[(F.col("page_id") % 5).cast("int")])


@query("route_parser", f"""
WITH f AS (SELECT page_id, {FILE_NAMES} AS name, CASE WHEN page_id % 4 = 0 THEN 'kb_parser' END AS provider FROM pages), e AS (SELECT *, lower(regexp_extract(name, '(\\.[^./\\\\]*)$', 1)) AS ext FROM f)
SELECT page_id, name, coalesce(CASE ext WHEN '.docx' THEN 'layout' END, provider, CASE WHEN ext IN ('.txt', '.md', '.markdown', '.html', '.htm') THEN 'native_text' END, 'default') AS parser FROM e""")
def route_parser(spark, sf_dir):
    provider = F.when(F.col("page_id") % 4 == 0, "kb_parser")
    return table(spark, sf_dir, "pages").select("page_id", _file_name().alias("name"), intake.route_parser(_file_name(), provider, "default", {".docx": "layout"}).alias("parser"))


MIMES = ("image/png", "audio/mpeg", "text/plain", "application/pdf", "application/MSWORD", "application/zip", "application/xhtml+xml")


@query("route_attachment", f"""
WITH m AS (SELECT doc_id, [{", ".join(f"'{m}'" for m in MIMES)}][doc_id % {len(MIMES)} + 1] AS mime FROM documents)
SELECT doc_id, mime, CASE WHEN lower(mime) LIKE 'image/%' THEN 'vision' WHEN lower(mime) LIKE 'audio/%' THEN 'audio'
  WHEN lower(mime) LIKE 'text/%' OR regexp_matches(lower(mime), 'pdf|word|document|html') THEN 'temp_kb' ELSE 'context' END AS purpose FROM m""")
def route_attachment(spark, sf_dir):
    mime = F.array(*map(F.lit, MIMES))[(F.col("doc_id") % len(MIMES)).cast("int")]
    return table(spark, sf_dir, "documents").select("doc_id", mime.alias("mime"), intake.route_attachment(mime).alias("purpose"))


KBS = "kbs AS (SELECT DISTINCT source AS kb_id, CASE WHEN source = 'src3' THEN 'DELETING' ELSE 'READY' END AS status FROM documents UNION ALL SELECT 'empty', 'RUNNING')"
RUNNING = ", ".join(f"'{s}'" for s in bookkeeping.RUNNING)


@query("kb_status", f"""WITH {KB_DOCS}, {KBS}, s AS (SELECT kb_id, status FROM kb_docs WHERE (kb_id NOT IN ('src1', 'src2') OR status = 'COMPLETED') AND (kb_id <> 'src4' OR status IN ('FAILED', 'COMPLETED')) AND (kb_id <> 'src5' OR status IN ('READY', 'COMPLETED'))),
g AS (SELECT kb_id, bool_or(status IN ({RUNNING})) AS running, bool_or(status = 'FAILED') AS failed, bool_and(status = 'COMPLETED') AS done FROM s GROUP BY kb_id)
SELECT kb_id, CASE WHEN status = 'DELETING' THEN 'DELETING' WHEN done IS NULL THEN 'READY' WHEN running THEN 'RUNNING' WHEN failed THEN 'FAILED' WHEN done THEN 'COMPLETED' ELSE 'READY' END AS status
FROM kbs LEFT JOIN g USING (kb_id)""")
def kb_status(spark, sf_dir):
    docs = kb_docs(spark, sf_dir).select("kb_id", "status")
    docs = docs.where("(kb_id not in ('src1', 'src2') or status = 'COMPLETED') and (kb_id != 'src4' or status in ('FAILED', 'COMPLETED')) and (kb_id != 'src5' or status in ('READY', 'COMPLETED'))")
    kbs = table(spark, sf_dir, "documents").select(F.col("source").alias("kb_id")).distinct().withColumn("status", F.when(F.col("kb_id") == "src3", "DELETING").otherwise("READY"))
    return bookkeeping.kb_status(kbs.unionByName(spark.createDataFrame([("empty", "RUNNING")], "kb_id string, status string")), docs)


@query("kb_stats", f"""WITH {KB_DOCS} SELECT kb_id, count(*) AS documents, CAST(count_if(status = 'COMPLETED') AS BIGINT) AS completed, CAST(count_if(status IN ('PARSING', 'CHUNKING', 'EMBEDDING')) AS BIGINT) AS processing,
  CAST(count_if(status = 'FAILED') AS BIGINT) AS failed, CAST(sum(n_chars) AS BIGINT) AS total_bytes FROM kb_docs GROUP BY kb_id""")
def kb_stats(spark, sf_dir):
    return bookkeeping.kb_stats(kb_docs(spark, sf_dir).select("kb_id", "status", F.to_json(F.struct(F.col("n_chars").alias("size_bytes"))).alias("info")))


QUEUE = "queue AS (SELECT o_orderkey AS doc_id, o_custkey AS kb_id, CASE WHEN o_orderkey % 3 = 0 THEN 'QUEUED' WHEN o_orderkey % 3 = 1 THEN 'PENDING_REPARSE' ELSE 'COMPLETED' END AS status, o_orderdate AS created_at FROM orders)"


def _queue(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 3 == 0, "QUEUED").when(F.col("o_orderkey") % 3 == 1, "PENDING_REPARSE").otherwise("COMPLETED")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("kb_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


@query("fair_queue", f"WITH {QUEUE} SELECT doc_id, kb_id, created_at, CAST(row_number() OVER (PARTITION BY kb_id ORDER BY created_at, doc_id) AS INT) AS turn FROM queue WHERE status <> 'COMPLETED'")
def fair_queue(spark, sf_dir):
    return bookkeeping.fair_queue(_queue(spark, sf_dir))


@query("next_in_queue", f"WITH {QUEUE} SELECT kb_id, first(doc_id ORDER BY created_at, doc_id) AS doc_id FROM queue WHERE status <> 'COMPLETED' GROUP BY kb_id")
def next_in_queue(spark, sf_dir):
    return bookkeeping.next_in_queue(_queue(spark, sf_dir))


@query("task_priority", """SELECT o_orderkey AS doc_id, CASE lower(split_part(o_orderpriority, '-', 2)) WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'lowest' THEN 1 ELSE 3 END AS priority FROM orders""")
def task_priority(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), bookkeeping.priority(F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)))).alias("priority"))


@query("stuck_docs", f"""WITH {KB_DOCS}, t AS (SELECT max(created_at) AS now FROM kb_docs)
SELECT doc_id, status AS old_status, 'QUEUED' AS status FROM kb_docs, t
WHERE (status = 'QUEUED' AND epoch(now) - epoch(created_at) > 300) OR (status IN ('PARSING', 'CHUNKING', 'EMBEDDING') AND epoch(now) - epoch(created_at) > 900) ORDER BY created_at, doc_id LIMIT 100""")
def stuck_docs(spark, sf_dir):
    docs = kb_docs(spark, sf_dir).withColumnRenamed("created_at", "updated_at")
    now = docs.agg(F.max("updated_at").alias("now"))
    return bookkeeping.stuck_docs(docs.crossJoin(F.broadcast(now)), F.col("now"))  # one row


TEMP_KBS = "temp AS (SELECT conv_id AS kb_id, conv_id % 3 <> 0 AS is_temp, TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL 1 MINUTE AS expires_at FROM (SELECT DISTINCT conv_id FROM conversations))"


def _temp_kbs(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("kb_id")).distinct().select("kb_id", (F.col("kb_id") % 3 != 0).alias("is_temp"), F.timestamp_seconds(F.lit(1704067200) + F.col("kb_id") * 60).alias("expires_at"))


@query("expired_kbs", f"WITH {TEMP_KBS} SELECT kb_id FROM temp WHERE is_temp AND expires_at <= TIMESTAMP '2024-01-01 01:00:00'")
def expired_kbs(spark, sf_dir):
    return bookkeeping.expired_kbs(_temp_kbs(spark, sf_dir), F.lit("2024-01-01 01:00:00").cast("timestamp")).select("kb_id")


@query("delete_kb", f"""WITH {TEMP_KBS} SELECT conv_id AS kb_id, turn FROM conversations
WHERE conv_id NOT IN (SELECT kb_id FROM temp WHERE is_temp AND expires_at <= TIMESTAMP '2024-01-01 01:00:00')""")
def delete_kb(spark, sf_dir):
    gone = bookkeeping.expired_kbs(_temp_kbs(spark, sf_dir), F.lit("2024-01-01 01:00:00").cast("timestamp"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("kb_id"), "turn")
    return bookkeeping.delete_cascade(gone, {"turns": turns})["turns"]


@query("orphan_files", f"""WITH {KB_DOCS} SELECT doc_id AS file_id FROM kb_docs f WHERE created_at < TIMESTAMP '2024-01-01 12:00:00' AND doc_id % 7 <> 0
  AND NOT EXISTS (SELECT 1 FROM kb_docs d WHERE d.file_hash = f.file_hash AND d.doc_id % 2 = 0)""")
def orphan_files(spark, sf_dir):
    docs = kb_docs(spark, sf_dir)
    files = docs.select(F.col("doc_id").alias("file_id"), "file_hash", "created_at")
    links = docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("file_id"))
    return bookkeeping.orphan_files(files, links, docs.where("doc_id % 2 = 0"), F.lit("2024-01-02 12:00:00").cast("timestamp")).select("file_id")


@query("list_documents", f"WITH {KB_DOCS} SELECT doc_id, kb_id, name, status FROM kb_docs WHERE status = 'COMPLETED' AND name ILIKE '%E1%' ORDER BY created_at, doc_id LIMIT 50 OFFSET 5")
def list_documents(spark, sf_dir):
    rows = bookkeeping.listing(kb_docs(spark, sf_dir), {"status": "COMPLETED"}, {"name": "E1"}, [F.col("created_at"), F.col("doc_id")], 50, 5)
    return rows.select("doc_id", "kb_id", "name", "status")


@query("list_pages", f"SELECT page_id, url FROM pages WHERE url ILIKE '%example.ORG%' ORDER BY page_id DESC LIMIT 20")
def list_pages(spark, sf_dir):
    return bookkeeping.listing(table(spark, sf_dir, "pages").select("page_id", "url"), like={"url": "example.ORG"}, order=[F.desc("page_id")], limit=20)


@query("list_kbs", f"WITH {KB_DOCS} SELECT kb_id, max(created_at) AS updated_at FROM kb_docs WHERE kb_id ILIKE '%C1%' GROUP BY kb_id ORDER BY updated_at, kb_id LIMIT 10")
def list_kbs(spark, sf_dir):
    kbs = kb_docs(spark, sf_dir).groupBy("kb_id").agg(F.max("created_at").alias("updated_at"))
    return bookkeeping.listing(kbs, like={"kb_id": "C1"}, order=[F.col("updated_at"), F.col("kb_id")], limit=10)


@query("list_history", "SELECT event_id, user_id, event_type, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 40")
def list_history(spark, sf_dir):
    return bookkeeping.listing(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), {"event_type": "click"}, order=[F.desc("ts"), F.desc("event_id")], limit=40)


BY_TIME = {"ts": False, "event_id": False}


def _clicks(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "user_id", "event_type", "ts")


@query("page_directory", "SELECT CAST(n // 40 AS INT) AS page, ts, event_id FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) - 1 AS n FROM events WHERE event_type = 'click') WHERE n % 40 = 0")
def page_directory(spark, sf_dir):
    return bookkeeping.page_directory(_clicks(spark, sf_dir), BY_TIME, 40)


@query("listing_page", "SELECT event_id, user_id, event_type, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 40 OFFSET 80")
def listing_page(spark, sf_dir):
    """The third page of the history by its keys, without the rows before it."""
    rows = _clicks(spark, sf_dir)
    return bookkeeping.listing_page(rows, bookkeeping.page_directory(rows, BY_TIME, 40), BY_TIME, 2)


@query("record_stage", f"""WITH {KB_DOCS} SELECT 'document' AS resource_type, CAST(doc_id AS VARCHAR) AS resource_id, kb_id AS group_id, 'parse' AS stage, CASE WHEN status = 'FAILED' THEN 'failure' ELSE 'success' END AS outcome,
  '{{"n_chars":' || n_chars || '}}' AS metrics, n_chars / 1000.0::DOUBLE AS duration_seconds, created_at FROM kb_docs""")
def record_stage(spark, sf_dir):
    outcome = F.when(F.col("status") == "FAILED", "failure").otherwise("success")
    return bookkeeping.record_stage(kb_docs(spark, sf_dir), "parse", outcome, F.to_json(F.struct("n_chars")), F.col("n_chars") / 1000.0, F.col("created_at"))
