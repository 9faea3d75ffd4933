"""Queries of evaluation, model hooks, sources and streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import model
from corpusloom.operators import evaluate, sweep, vectors
from corpusloom.operators.chunk import ChunkConfig
from corpusloom.sources import files
from corpusloom.sources.shared import shared_folder, stored
from corpusloom.streaming import jobs

from .projections import LINES, lines
from .registry import query, table
from .search_queries import TOKENS


def _line_rows(spark, sf_dir):
    return lines(spark, sf_dir).withColumnRenamed("content", "page_content")


@query("substantive_chunks", f"WITH {LINES} SELECT doc_id, ord AS \"order\" FROM lines_ WHERE length(content) >= 200 AND length(regexp_replace(content, '[^a-zA-Z0-9À-ÖØ-öø-ÿŒœ]', '', 'g')) >= 120")
def substantive_chunks(spark, sf_dir):
    return evaluate.substantive_chunks(_line_rows(spark, sf_dir)).select("doc_id", F.col("order").cast("long").alias("order"))


@query("even_sample", f"""WITH {LINES}, n AS (SELECT doc_id, ord, count(*) OVER (PARTITION BY doc_id) AS n FROM lines_) SELECT doc_id, ord AS "order" FROM n WHERE n <= 3 OR ord IN (0, floor(1 * (n / 3)), floor(2 * (n / 3)))""")
def even_sample(spark, sf_dir):
    return evaluate.even_sample(lines(spark, sf_dir), "doc_id", "order", 3).select("doc_id", F.col("order").cast("long").alias("order"))


@query("parse_model_json", """WITH w AS (SELECT item_id, length(text) AS n, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark)
SELECT item_id, array_to_string(w[1:5], ' ') AS question, array_to_string(w[6:9], ' ') AS answer FROM w WHERE n % 4 <> 0 AND len(w) > 5""")
def parse_model_json(spark, sf_dir):
    rows = model.model_map(table(spark, sf_dir, "benchmark"), "text", model.echo_json)
    return evaluate.parse_model_json(rows).select("item_id", "question", "answer")


#: Three ways of chunking that SQL can express too: the lines, seven lines at a time, whole documents.
GOLD = LINES + """, cut AS (
  SELECT 'line' AS config, doc_id, doc_id || ':' || ord AS chunk_id, content FROM lines_
  UNION ALL SELECT 'page', doc_id, doc_id || ':p' || (ord // 7), string_agg(content, ' ' ORDER BY ord) FROM lines_ GROUP BY doc_id, ord // 7
  UNION ALL SELECT 'document', doc_id, doc_id || ':d', text FROM documents
), chunks AS (SELECT config, doc_id, chunk_id, """ + TOKENS.format("content") + """ AS tokens FROM cut),
questions AS (SELECT item_id AS case_id, """ + TOKENS.format("text") + """ AS tokens FROM benchmark),
tf AS (SELECT config, chunk_id, len(tokens) AS n, unnest(tokens) AS term FROM chunks),
postings AS (SELECT config, chunk_id, n, term, count(*) * 2.5 / (count(*) + 1.5 * (0.25 + 0.75 * n / 300.0)) AS weight FROM tf GROUP BY config, chunk_id, n, term),
qterms AS (SELECT DISTINCT case_id, unnest(tokens) AS term FROM questions),
idf AS (SELECT p.config, term, ln((any_value(t.n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM postings p JOIN (SELECT config, count(*) AS n FROM chunks GROUP BY config) t USING (config) GROUP BY p.config, term),
scored AS (SELECT p.config, case_id, chunk_id, round(sum(weight * idf), 9) AS score, count(*) AS n_terms FROM postings p JOIN qterms USING (term) JOIN idf i ON i.config = p.config AND i.term = p.term GROUP BY ALL),
hits AS (SELECT h.*, c.doc_id, c.tokens FROM (SELECT *, row_number() OVER (PARTITION BY config, case_id ORDER BY score DESC, chunk_id) AS rank FROM scored) h JOIN chunks c USING (config, chunk_id) WHERE rank <= 20),
gold AS (SELECT item_id AS case_id, min(doc_id) AS gold_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '' GROUP BY item_id),
cases AS (SELECT case_id, gold_doc FROM questions LEFT JOIN gold USING (case_id)),
g AS (SELECT config, case_id, min(rank) AS gold_rank FROM hits JOIN cases USING (case_id) WHERE doc_id = gold_doc GROUP BY ALL),
ranked AS (SELECT config, case_id, gold_doc, gold_rank FROM (SELECT DISTINCT config FROM hits) CROSS JOIN cases LEFT JOIN g USING (config, case_id))"""


def _searched(spark, sf_dir):
    """Chunks of each configuration, the cases with their gold documents, and the 20 best hits. Chunks are cut within the rows of the documents; tokens are read off the lines, whose tokens are those of pages and documents too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    line = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    some = lambda at, tokens: F.struct(at.alias("at"), tokens.alias("tokens"))
    of = lambda config, found: F.transform(found, lambda x: F.struct(F.lit(config).alias("config"), F.concat(F.lit(":"), x["at"]).alias("at"), x["tokens"].alias("tokens")))
    starts = F.when(F.size("line") > 0, F.sequence(F.lit(0), F.size("line") - 1, F.lit(7))).otherwise(F.array().cast("array<int>"))
    pages = F.transform(starts, lambda i: some(F.concat(F.lit("p"), F.floor(i / 7).cast("string")), F.flatten(F.slice("line", i + 1, 7))))
    every = F.concat(of("line", F.transform("line", lambda x, i: some(i.cast("string"), x))), of("page", pages), of("document", F.array(some(F.lit("d"), F.flatten("line")))))
    chunks = docs.withColumn("line", F.transform(line, lambda x: vectors.bm25_tokens(x))).select("doc_id", F.explode(every).alias("c"))
    chunks = chunks.select("c.config", "doc_id", F.concat(F.col("doc_id").cast("string"), "c.at").alias("chunk_id"), "c.tokens")
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("passage"))
    cases = cases.join(sweep.gold_documents(docs, cases), "case_id", "left").select("case_id", "gold_doc", vectors.bm25_tokens(F.col("passage")).alias("tokens"))
    cases = stored(cases, "sweep-cases")
    hits = sweep.search_configurations(chunks, cases, 20).withColumn("doc_id", F.split("chunk_id", ":")[0].cast("long"))
    return chunks, cases, stored(hits, "sweep-hits")


def _ranked(spark, sf_dir):
    _, cases, hits = _searched(spark, sf_dir)
    return evaluate.doc_rank(hits, cases.select("case_id", "gold_doc"))


@query("doc_rank", f"WITH {GOLD} SELECT * FROM ranked")
def doc_rank(spark, sf_dir):
    return _ranked(spark, sf_dir)


HIT = ", ".join(f"avg(CASE WHEN gold_rank <= {k} THEN 1.0::DOUBLE ELSE 0 END) AS hit_{k}" for k in (1, 3, 5)) + ", avg(coalesce(1.0::DOUBLE / gold_rank, 0)) AS mrr"


@query("hit_at_k", f"WITH {GOLD} SELECT config, {HIT}, count(*) AS n_cases FROM ranked GROUP BY config")
def hit_at_k(spark, sf_dir):
    return evaluate.hit_at_k(_ranked(spark, sf_dir))


@query("judge_scores", "SELECT doc_id, CAST(least(1.0, (least(length(text), 6000) % 13) / 10) AS DOUBLE) AS score FROM documents")
def judge_scores(spark, sf_dir):
    """The judge reads each text as a context, up to its limit."""
    contexts = table(spark, sf_dir, "documents").select("doc_id", evaluate.judge_context(F.array("text")).alias("context"))
    return model.model_map(contexts, "context", model.echo_json).select("doc_id", evaluate.judge_score(F.col("reply")).alias("score"))


@query("sweep_scorecard", f"""WITH {GOLD}, recall AS (
  SELECT config, case_id, len(list_intersect(any_value(q.tokens), any_value(h.tokens) FILTER (rank = 1))) / any_value(len(list_distinct(q.tokens))) AS correctness,
         len(list_intersect(any_value(q.tokens), flatten(list(h.tokens)))) / any_value(len(list_distinct(q.tokens))) AS faithfulness
  FROM hits h JOIN questions q USING (case_id) WHERE rank <= 5 GROUP BY config, case_id
), a AS (SELECT config, {HIT}, avg(coalesce(correctness, 0)) AS correctness, avg(coalesce(faithfulness, 0)) AS faithfulness FROM ranked LEFT JOIN recall USING (config, case_id) GROUP BY config),
c AS (SELECT config, count(*) AS n_chunks FROM chunks GROUP BY config UNION ALL SELECT 'never ingested', 0)
SELECT *, CASE WHEN mrr IS NULL THEN 'no results' END AS error FROM c LEFT JOIN a USING (config)""")
def sweep_scorecard(spark, sf_dir):
    """Scorecard without the measured seconds; ``configuration_sweep`` has them."""
    chunks, cases, hits = _searched(spark, sf_dir)
    configs = chunks.groupBy("config").agg(F.count("*").alias("n_chunks")).unionByName(spark.createDataFrame([("never ingested", 0)], "config string, n_chunks long"))
    scored = sweep.results(chunks, hits, cases).withColumn("latency_sec", F.lit(0.0))
    return evaluate.sweep_scorecard(configs, scored).drop("mean_latency_sec")


@query("configuration_sweep")
def configuration_sweep(spark, sf_dir):
    """Documents as paragraphs, chunked in four sizes and searched for every benchmark text; one configuration cannot be ingested."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.regexp_replace("text", "\n", "\n\n").alias("passage"))
    sizes = {"small": (200, 20), "medium": (450, 50), "large": (900, 100), "no overlap": (450, 0), "broken": (100, 100)}
    return sweep.run(docs, cases, {name: ChunkConfig(chunk_size=size, chunk_overlap=overlap) for name, (size, overlap) in sizes.items()})


@query("metric_summary", "SELECT 'quality' AS name, avg(coalesce(quality, 0)) AS mean_score, count(*) AS n FROM labels WHERE doc_id % 5 <> 0 UNION ALL SELECT 'toxic', avg(CASE WHEN doc_id % 2 = 0 THEN toxic ELSE 0 END), count(*) FROM labels WHERE doc_id % 5 <> 0")
def metric_summary(spark, sf_dir):
    metric = lambda name, score: F.struct(F.lit(name).alias("name"), score.cast("double").alias("score"))
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 5 != 0).alias("success"), F.array(metric("quality", F.col("quality")), metric("toxic", F.when(F.col("doc_id") % 2 == 0, F.col("toxic")).when(F.col("doc_id") % 3 == 0, float("nan")))).alias("metrics"))
    return evaluate.metric_summary(rows)


@query("normalize_answers", "SELECT conv_id * 100 + turn AS case_id, CASE WHEN turn = 2 THEN 'ERROR: late' WHEN role = 'user' THEN text ELSE 'r' || text END AS answer, CASE WHEN turn = 2 THEN '' ELSE text END AS contexts, turn <> 2 AS success FROM conversations")
def normalize_answers(spark, sf_dir):
    user = F.col("role") == "user"
    ref = F.array(F.struct(F.lit(None).cast("string").alias("content"), F.col("text").alias("page_content")))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("case_id"), F.when(user, F.col("text")).alias("answer"), F.concat(F.lit("r"), "text").alias("response"), F.when(user, F.array("text")).alias("contexts"), ref.alias("references"), F.when(F.col("turn") == 2, "late").alias("error"))
    return evaluate.normalize_answers(rows).withColumn("contexts", F.array_join("contexts", "|"))


@query("model_map", "SELECT item_id, reverse(text) AS reply FROM benchmark")
def model_map(spark, sf_dir):
    return model.model_map(table(spark, sf_dir, "benchmark"), "text", lambda p: [x[::-1] for x in p]).select("item_id", "reply")


@query("decode_text", "SELECT doc_id, text FROM documents")
def decode_text(spark, sf_dir):
    raw = F.when((F.col("doc_id") % 2 == 1) & F.col("text").rlike(r"^[\x00-\xff]*$"), F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", files.decode_text(raw).alias("text"))


@query("read_files", """SELECT url || e AS name, CASE WHEN e NOT IN ('.html', '.txt') THEN 'extension' WHEN length(html) > 2500 THEN 'size' END AS reason FROM (SELECT url, html, ['.html', '.exe', '.txt'][page_id % 3 + 1] AS e FROM pages)""")
def read_files(spark, sf_dir):
    endings = F.array(F.lit(".html"), F.lit(".exe"), F.lit(".txt"))
    rows = table(spark, sf_dir, "pages").select(F.concat("url", endings[(F.col("page_id") % 3).cast("int")]).alias("name"), F.length("html").alias("length"))
    return files.judge_files(rows, 2500).select("name", "reason")


def _index(spark, sf_dir):
    """The vectors as an index under the current, the previous and a foreign configuration."""
    path = shared_folder(spark, "index")
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 10).alias("doc_id"), "embedding", F.col("label").alias("kb"))
    for cfg in ("current", "previous", "other"):
        files.write_index(points.repartitionByRange(8, "doc_id").withColumn("cfg", F.lit(cfg)), path)
    return path


@query("delete_doc_vectors", "SELECT c.cfg, vec_id AS chunk_id, vec_id // 10 AS doc_id FROM embeddings CROSS JOIN (VALUES ('current'), ('previous'), ('other')) AS c(cfg) WHERE cfg = 'other' OR vec_id // 10 % 3 <> 0")
def delete_doc_vectors(spark, sf_dir):
    """Documents leave the index under the current configuration and the one before it; files without a point of theirs stay."""
    path = _index(spark, sf_dir)
    gone = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("doc_id")).where("doc_id % 3 = 0")
    files.delete_points(spark, path, gone, ["doc_id"], ["current", "previous"])
    return spark.read.parquet(path).select("cfg", "chunk_id", "doc_id")


@query("wipe_kb", "SELECT c.cfg, vec_id AS chunk_id, label AS kb_id FROM embeddings CROSS JOIN (VALUES ('current'), ('previous'), ('other')) AS c(cfg) WHERE cfg = 'other' OR label <> 3")
def wipe_kb(spark, sf_dir):
    path = _index(spark, sf_dir)
    files.delete_points(spark, path, spark.range(3, 4).select(F.col("id").cast("int").alias("kb")), ["kb"], ["current", "previous"])
    return spark.read.parquet(path).select("cfg", "chunk_id", F.col("kb").cast("int").alias("kb_id"))


@query("stream_session_expiry", """WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id AS thread_id, min(ts) AS opened_at, max(ts) + INTERVAL 2 HOUR AS expires_at, count(*) AS uploads FROM s GROUP BY user_id, k""")
def session_expiry(spark, sf_dir):
    """The stream runs to the end of the table and gives all sessions, open ones too."""
    output = shared_folder(spark, "sessions")
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").select(F.col("user_id").alias("thread_id"), "ts")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(output)
    stream = jobs.session_expiry(rows).writeStream.outputMode("complete").option("checkpointLocation", shared_folder(spark, "sessions-state")).trigger(availableNow=True).foreachBatch(write).start()
    stream.awaitTermination()
    return spark.read.parquet(output)


@query("stream_stuck", """WITH n AS (SELECT user_id AS doc_id, ts, event_id, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, (SELECT max(ts) FROM events) AS now FROM events)
SELECT doc_id, ts AS silent_since, event_type AS status FROM n WHERE epoch(coalesce(nxt, now)) - epoch(ts) > CASE WHEN event_type = 'view' THEN 300 ELSE 900 END AND event_type IN ('view', 'click', 'error')""")
def stuck_stream(spark, sf_dir):
    """The stream itself: all beats first, in any order; then a closing row lifts the watermark past the table's latest time, and what has fallen due by then is reported.

    Watermarks count milliseconds; of silences that fall due in the last one, those up to the latest time are kept.
    """
    delay, output, closing, state = "40 days", shared_folder(spark, "stuck"), shared_folder(spark, "closing"), shared_folder(spark, "stuck-state")
    events = table(spark, sf_dir, "events")
    beat = [F.col("user_id").alias("doc_id"), F.col("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("status")]
    last = events.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("user_id"), (F.col("ts") + F.expr(f"interval {delay} 1 millisecond")).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit("").alias("event_type"))
    last.limit(0).write.parquet(closing)
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{output}/batch={number}")

    def run() -> None:
        rows = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]").select(beat)
        rows = rows.unionByName(spark.readStream.schema(last.schema).parquet(closing).select(beat))
        with jobs.timed_state(spark):
            found = jobs.stuck_stream(rows, delay, queued=("view",), active=("click", "error"))
            found.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()

    run()
    for _ in range(2):  # one lifts the watermark, which holds from the next batch on
        last.write.mode("append").parquet(closing)
        run()
    limit = F.make_dt_interval(secs=F.when(F.col("status") == "view", jobs.QUEUED_LIMIT).otherwise(jobs.ACTIVE_LIMIT))
    now = events.agg(F.max("ts").alias("now"))
    return spark.read.parquet(output).drop("batch").crossJoin(F.broadcast(now)).where(F.col("silent_since") + limit < F.col("now")).drop("now")  # one row


@query("stuck_events", f"""WITH n AS (SELECT user_id AS doc_id, ts, event_id, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, (SELECT max(ts) FROM events) AS now FROM events)
SELECT doc_id, ts AS silent_since, event_type AS status FROM n WHERE epoch(coalesce(nxt, now)) - epoch(ts) > CASE WHEN event_type = 'view' THEN 300 ELSE 900 END AND event_type IN ('view', 'click', 'error')""")
def stuck_events(spark, sf_dir):
    """The batch twin of stream_stuck."""
    beats = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return jobs.stuck_events(beats, queued=("view",), active=("click", "error"))
