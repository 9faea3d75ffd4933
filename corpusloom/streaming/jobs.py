"""Structured Streaming jobs, and their batch twins on static tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpusloom.operators.query import synonym_expand
from corpusloom.sources.shared import stored

SESSION = "2 hours"
# Fixed values, in seconds
QUEUED_LIMIT, ACTIVE_LIMIT = 300, 900


def session_expiry(uploads: DataFrame, watermark: str | None = None) -> DataFrame:
    """Sessions of every thread: each upload keeps its knowledge base for two more hours.

    Works on a table and, with a watermark, on a stream. uploads: thread_id, ts.
    """
    rows = uploads.withWatermark("ts", watermark) if watermark else uploads
    found = rows.groupBy("thread_id", F.session_window("ts", SESSION).alias("w")).agg(F.count("*").alias("uploads"))
    return found.select("thread_id", F.col("w.start").alias("opened_at"), F.col("w.end").alias("expires_at"), "uploads")


def stuck_events(beats: DataFrame, queued: tuple[str, ...] = ("QUEUED",), active: tuple[str, ...] = ("PARSING", "CHUNKING", "EMBEDDING")) -> DataFrame:
    """Silences that make a document stuck, up to the table's latest time, by the microsecond. beats: doc_id, ts, seq, status."""
    now = beats.agg(F.max("ts").alias("now"))
    rows = beats.withColumn("next", F.lead("ts").over(Window.partitionBy("doc_id").orderBy("ts", "seq"))).crossJoin(F.broadcast(now))  # one row
    micros = lambda ts: F.unix_micros(ts.cast("timestamp"))
    limit = F.when(F.col("status").isin(*queued), QUEUED_LIMIT).when(F.col("status").isin(*active), ACTIVE_LIMIT)
    return rows.where(micros(F.coalesce("next", "now")) - micros(F.col("ts")) > limit * 1_000_000).select("doc_id", F.col("ts").alias("silent_since"), "status")


class _Silences(StatefulProcessor):
    """Beats of a document that cannot be judged yet. Those up to the watermark have all arrived; an event-time timer wakes the state when one falls due.

    What is judged leaves the state, so a document that is not heard of any more keeps none.
    """

    def __init__(self, queued: tuple[str, ...], active: tuple[str, ...]):
        self.limits = dict.fromkeys(active, ACTIVE_LIMIT) | dict.fromkeys(queued, QUEUED_LIMIT)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, seq long, status string")

    def _due(self, beat: tuple[int, int, str]) -> int:
        """Watermark (in milliseconds) from which a silence after the beat is too long; a beat without a limit is done with at once."""
        limit = self.limits.get(beat[2])
        return -(-beat[0] // 1000) if limit is None else (beat[0] + limit * 1_000_000) // 1000 + 1

    def _judge(self, key: tuple, beats: list[tuple[int, int, str]], watermark: int) -> Iterator[pd.DataFrame]:
        beats.sort()
        stuck, left = [], []
        for beat, after in zip(beats, [*beats[1:], None]):
            if after and after[0] <= watermark * 1000:
                if beat[2] in self.limits and after[0] - beat[0] > self.limits[beat[2]] * 1_000_000:
                    stuck.append(beat)
            elif self._due(beat) <= watermark:
                if beat[2] in self.limits:
                    stuck.append(beat)
            else:
                left.append(beat)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left:
            self.pending.put(left)
            self.handle.registerTimer(max(min(map(self._due, left)) - 1, watermark))  # a timer fires once the watermark has passed it
        else:
            self.pending.clear()
        if stuck:
            yield pd.DataFrame({"doc_id": key[0], "at": [b[0] for b in stuck], "status": [b[2] for b in stuck]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):  # closing rows; a filter would run before the watermark sees them
            return
        new = [r for f in rows for r in zip(f["at"].tolist(), f["seq"].tolist(), f["status"].tolist())]
        yield from self._judge(key, [*map(tuple, self.pending.get()), *new], max(timerValues.getCurrentWatermarkInMs(), 0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._judge(key, [*map(tuple, self.pending.get())], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stuck_stream(beats: DataFrame, watermark: str, queued: tuple[str, ...] = ("QUEUED",), active: tuple[str, ...] = ("PARSING", "CHUNKING", "EMBEDDING")) -> DataFrame:
    """stuck_events on a stream: each silence is reported once the watermark has passed its limit, in whatever order beats came within the watermark's delay.

    It needs a state store with timers: start it under ``timed_state``. Rows with a null doc_id only move the watermark.
    """
    rows = beats.withColumns({"at": F.unix_micros(F.col("ts").cast("timestamp")), "ts": F.col("ts").cast("timestamp")}).withWatermark("ts", watermark)
    kind = f"doc_id {beats.schema['doc_id'].dataType.simpleString()}, at long, status string"
    found = rows.groupBy("doc_id").transformWithStateInPandas(_Silences(queued, active), kind, "Append", "EventTime")
    return found.select("doc_id", F.timestamp_micros("at").cast(beats.schema["ts"].dataType).alias("silent_since"), "status")


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which timers need."""
    option, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(option, None)
    spark.conf.set(option, rocks)
    try:
        yield
    finally:
        spark.conf.unset(option) if before is None else spark.conf.set(option, before)


#: A stage of ingest: its name, and what makes its rows (doc_id, content_hash, ...) of the rows of the stage before.
Stage = tuple[str, Callable[[DataFrame], DataFrame]]
LEDGER = "doc_id string, content_hash string, stage string, run string"


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with doc_id and content_hash as one doc_id, so that two versions of a document are two documents to a stage."""
    return rows.withColumn("doc_id", F.concat_ws("@", "doc_id", "content_hash")).drop("content_hash")


def unkeyed(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id and content_hash again, from a column that begins with both."""
    return rows.withColumns({"content_hash": F.regexp_extract(key, "@([0-9a-f]+)", 1), "doc_id": F.regexp_extract(key, "^(.*?)@[0-9a-f]+", 1)})


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, content_hash, stage, run): what each stage has done so far."""
    return spark.read.schema(LEDGER).option("basePath", f"{root}/ledger").option("pathGlobFilter", "*.parquet").parquet(f"{root}/ledger")


def stage_rows(spark: SparkSession, root: str, name: str, run: str | None = None) -> DataFrame:
    """All rows that a stage has made, for every version of a document that it has seen, or those of one run."""
    rows = spark.read.option("mergeSchema", "true").option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/run={run}" if run else f"{root}/{name}")
    return rows.drop("run")


def newest(spark: SparkSession, root: str, name: str, versions: DataFrame) -> DataFrame:
    """A stage's rows of the newest version (doc_id, content_hash, ts) of each document."""
    last = versions.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max_by("content_hash", "ts").alias("content_hash"))
    return stage_rows(spark, root, name).join(last, ["doc_id", "content_hash"], "left_semi")


def ingest_batch(batch: DataFrame, run: str, stages: list[Stage], root: str) -> None:
    """Take a batch of files (doc_id, content_hash, ...) through all stages; ``run`` names it.

    A stage works on the versions of documents that the ledger does not have for it, reads what the stage before has stored, writes its rows
    to a folder of this run and then enters the versions in the ledger. So a run that stopped anywhere goes on with the first stage that it had not entered, a stopped
    write is replaced, and files that come again in later runs are not worked on and write nothing.
    Contents are moved only for versions that stand in the batch several times and where a stage has done a part of the batch before.
    """
    spark = batch.sparkSession
    keys = ["doc_id", "content_hash"]
    batch = batch.withColumns({"doc_id": F.col("doc_id").cast("string")}).where("doc_id is not null and content_hash is not null")
    found = stored(batch.groupBy(*keys).agg(F.count("*").alias("copies")), "ingest-files")
    wanted, repeated = found.select(*keys), found.where("copies > 1").select(*keys)
    n_wanted = wanted.count()
    if not repeated.isEmpty():
        batch = batch.join(repeated, keys, "left_anti").unionByName(batch.join(repeated, keys, "left_semi").dropDuplicates(keys))
    spark.createDataFrame([], LEDGER).write.mode("ignore").partitionBy("stage", "run").parquet(f"{root}/ledger")
    before = batch
    for name, step in stages:
        done = ledger(spark, root).where(F.col("stage") == name)
        own = done.where(F.col("run") == run)
        if own.isEmpty():
            todo = stored(wanted.join(done, keys, "left_anti"), f"ingest-{name}")
            n_todo = todo.count()
            if n_todo:
                made = step(before if n_todo == n_wanted else before.join(todo, keys, "left_semi"))
                made.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}/run={run}")
                todo.write.mode("overwrite").parquet(f"{root}/ledger/stage={name}/run={run}")
        entered = ledger(spark, root).where(F.col("stage") == name)
        if entered.isEmpty():
            before = before.limit(0)
        elif entered.where(F.col("run") == run).count() == n_wanted:  # the whole batch went through the stage in this run
            before = stage_rows(spark, root, name, run)
        else:
            before = stage_rows(spark, root, name).join(wanted, keys, "left_semi")


def stream_ingest(files: DataFrame, stages: list[Stage], root: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of new files through all stages (parse, chunk, embed), each version of a document once.

    files: doc_id, content_hash and what the first stage reads. Runs are named by the checkpoint's folder and the batch, so that a batch that is tried again
    is the same run.
    """
    name = checkpoint.rstrip("/").rpartition("/")[2]

    def write(batch: DataFrame, number: int) -> None:
        ingest_batch(batch, f"{name}-{number}", stages, root)

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def write_dictionary(spark: SparkSession, path: str, version: int, entries: list[tuple[str, list[str]]]) -> None:
    """A version of a synonym dictionary: its entries in their order. One without entries has a row that says so."""
    rows = [(version, k, keyword, synonyms) for k, (keyword, synonyms) in enumerate(entries)] or [(version, None, None, None)]
    spark.createDataFrame(rows, "version long, place int, keyword string, synonyms array<string>").coalesce(1).write.mode("append").parquet(path)


def newest_dictionary(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """The entries of the newest version; a curated list, which is sent to every task."""
    rows = spark.read.schema("version long, place int, keyword string, synonyms array<string>").parquet(path)
    last = rows.agg(F.max("version")).first()[0]
    return [(r.keyword, list(r.synonyms)) for r in rows.where((F.col("version") == last) & F.col("keyword").isNotNull()).orderBy("place").collect()]


def stream_synonyms(queries: DataFrame, dictionary: str, output: str, checkpoint: str) -> StreamingQuery:
    """Queries expanded with the version of the dictionary table that is the newest when their micro-batch runs."""

    def write(batch: DataFrame, number: int) -> None:
        synonym_expand(batch, newest_dictionary(batch.sparkSession, dictionary)).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return queries.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
