"""Streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import jobs

DATA = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def folder(spark, tmp_path):
    """Events in two files, in time order, and a late last row that moves the watermark past all of them."""
    events = spark.read.parquet(DATA).select(F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    middle = events.agg(F.percentile_approx("ts", 0.5).alias("m")).first().m
    late = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("doc_id"), (F.col("ts") + F.expr("interval 10 days")).alias("ts"), F.lit(-1).cast("long").alias("seq"), F.lit("none").alias("status"))
    path = str(tmp_path / "in")
    for k, part in enumerate((events.where(F.col("ts") <= middle), events.where(F.col("ts") > middle), late, late.withColumn("seq", F.lit(-2).cast("long")))):
        part.coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return events, path


def stream(spark, events, path):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def run(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()


def test_sessions(spark, folder, tmp_path):
    events, path = folder
    source = stream(spark, events, path).withColumnRenamed("doc_id", "thread_id")
    run(jobs.session_expiry(source, "30 days"), "sessions", tmp_path)
    batch = jobs.session_expiry(events.withColumnRenamed("doc_id", "thread_id"))
    got = {tuple(r) for r in spark.table("sessions").where("thread_id >= 0").collect()}
    assert got <= {tuple(r) for r in batch.collect()}
    run(jobs.session_expiry(source, "1 minute"), "all_sessions", tmp_path)
    assert spark.table("all_sessions").where("thread_id >= 0").count() > 0


def test_stuck_timer(spark, folder, tmp_path):
    """Timers report what the batch twin finds once the watermark has passed; under a long watermark nothing is due yet."""
    events, path = folder
    with jobs.timed_state(spark):
        run(jobs.stuck_stream(stream(spark, events, path), "40 days", ("view",), ("click", "error")), "stuck", tmp_path)
        assert spark.table("stuck").count() == 0
        run(jobs.stuck_stream(stream(spark, events, path), "1 minute", ("view",), ("click", "error")), "stuck_now", tmp_path)
    now = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("doc_id"), (F.col("ts") + F.expr("interval 10 days")).alias("ts"), F.lit(-1).cast("long").alias("seq"), F.lit("none").alias("status"))
    batch = sorted(map(tuple, jobs.stuck_events(events.unionByName(now), ("view",), ("click", "error")).collect()))
    assert sorted(map(tuple, spark.table("stuck_now").collect())) == batch


def test_stuck_beats_in_any_order(spark, tmp_path):
    """A beat that comes late but within the delay ends the silence that it falls into."""
    schema = "doc_id long, ts timestamp, seq long, status string"
    at = lambda s: f"timestamp '2024-01-01 00:00:00' + interval {s} seconds"
    batches = [[(1, 0, "QUEUED"), (1, 700, "PARSING"), (2, 0, "PARSING")], [(1, 250, "QUEUED"), (2, 901, "READY")], [(3, 5000, "READY")], [(None, 20_000, "READY")], [(None, 20_001, "READY")]]
    for k, rows in enumerate(batches):
        frame = spark.sql(" union all ".join(f"select cast({'null' if d is None else d} as long) doc_id, {at(s)} ts, {s}L seq, '{x}' status" for d, s, x in rows))
        frame.select("doc_id", "ts", "seq", "status").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    with jobs.timed_state(spark):
        run(jobs.stuck_stream(source, "1000 seconds"), "any_order", tmp_path)
    got = sorted((r.doc_id, r.silent_since.minute * 60 + r.silent_since.second, r.status) for r in spark.table("any_order").collect())
    assert got == [(1, 250, "QUEUED"), (1, 700, "PARSING"), (2, 0, "PARSING")]


def test_stuck_by_the_microsecond(spark, tmp_path):
    """A silence is too long from the first microsecond beyond its limit, also where whole seconds or milliseconds do not tell."""
    at = lambda us: f"timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {us / 1e6:.6f})"
    limit, last = 300_000_000, 5_000_000_000
    rows = [(1, 100, "QUEUED"), (1, 100 + limit, "READY"), (2, 100, "QUEUED"), (2, 101 + limit, "READY"), (3, 300_000, "QUEUED"), (3, 800_000 + limit, "READY")]
    rows += [(4, last + 400 - limit, "QUEUED"), (5, last + 399 - limit, "QUEUED"), (6, last + 401 - limit, "QUEUED"), (7, last + 400, "READY")]
    beats = spark.sql(" union all ".join(f"select {d}L doc_id, {at(us)} ts, {d}L seq, '{x}' status" for d, us, x in rows))
    assert sorted(r.doc_id for r in jobs.stuck_events(beats).collect()) == [2, 3, 5]
    for k, frame in enumerate([beats, *(spark.sql(f"select cast(null as long) doc_id, {at(last + 1_000_000)} ts, -1L seq, 'READY' status") for _ in range(2))]):
        frame.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema("doc_id long, ts timestamp, seq long, status string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    with jobs.timed_state(spark):
        run(jobs.stuck_stream(source, "1000 milliseconds"), "by_the_microsecond", tmp_path)
    # the watermark stands at ``last``: documents 4 to 6 fall due 399 to 401 microseconds later
    assert sorted(r.doc_id for r in spark.table("by_the_microsecond").collect()) == [2, 3]


def test_ingest_ledger(spark, tmp_path):
    """A stream that dies between stages goes on where it stopped; replays in later batches write nothing; a changed document is taken again."""
    schema, root, folder = "doc_id long, content_hash string, text string", str(tmp_path / "root"), str(tmp_path / "in")
    spark.createDataFrame([(1, "a1", "x y"), (1, "a1", "x y"), (2, "b2", "z"), (None, "c3", "lost")], schema).coalesce(1).write.parquet(f"{folder}/0")
    calls, broken = [], [True]

    def stages():
        def words(rows):
            calls.append(("words", sorted(r.doc_id for r in rows.select("doc_id").collect())))
            return rows.select("doc_id", "content_hash", F.explode(F.split("text", " ")).alias("word"))

        def upper(rows):
            calls.append(("upper", sorted({r.doc_id for r in rows.select("doc_id").collect()})))
            if broken[0]:
                raise RuntimeError("killed between stages")
            return rows.withColumn("word", F.upper("word"))

        return [("words", words), ("upper", upper)]

    def stream(checkpoint):
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
        jobs.stream_ingest(source, stages(), root, str(tmp_path / checkpoint)).awaitTermination()

    with pytest.raises(Exception, match="killed between stages"):
        stream("state")
    assert calls == [("words", ["1", "2"]), ("upper", ["1", "2"])]
    broken[0] = False
    stream("state")  # the same batch again: the first stage is past
    assert calls[2:] == [("upper", ["1", "2"])]
    words = lambda: sorted((r.doc_id, r.content_hash, r.word) for r in jobs.stage_rows(spark, root, "upper").collect())
    assert words() == [("1", "a1", "X"), ("1", "a1", "Y"), ("2", "b2", "Z")]
    spark.createDataFrame([(2, "b2", "z"), (1, "d4", "new"), (3, "e5", "w")], schema).coalesce(1).write.parquet(f"{folder}/1")
    stream("state")  # a later batch: one replay, one new version, one new document
    stream("other state")  # every file once more, in a stream of its own
    assert calls[3:] == [("words", ["1", "3"]), ("upper", ["1", "3"])]
    assert words() == [("1", "a1", "X"), ("1", "a1", "Y"), ("1", "d4", "NEW"), ("2", "b2", "Z"), ("3", "e5", "W")]
    versions = spark.createDataFrame([(1, "a1", 1), (1, "d4", 2), (2, "b2", 1), (3, "e5", 2)], "doc_id long, content_hash string, ts int")
    assert sorted(r.word for r in jobs.newest(spark, root, "upper", versions).collect()) == ["NEW", "W", "Z"]
    done = sorted((r.doc_id, r.content_hash, r.stage) for r in jobs.ledger(spark, root).collect())
    assert done == sorted((d, h, s) for d, h in [("1", "a1"), ("1", "d4"), ("2", "b2"), ("3", "e5")] for s in ("words", "upper"))


def test_ingest_moves_no_content(spark, tmp_path):
    """A batch of new versions goes through its stages without a join or an aggregate over contents; a repeated version is still taken once."""
    rows = lambda *ids: spark.createDataFrame([(d, f"h{d}", f"text {d}") for d in ids], "doc_id long, content_hash string, text string")
    plans = []

    def step(given):
        plans.append(given._jdf.queryExecution().optimizedPlan().toString())
        return given

    jobs.ingest_batch(rows(1, 2, 3), "a", [("first", step), ("second", step)], str(tmp_path / "root"))
    assert len(plans) == 2 and not any(word in plan for plan in plans for word in ("Join", "Aggregate"))
    jobs.ingest_batch(rows(3, 4, 4), "b", [("first", step), ("second", step)], str(tmp_path / "root"))
    assert sorted(r.text for r in jobs.stage_rows(spark, str(tmp_path / "root"), "second").collect()) == ["text 1", "text 2", "text 3", "text 4"]


def test_synonym_stream(spark, tmp_path):
    """A version that is written in mid-stream counts from the next batch on; an empty one expands nothing."""
    path, words = str(tmp_path / "in"), str(tmp_path / "words")
    expanded = []
    for version, entries in ((3, [("key", ["word"])]), (1, [("key", ["stale"])]), (4, []), (10, [("old", ["aged"]), ("key", ["note", "tone"])])):
        jobs.write_dictionary(spark, words, version, entries)
        spark.createDataFrame([("old key",)], "query string").coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema("query string").parquet(path)
        jobs.stream_synonyms(source, words, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        expanded.append({r.batch: r.expanded for r in spark.read.parquet(str(tmp_path / "out")).collect()})
    assert expanded[-1] == {0: "old key (word)", 1: "old key (word)", 2: "old key", 3: "old (aged) key (note, tone)"}
