"""Grace hash deduplication: documents with equal content are found by comparing complete contents in open-addressing tables.

1. A scan's tasks enter the contents of their rows into a table of ``TABLE_BYTES``; when it is full, or names ``ROWS`` rows, its records are spilled
   and a new one begins. A record is one distinct content of one table with its count and its first document; its other rows only name it. So a
   task spills a content of which it has thousands of copies once.
2. Records are partitioned by their hash, into so many buckets that one should fit a table. Each bucket fills a table of its own. A content
   that finds no room is spilled with all its later copies, and these records are partitioned again by another digit of the hash, until nothing is spilled.
   A table takes one content at least, so this ends.
3. Each row takes the result of its record by a join of numbers; contents are not moved again.

A content whose records come from more than ``HOT`` tables would still meet in one bucket. Its records are dealt by salt first and merged in
each share, until few are left. Counts of records by hash find such contents.

Spill files are Parquet tables in the folder that all executors share, so a lost executor costs no earlier step and the numbers of rows, which name
records, stay as they were written. Contents are equal when all their bytes are: hashes only choose buckets and slots.

Contents are texts with each run of white space replaced by one space; null counts as empty. Of equal texts the row with the least doc_id
stays, a null doc_id last; of repeated rows with that doc_id one stays, whichever number it was given. A text of any length is held whole, once in a table.
An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import materialize
from .text import blocks, record_batch

#: Bytes of content that one table holds; a longer content has a table to itself.
TABLE_BYTES = 64 << 20
#: Records of one content that may meet in one bucket.
HOT = 4096
#: Rows that a scan's task keeps beside its table.
ROWS = 500_000
#: Rows of a task that one batch of its result holds.
BATCH = 10_000

_MARKS = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"     ")
_RUNS = re.compile(rb"  +")

#: A row of a scan's task: its own number, the record it belongs to, and for records what their table knows about them.
_RECORD = [("record", pa.int64()), ("hash", pa.int64()), ("content", pa.binary()), ("copies", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("sha256", pa.string())]
SPILL = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), *_RECORD])
_SPILL_SQL = "doc_id long, row long, record long, hash long, content binary, copies long, keep_id long, keep_row long, sha256 string"
#: A record after a bucket's table has seen it: what it was merged into, or its content again if it found no room.
MERGED = pa.schema([*_RECORD, ("into", pa.int64())])
_MERGED_SQL = "record long, hash long, content binary, copies long, keep_id long, keep_row long, sha256 string, into long"


def normal(text: bytes) -> bytes:
    """Each run of white space becomes one space."""
    text = text.translate(_MARKS)
    return _RUNS.sub(b" ", text) if b"  " in text else text


def hashed(content: bytes) -> int:
    """A signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest(content)
    return h - (1 << 64) if h >> 63 else h


class ContentTable:
    """Open addressing with linear probing; entries are numbered in the order they came."""

    def __init__(self, limit: int = TABLE_BYTES):
        self.limit, self.bytes = limit, 0
        self.hashes, self.contents = array("q"), []
        self.slots, self.mask = array("i", [-1]) * 1024, 1023

    def __len__(self) -> int:
        return len(self.contents)

    def _slot(self, h: int, content: bytes | None) -> int:
        """The slot that holds the content, or the free one where it belongs (which is all that is looked for without a content)."""
        slots, mask = self.slots, self.mask
        at = (h ^ h >> 29) & mask
        while (k := slots[at]) >= 0 and (content is None or self.hashes[k] != h or self.contents[k] != content):
            at = (at + 1) & mask
        return at

    def find(self, h: int, content: bytes) -> int | None:
        """The entry that has this content, a new one if there is room for it; None if there is none."""
        at = self._slot(h, content)
        if self.slots[at] >= 0:
            return self.slots[at]
        if self.contents and self.bytes + len(content) > self.limit:
            return None
        self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 64
        if 2 * len(self.contents) > self.mask:
            self.slots, self.mask = array("i", [-1]) * (2 * self.mask + 2), 2 * self.mask + 1
            for k, x in enumerate(self.hashes):
                self.slots[self._slot(x, None)] = k
        return len(self.contents) - 1


class First:
    """Copies of each entry and the row of it that stays: the least doc_id, null last, then the least row number."""

    def __init__(self):
        self.copies, self.best = [], []

    def see(self, entry: int, copies: int, doc_id: int | None, row: int) -> None:
        key = doc_id is None, doc_id or 0, row
        if entry == len(self.best):
            self.copies.append(0)
            self.best.append(key)
        self.copies[entry] += copies
        self.best[entry] = min(self.best[entry], key)

    def of(self, entry: int) -> tuple[int, int | None, int]:
        null, doc_id, row = self.best[entry]
        return self.copies[entry], None if null else doc_id, row


def _batches(schema: pa.Schema, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded bytes, whatever the size of contents."""
    at = schema.get_field_index("content")
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[at] or b"")
        if len(part) >= BATCH or size >= 8 << 20:
            yield record_batch(schema, *map(list, zip(*part, strict=True)))
            part, size = [], 0
    if part:
        yield record_batch(schema, *map(list, zip(*part, strict=True)))


def spill(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """A row for each document; the first of each content in its table is a record and carries the content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        table, first, members, records = ContentTable(table_bytes), First(), [], []

        def full() -> Iterator[pa.RecordBatch]:
            rows = []
            for doc_id, own, entry in members:
                if own == records[entry]:
                    content = table.contents[entry]
                    rows.append((doc_id, own, own, table.hashes[entry], content, *first.of(entry), hashlib.sha256(content).hexdigest()))
                else:
                    rows.append((doc_id, own, records[entry], None, None, None, None, None, None))
            return _batches(SPILL, rows)

        for batch, texts in blocks(batches):
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                content = normal(texts.bytes(k))
                h = hashed(content)
                entry = table.find(h, content) if len(members) < ROWS else None
                if entry is None:
                    yield from full()
                    table, first, members, records = ContentTable(table_bytes), First(), [], []
                    entry = table.find(h, content)
                if entry == len(records):
                    records.append(row)
                first.see(entry, 1, doc_id, row)
                members.append((doc_id, row, entry))
                row += 1
        yield from full()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SPILL_SQL)


def _merge(records: DataFrame, table_bytes: int) -> DataFrame:
    """Records of each partition against one table: into names the record that stands for the content, null if there was no room.

    The record that stands for a content carries the counts of all; it is the first that came.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first, members, stands = ContentTable(table_bytes), First(), [], []
        for batch in batches:
            spilled = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record, h, content, copies, keep_id, keep_row, sha256 = r
                entry = table.find(h, content)
                if entry is None:
                    spilled.append((*r, None))
                    continue
                if entry == len(stands):
                    stands.append((record, sha256))
                first.see(entry, copies, keep_id, keep_row)
                members.append((record, entry))
            yield from _batches(MERGED, spilled)
        for at in range(0, len(members), BATCH):
            rows = []
            for record, entry in members[at : at + BATCH]:
                root, sha256 = stands[entry]
                rows.append((record, None, None, *first.of(entry), sha256, root) if record == root else (record, None, None, None, None, None, None, root))
            yield from _batches(MERGED, rows)

    return records.mapInArrow(run, _MERGED_SQL)


def _size(records: DataFrame) -> int:
    return records.agg(F.sum(F.length("content") + 64)).first()[0] or 0


def deduplicate(docs: DataFrame, table_bytes: int = TABLE_BYTES, hot: int = HOT) -> DataFrame:
    """One row a document: doc_id, keep_id (the document that stays), group_size, kept, text_sha256."""
    spark = docs.sparkSession
    spilled = materialize(spill(docs, table_bytes), "dedup-spill")
    names = [n for n, _ in _RECORD]
    records, links, results = spilled.where("content is not null").select(*names), None, None

    salted = records
    while True:  # contents in too many tables: merge shares of their records first
        many = materialize(salted.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > hot), "dedup-hot")
        shares = many.agg(F.sum(F.ceil(F.col("n") / hot)).cast("long")).first()[0]
        if not shares:
            break
        dealt = salted.join(many.select(F.col("hash").alias("hot_hash"), F.ceil(F.col("n") / hot).alias("shares")), F.col("hash") == F.col("hot_hash"))
        dealt = dealt.repartition(max(shares, 1), "hash", F.pmod(F.xxhash64("record"), F.col("shares"))).select(*names)
        merged = materialize(_merge(dealt, table_bytes), "dedup-shares")
        step = merged.where("into is not null and into != record").select("record", "into")
        links = step if links is None else links.unionByName(step)
        # who stands for others goes on with its content and their counts; who found no room goes on as it was
        stands = merged.where("into = record").select("record", "copies", "keep_id", "keep_row").join(salted.select("record", "hash", "content", "sha256"), "record").select(*names)
        rest = salted.join(many, "hash", "left_anti").select(*names)
        salted = materialize(rest.unionByName(stands).unionByName(merged.where("into is null").select(*names)), "dedup-records")

    left, level, parts = salted, 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = _size(left)
    while True:
        buckets = max(parts, -(-2 * size // table_bytes))
        merged = materialize(_merge(left.repartition(buckets, F.xxhash64("hash", F.lit(level))), table_bytes), "dedup-buckets")
        done = merged.where("into is not null").select("record", "into", "copies", "keep_id", "keep_row", "sha256")
        results = done if results is None else results.unionByName(done)
        left, level = merged.where("into is null").select(*names), level + 1
        size = _size(left)
        if not size:
            break

    # a record's result: its own if it stands for the content, else that of the record it was merged into
    stands = results.where("into = record").select(F.col("record").alias("into"), "copies", "keep_id", "keep_row", "sha256")
    found = results.select("record", "into").join(stands, "into").drop("into")
    if links is not None:
        found = materialize(found, "dedup-found")
        while True:  # a record may have been merged several times in a row
            more = materialize(links.join(found.select(F.col("record").alias("into"), "copies", "keep_id", "keep_row", "sha256"), "into").drop("into").join(found, "record", "left_anti"), "dedup-more")
            if more.isEmpty():
                break
            found = found.unionByName(more)
    rows = spilled.select("doc_id", "row", "record")
    kept = (F.col("row") == F.col("keep_row")).alias("kept")
    return rows.join(found, "record").select("doc_id", "keep_id", F.col("copies").alias("group_size"), kept, F.col("sha256").alias("text_sha256"))
