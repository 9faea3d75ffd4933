"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at ``RADIUS`` = 3 or fewer differing bits are linked. With all 64 bits, balls of radius 1 around both ends
meet for 2 differing bits at most. So the 64 bits are cut in three blocks and each is left out in turn: of three
differing bits one block holds at least one, and outside it the balls of radius 1 (half the radius) meet. A
fingerprint thus emits 129 variants in place of the 2,081 of a full ball of radius 2, and no link is missed.

Buckets are never expanded to all pairs. Fingerprints that share a variant of all 64 bits differ in 2 bits at most, so
each such bucket is a star. Components of those stars come first; then only members of different components that
share a masked bucket are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .staging import materialize
from .text import blocks, record_batch

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Shingles hashed at once, whatever the length of the text.
SHINGLES_AT_ONCE = 1 << 16
#: Bits of the three blocks.
BLOCKS = ((0, 21), (21, 42), (42, 64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingle hashes. ``text`` is lower-cased UTF-8."""
    words = text.split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20), len(joined))
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    n, starts, ends = len(starts) - k + 1, starts.tolist(), ends.tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        upto = min(at + SHINGLES_AT_ONCE, n)
        h = np.fromiter((digest(joined[starts[i] : ends[i + k - 1]], SEED) for i in range(at, upto)), np.uint64, upto - at)
        ones += np.add.reduce(np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64), axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every whole text; null and empty texts have fingerprint zero."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            lower = texts.lower_ascii()
            yield record_batch(schema, batch.column("doc_id"), [_signed(fingerprint(lower.bytes(i))) for i in range(lower.n)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _ball(value: Column, bits: list[int]) -> Column:
    """The value and all its variants with one of ``bits`` flipped."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in bits))
    return F.transform(flips, lambda x: value.bitwiseXOR(x))


def masked_variants(fp: Column) -> Column:
    """129 keys: for each block the radius-1 ball of the bits outside it. Bit patterns inside mark the block."""
    parts = []
    for low, high in BLOCKS:
        inside = ((1 << high) - 1) ^ ((1 << low) - 1)
        rest = fp.bitwiseAND(F.lit(_signed(~inside & (2**64 - 1)))).bitwiseOR(F.lit(_signed(1 << low)))
        parts.append(_ball(rest, [i for i in range(64) if not low <= i < high]))
    return F.concat(*parts)


def full_variants(fp: Column) -> Column:
    return _ball(fp, list(range(64)))


def _shared(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose key holds two values or more, with the least of them."""
    group = Window.partitionBy(key)
    return rows.withColumn("least", F.min(value).over(group)).withColumn("most", F.max(value).over(group)).where("least != most").drop("most")


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """(fp, root) for every fingerprint of ``distinct`` (fp, one row each): equal roots for one component."""
    buckets = materialize(_shared(distinct.select(F.explode(masked_variants(F.col("fp"))).alias("key"), "fp"), "key", "fp").drop("least"), "simhash-buckets")
    active = buckets.select("fp").distinct()
    stars = _shared(active.select(F.explode(full_variants(F.col("fp"))).alias("key"), "fp"), "key", "fp").where("fp != least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    near = connected_components(stars, "simhash-near")
    near = near.select(F.col("node").alias("fp"), F.col("root").alias("near"))
    split = buckets.join(near, "fp", "left").select("key", "fp", F.coalesce("near", "fp").alias("near"))
    split = materialize(_shared(split, "key", "near").drop("least"), "simhash-split")
    left, right = split.toDF("key", "fp_a", "a"), split.toDF("key", "fp_b", "b")
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= RADIUS))
    far = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), "simhash-far").select(F.col("node").alias("near"), "root")
    rooted = distinct.select("fp").join(near, "fp", "left").withColumn("near", F.coalesce("near", "fp"))
    return rooted.join(far, "near", "left").select("fp", F.coalesce("root", "near").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links.

    Equal fingerprints are one node, so a group of exact copies of any size costs one row per task and node. Repeated
    rows keep their number. Null, empty and wordless texts have fingerprint zero and are linked like any other. Rows without doc_id take part and get
    the number of their component, null if no document in it has one. A text of any length is hashed in bounded groups of shingles. An empty table
    gives no rows. No column but doc_id and text is read, so others may have any name.
    """
    prints = materialize(fingerprints(docs), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-distinct")
    rooted = materialize(distinct.join(link_fingerprints(distinct), "fp"), "simhash-roots")
    classes = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_print = rooted.join(classes, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def fingerprint_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
