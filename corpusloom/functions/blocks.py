"""A stated query set against all rows: blocks of it go to the data, one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.shared import stored


def cut(queries: DataFrame, ident: str, blocks: int) -> list[DataFrame]:
    """The queries in ``blocks`` parts by the hash of their id."""
    return [queries.where(F.pmod(F.xxhash64(ident), F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [queries]


def by_blocks(spark: SparkSession, parts: list[DataFrame], load: Callable[[DataFrame], object], scan: Callable[[Broadcast], DataFrame]) -> DataFrame:
    """``scan`` with each block as a broadcast. Of several blocks each is run and written, and its broadcast destroyed, before the next is loaded."""
    if len(parts) == 1:
        return scan(spark.sparkContext.broadcast(load(parts[0])))
    found = None
    for part in parts:
        shared = spark.sparkContext.broadcast(load(part))
        rows = stored(scan(shared), "query-block")
        shared.destroy()
        found = rows if found is None else found.unionByName(rows)
    return found
