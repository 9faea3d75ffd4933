"""Row numbers and last values in groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.shared import stored


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "row_number") -> DataFrame:
    """``rows`` numbered from 1 within ``keys`` (all together if there are none) by ``order`` (which should be unique), no group being held by one task.

    Rows are range-partitioned by keys and order, so a large group spreads over many partitions; each counts its own part, and
    the counts of the partitions before it, one row a group and partition, are added. The partitioned rows are written to the shared
    folder, because both steps must see the same ranges.
    """
    parts = stored(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_count"))
    before = counts.select(*keys, "_part", F.coalesce(F.sum("_count").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = parts.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    return own.join(before, [*keys, "_part"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_part", "_own", "_before")


#: Rows of a group that one task's window passes over; larger groups are spread over range partitions.
WINDOW_ROWS = 1_000_000


def last_upto(rows: DataFrame, key: str, order: str, values: dict[str, Column], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``rows`` with, for each of ``values`` (structs that begin with ``order``, or null), the last one up to each row of its key.

    Keys of many rows are range-partitioned by key and order: each partition passes over its own part, and the last values before it, one row a key and
    partition, are carried in.
    """
    large = stored(rows.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > window_rows).select(F.col(key).alias("_large")), "large-keys")
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda w: {name: F.last(value, ignorenulls=True).over(w) for name, value in values.items()}
    if large.isEmpty():
        return rows.withColumns(last(upto))
    is_large = rows[key] == large["_large"]
    small = rows.join(large, is_large, "left_anti").withColumns(last(upto))
    parts = stored(rows.join(large, is_large, "left_semi").repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()), "ranges")
    lasts = parts.groupBy(key, "_part").agg(*(F.max(value).alias(name) for name, value in values.items()))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), *(F.max(name).over(earlier).alias(f"_before_{name}") for name in values))
    own = parts.withColumns(last(Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = own.join(carried, (own[key] == carried["_k"]) & (own["_part"] == carried["_p"])).withColumns({name: F.coalesce(name, f"_before_{name}") for name in values})
    return small.unionByName(own.select(small.columns))
