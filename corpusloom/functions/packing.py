"""Greedy grouping of ordered rows by size, on the JVM and for keys of any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.shared import stored

#: Rows of a key that are folded as one array; larger keys are spread over tasks.
FOLDED_ROWS = 50_000
#: Lengths of groups that a fold gathers before it lays them aside, so that a list is not copied for each of very many groups.
LENGTHS_AT_ONCE = 256


def greedy_groups(rows: DataFrame, key: str, order: str, size: str, limit: int, name: str, folded_rows: int = FOLDED_ROWS) -> DataFrame:
    """(key, order, name): groups from 1 on, a new one beginning where the next row would take a group that has some size over ``limit``.

    ``order`` is unique within a key and sizes are whole numbers of at least 0. Only these three columns are moved.
    """
    rows = rows.select(key, order, F.col(size).cast("long").alias("_n"))
    n_rows = rows.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > folded_rows)
    large = stored(n_rows.select(F.col(key).alias("_large")), "large-keys")
    found = _folded(rows.join(large, rows[key].eqNullSafe(large["_large"]), "left_anti"), key, order, limit, name)
    if large.isEmpty():
        return found
    return found.unionByName(_doubled(rows.join(large, rows[key].eqNullSafe(large["_large"]), "left_semi"), key, order, limit, name))


def _folded(rows: DataFrame, key: str, order: str, limit: int, name: str) -> DataFrame:
    """One fold over a key's sizes."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_n").alias("n")))).alias("_l"))
    numbers = group_numbers(F.transform("_l", lambda x: x["n"]), limit)
    each = lists.select(key, F.explode(F.arrays_zip(F.transform("_l", lambda x: x["o"]).alias("o"), numbers.alias("g"))).alias("_z"))
    return each.select(key, F.col("_z.o").alias(order), F.col("_z.g").alias(name))


def group_numbers(sizes: Column, limit: int) -> Column:
    """The number, from 1 on, of the greedy group of each of ``sizes`` (an array): one fold that gathers the lengths of the groups, some at a time."""
    none, nested = F.array().cast("array<int>"), F.array().cast("array<array<int>>")
    start = F.struct(F.lit(0).cast("long").alias("filled"), F.lit(0).alias("rows"), none.alias("done"), nested.alias("before"))

    def step(s: Column, n: Column) -> Column:
        n = n.cast("long")
        full = (s["filled"] > 0) & (s["filled"] + n > limit)
        whole = F.size(s["done"]) >= LENGTHS_AT_ONCE
        begun = F.struct(
            n.alias("filled"), F.lit(1).alias("rows"), F.when(whole, F.array(s["rows"])).otherwise(F.concat(s["done"], F.array(s["rows"]))).alias("done"),
            F.when(whole, F.concat(s["before"], F.array(s["done"]))).otherwise(s["before"]).alias("before"),
        )
        return F.when(full, begun).otherwise(F.struct((s["filled"] + n).alias("filled"), (s["rows"] + 1).alias("rows"), s["done"].alias("done"), s["before"].alias("before")))

    lengths = F.aggregate(sizes, start, step, lambda s: F.concat(F.flatten(s["before"]), s["done"], F.array(s["rows"])))
    return F.flatten(F.transform(lengths, lambda n, k: F.array_repeat((k + 1).cast("int"), n)))


def _doubled(rows: DataFrame, key: str, order: str, limit: int, name: str) -> DataFrame:
    """The same by pointers: where the next group would begin if one began at a row, then the pointers that are met from the first row, twice as many in each round."""
    parts = stored(rows.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()), "sizes")
    upto = Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = parts.groupBy(key, "_part").agg(F.count("*").alias("_c"), F.sum("_n").alias("_s"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    before = totals.select(key, "_part", F.coalesce(F.sum("_c").over(earlier), zero).alias("_bc"), F.coalesce(F.sum("_s").over(earlier), zero).alias("_bs"))
    own = parts.withColumns({"_pos": F.count("*").over(upto), "_end": F.sum("_n").over(upto)})
    own = own.join(before, own[key].eqNullSafe(before[key]) & (own["_part"] == before["_part"])).select(own[key], order, "_n", (F.col("_pos") + F.col("_bc")).alias("_pos"), (F.col("_end") + F.col("_bs")).alias("_end"))
    placed = stored(own.withColumn("_start", F.col("_end") - F.col("_n")), "placed")
    # the first row that ends beyond start + limit: sought among ends and wanted ends of one stretch of ``limit``, else it is the first of the next stretch that has one
    ends = placed.select(key, F.col("_end").alias("_v"), F.lit(1).alias("_kind"), F.struct("_pos", "_start").alias("_row"), F.lit(None).cast("long").alias("_from"), F.lit(None).cast("long").alias("_at"))
    asks = placed.select(key, (F.col("_start") + limit).alias("_v"), F.lit(0).alias("_kind"), F.lit(None).cast(ends.schema["_row"].dataType).alias("_row"), F.col("_pos").alias("_from"), F.col("_start").alias("_at"))
    both = ends.unionByName(asks).withColumn("_b", F.expr(f"_v div {limit}"))
    # going down from the largest value, asks stand before ends of their own value: what was met last is the least end beyond them
    down = Window.partitionBy(key, "_b").orderBy(F.desc("_v"), "_kind", F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)
    sought = both.withColumn("_hit", F.last("_row", ignorenulls=True).over(down)).where("_kind = 0")
    stretches = ends.withColumn("_b", F.expr(f"_v div {limit}")).groupBy(key, "_b").agg(F.min("_row").alias("_first"))
    asked = sought.where("_hit is null").select(key, "_b", F.lit(None).cast(ends.schema["_row"].dataType).alias("_first"))
    asked = asked.unionByName(stretches).groupBy(key, "_b").agg(F.min("_first").alias("_first"))
    later = asked.withColumn("_next", F.first("_first", ignorenulls=True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(1, Window.unboundedFollowing))).select(F.col(key).alias("_k"), F.col("_b").alias("_b2"), "_next")
    found = sought.join(later, sought[key].eqNullSafe(later["_k"]) & (sought["_b"] == later["_b2"]), "left").withColumn("_hit", F.coalesce("_hit", "_next"))
    # a row with nothing of size before it in its group stays in the group
    jump = F.when(F.col("_hit._start") > F.col("_at"), F.col("_hit._pos")).otherwise(F.col("_hit._pos") + 1)
    jumps = stored(found.select(F.col(key).alias("_k"), F.col("_from").alias("_p"), jump.alias("_to")).where("_to is not null"), "jumps")
    reached = stored(placed.where("_pos = 1").select(F.col(key).alias("_k"), F.col("_pos").alias("_p")), "reached")
    while True:
        new = stored(reached.join(jumps, reached["_k"].eqNullSafe(jumps["_k"]) & (reached["_p"] == jumps["_p"])).select(reached["_k"], F.col("_to").alias("_p")), "met")
        if new.isEmpty():
            break
        reached = stored(reached.unionByName(new), "reached")
        then = jumps.toDF("_k2", "_p2", "_to2")
        jumps = stored(jumps.join(then, jumps["_k"].eqNullSafe(then["_k2"]) & (jumps["_to"] == then["_p2"])).select("_k", "_p", F.col("_to2").alias("_to")), "jumps")
    # number of groups begun up to a row, over ranges of rows again
    begun = placed.join(reached, placed[key].eqNullSafe(reached["_k"]) & (placed["_pos"] == reached["_p"]), "left").select(placed[key], order, F.col("_p").isNotNull().cast("int").alias("_new"))
    spread = stored(begun.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()), "begun")
    sums = spread.groupBy(key, "_part").agg(F.sum("_new").alias("_s"))
    sums = sums.select(F.col(key).alias("_k"), F.col("_part").alias("_q"), F.coalesce(F.sum("_s").over(earlier), zero).alias("_b"))
    counted = spread.withColumn("_own", F.sum("_new").over(upto))
    return counted.join(sums, counted[key].eqNullSafe(sums["_k"]) & (counted["_part"] == sums["_q"])).select(counted[key], order, (F.col("_own") + F.col("_b")).cast("int").alias(name))
