"""Resharding: samples by an id multiset, shard tables, task plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Samples and bytes at which a shard is full.
SHARD_ROWS = 10_000
SHARD_BYTES = 3_000_000_000


def select_copies(samples: DataFrame, subset: DataFrame) -> DataFrame:
    """Every sample as often as its uid stands in the subset, with key {uid}-{copy}. Duplicates count; none is dropped."""
    counted = subset.groupBy("uid").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    out = samples.join(counted, "uid").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return out.withColumn("key", F.concat_ws("-", "uid", F.col("copy").cast("string"))).drop("copies")


def never_found(samples: DataFrame, subset: DataFrame) -> DataFrame:
    """Rows of the subset, duplicates included, that no sample has."""
    return subset.join(samples.select("uid"), "uid", "left_anti")


def union_of_selections(*selections: DataFrame, distinct: bool = True) -> DataFrame:
    """Uids of several filters; without `distinct` a uid in two of them is taken twice."""
    out = selections[0].select("uid")
    for s in selections[1:]:
        out = out.unionByName(s.select("uid"))
    return out.distinct() if distinct else out


def shard_table(shards: DataFrame) -> DataFrame:
    """(shard, size) -> data_start, the sizes before it in shard order, and total. A row a shard passes one task."""
    w = Window.orderBy("shard")
    return shards.withColumn("data_start", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def plan_tasks(shards: DataFrame, workers: int) -> DataFrame:
    """shard_table -> worker: contiguous runs of shards, a shard going by where it starts in steps of ceil(total / workers)."""
    step = F.ceil(F.col("total") / workers)
    last = F.ceil(F.col("total") / step) - 1
    return shards.withColumn("worker", F.greatest(F.least(F.floor(F.col("data_start") / step), last), F.lit(0)).cast("long"))


def new_shards(samples: DataFrame, order: str, rows: int = SHARD_ROWS, size: str | None = None, most_bytes: int = SHARD_BYTES) -> DataFrame:
    """`shard` and `at` of each sample in the given order; with `size` a shard also ends once its bytes reach the limit.

    By rows alone, positions come from per-partition counts, so no task sees all samples.
    """
    ranged = samples.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    ranged = ranged.withColumn("__i", F.col("__i") - F.shiftleft(F.col("__p").cast("long"), 33))
    # Spark may deal the rows out anew for the second use, so the dealt rows are kept.
    ranged = ranged.persist()
    per = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = ranged.join(F.broadcast(before), "__p").withColumn("__at", F.col("before") + F.col("__i"))
    if size is None:
        shard = F.floor(F.col("__at") / rows)
        return placed.withColumn("shard", shard).withColumn("at", F.col("__at") - shard * rows).drop("__p", "__i", "__at", "before")
    running = F.sum(size).over(Window.partitionBy("__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    blocks = placed.withColumn("__block", F.floor(F.col("__at") / rows)).withColumn("__sub", F.floor(F.coalesce(running, F.lit(0)) / most_bytes))
    return blocks.withColumn("shard", F.concat_ws("-", "__block", "__sub")).withColumn("at", F.row_number().over(Window.partitionBy("__block", "__sub").orderBy("__at")) - 1).drop("__p", "__i", "__at", "before", "__block", "__sub")


def shard_stats(samples: DataFrame) -> DataFrame:
    """Successes of each shard."""
    return samples.groupBy("shard").agg(F.count(F.lit(1)).alias("successes"))


def dataset_size(wanted: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row, `size`: the listed shards' sizes, 0 for those not in the table."""
    return wanted.join(sizes, "shard", "left").agg(F.sum(F.coalesce("size", F.lit(0))).alias("size"))


def parquet_of_shard(mapping: DataFrame, shards: DataFrame) -> DataFrame:
    """(parquet, shards[]) inverted: each shard with its parquet, the last by name of several, null without one."""
    last = mapping.select("parquet", F.explode("shards").alias("shard")).groupBy("shard").agg(F.max("parquet").alias("parquet"))
    return shards.join(last, "shard", "left")


def with_boxes(samples: DataFrame, boxes: DataFrame) -> DataFrame:
    """Samples with face_bboxes and `boxes_found`; a sample without a row of boxes stays, of several rows the smallest is taken."""
    one = boxes.groupBy("uid").agg(F.min("face_bboxes").alias("face_bboxes"))
    return samples.join(one, "uid", "left").withColumn("boxes_found", F.col("face_bboxes").isNotNull())


def group_members(members: DataFrame) -> DataFrame:
    """(url, at, name, data) in archive order -> samples (url, key, parts).

    Consecutive members of one prefix are a sample; suffixes are lower-cased, and a suffix that the sample has closes it.
    """
    w = Window.partitionBy("url").orderBy("at")
    base = F.regexp_extract("name", r"^((?:.*/|)[^./]+)[.]([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract("name", r"^((?:.*/|)[^./]+)[.]([^/]*)$", 2))
    parts = members.withColumn("prefix", base).withColumn("suffix", suffix).where("prefix <> ''")
    run = parts.withColumn("run", F.sum(F.when(F.col("prefix") == F.lag("prefix").over(w), 0).otherwise(1)).over(w))
    # The n-th time a suffix comes in a run opens at least the n-th sample of the run.
    again = F.row_number().over(Window.partitionBy("url", "run", "suffix").orderBy("at"))
    sub = F.max("again").over(Window.partitionBy("url", "run").orderBy("at"))
    named = run.withColumn("again", again).withColumn("sub", sub)
    return named.groupBy("url", "run", "sub", F.col("prefix").alias("key")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("suffix", "data")))).alias("parts")).drop("run", "sub")
