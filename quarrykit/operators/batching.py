"""Batches: padding, modality and length grouping, rank assignment."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.session import ship

IMAGE_PATCHES = 576


def order_key(c: Column, seed: int) -> Column:
    """What a seeded shuffle orders by; the same in every engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}-"), c.cast("string")))


def slim(rows: DataFrame, key: str, n: int, seed: int = 21, by: str | None = None) -> DataFrame:
    """The first n in seeded order; T07 with `by`: of each value. Subsets of growing n are nested."""
    k = order_key(F.col(key), seed)
    if by is None:
        return rows.orderBy(k, key).limit(n)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(k, key))).where(F.col("__n") <= n).drop("__n")


def with_demonstrations(rows: DataFrame, pool: DataFrame, key: str, n: int, seed: int = 21) -> DataFrame:
    """Every row with the same n rows of the pool, as an array `demos`."""
    chosen = slim(pool, key, n, seed).select(F.struct(order_key(F.col(key), seed).alias("__k"), *pool.columns).alias("d"))
    demos = chosen.agg(F.transform(F.array_sort(F.collect_list("d")), lambda d: F.struct(*(d[c].alias(c) for c in pool.columns))).alias("demos"))
    return rows.crossJoin(F.broadcast(demos))


def padded(rows: DataFrame, batch: str, ids: str, pad: int, most: int) -> DataFrame:
    """Ids cut at `most` and padded on the right to the batch's longest, with the mask of what is no padding."""
    cut = rows.withColumn(ids, F.slice(ids, 1, most))
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    out = cut.withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), longest - F.size(ids))))
    return out.withColumn("attention_mask", F.transform(ids, lambda x: x != pad))


def equal_buckets(lengths: list[int], buckets: int) -> list[int]:
    """Items in order each go to the bucket with the least total, the first of equals; all buckets get as many."""
    if len(lengths) % buckets:
        raise ValueError("items must divide evenly into the buckets")
    room, total, count, out = len(lengths) // buckets, [0.0] * buckets, [0] * buckets, []
    for n in lengths:
        b = total.index(min(total))
        out.append(b)
        count[b] += 1
        total[b] = math.inf if count[b] == room else total[b] + n
    return out


def split_modality(rows: DataFrame, batch_size: int, ranks: int, seed: int = 7) -> DataFrame:
    """(id, multimodal, length) -> id, batch, rank, at.

    Rows of a modality are shuffled and cut into batches; the last is filled up from the
    first; in a batch rows go by length, longest first, to the ranks (B04); batches of both modalities are
    shuffled together, the one with the longest row (images counted as patches) in front.
    The numbering is by range: a modality's positions come from counts of hash buckets, so no task
    sees all its rows.
    """
    ship(rows.sparkSession)
    keyed = rows.select("id", "multimodal", F.col("length").cast("long").alias("length")).withColumn("key", order_key(F.col("id"), seed)).withColumn("cell", F.substring("key", 1, 3))
    cells = keyed.groupBy("multimodal", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = cells.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("multimodal").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("multimodal"))).drop("n")
    inside = F.row_number().over(Window.partitionBy("multimodal", "cell").orderBy("key", "id")) - 1
    placed = keyed.join(before, ["multimodal", "cell"]).withColumn("pos", F.col("before") + inside).withColumn("batch", F.floor(F.col("pos") / batch_size))
    last = F.floor((F.col("all") - 1) / batch_size)
    missing = (last + 1) * batch_size - F.col("all")
    fill = placed.where((F.col("batch") == 0) & (F.col("pos") < missing) & (last > 0)).withColumn("batch", last)
    both = placed.unionByName(fill)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        g["rank"] = equal_buckets(g["length"].tolist(), ranks) if len(g) % ranks == 0 else [i % ranks for i in range(len(g))]
        g["at"] = g.groupby("rank").cumcount()
        return g[["id", "multimodal", "batch", "length", "rank", "at"]]

    kinds = dict(rows.dtypes)
    dealt = both.select("id", "multimodal", "batch", "length", "key").groupBy("multimodal", "batch").applyInPandas(run, f"id {kinds['id']}, multimodal boolean, batch long, length long, rank long, at long")
    full = F.col("length") + F.when(F.col("multimodal"), IMAGE_PATCHES).otherwise(0)
    batches = dealt.groupBy("multimodal", "batch").agg(F.max(full).alias("most")).withColumn("k", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("multimodal").cast("string"), F.col("batch").cast("string"))))
    # One row a batch passes a single task here.
    longest = F.row_number().over(Window.orderBy(F.desc("most"), "k"))
    order = batches.withColumn("front", longest == 1).withColumn("final", F.row_number().over(Window.orderBy(F.desc("front"), "k")) - 1).select("multimodal", "batch", "final")
    return dealt.join(order, ["multimodal", "batch"]).select("id", "multimodal", "length", F.col("final").cast("long").alias("batch"), "rank", "at")


def rank_of(pos: Column, ranks: int, per_rank: int | None = None) -> Column:
    """Position modulo ranks; B06 with per_rank: blocks of per_rank positions go round the ranks."""
    return F.pmod(pos, F.lit(ranks)) if per_rank is None else F.pmod(F.floor(pos / per_rank), F.lit(ranks))


def resampled(shards: DataFrame, draws: int, seed: int, epoch: int) -> DataFrame:
    """`draws` shards with replacement, the same ones for a seed and epoch."""
    numbered = shards.select("shard", (F.row_number().over(Window.orderBy("shard")) - 1).alias("n"))
    n = numbered.count()
    picks = shards.sparkSession.range(draws).select("id", F.pmod(F.xxhash64("id", F.lit(seed), F.lit(epoch)), F.lit(max(n, 1))).alias("n"))
    return picks.join(numbered, "n").select(F.col("id").alias("draw"), "shard")
