"""Length buckets that minimise padding, and token-budget batches inside each bucket.

The histogram of lengths covers all documents, and each length is a cell of its own, so
the dynamic programme is exact.  Distinct lengths add up to no more than all words, so
the driver gets at most the square root of twice their number of cells (100 000 of 5e9 words).
The best last cuts of longer and longer prefixes never go back, so they are found by halving.  A bucket's documents are dealt by hash to groups of bounded size and
numbered there, so no bucket meets in one task; a group leaves one batch part full at most.

Defined cases: null and empty texts have length 0 and go to the first bucket; a
document longer than the budget (a very long text) is a batch of its own; ties of length share a cell; repeated rows stay separate
rows; rows of one doc_id, null included, are numbered in one group of their bucket; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.common import n_words, stored

BUCKETS = 16
BUDGET = 16_384
#: Full batches that a numbering group holds on average.
GROUP_BATCHES = 64
#: Rows that a numbering group holds at least, where its bucket has them.
GROUP_ROWS = 4096


def histogram(lengths: DataFrame) -> list[tuple[int, int, int]]:
    """(longest, count, sum) of each cell, ascending."""
    cells = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    return sorted((r["length"], r["n"], r["length"] * r["n"]) for r in cells.collect())


def boundaries(cells: list[tuple[int, int, int]], buckets: int = BUCKETS) -> list[int]:
    """The longest lengths of at most `buckets` buckets with the least padding; of equal plans the one with earlier cuts."""
    if not cells:
        return []
    longest, count, total = (np.array(x, np.int64) for x in zip(*cells, strict=True))
    n, s = (np.concatenate(([0], np.cumsum(x))) for x in (count, total))
    m = len(cells)
    best = longest * n[1:] - s[1:]
    cuts = []
    for _ in range(1, min(buckets, m)):
        nxt, cut = best.copy(), np.zeros(m, np.int64)
        base = best[:-1] + s[1:-1]  # a bucket of cells i + 1 .. j costs longest[j] * (n[j+1] - n[i+1]) - (s[j+1] - s[i+1])
        todo = [(1, m - 1, 0, m - 2)]  # cells first .. last, whose cuts lie in low .. high
        while todo:
            first, last, low, high = todo.pop()
            if first > last:
                continue
            j = (first + last) // 2
            up = min(high, j - 1)
            cost = base[low : up + 1] - longest[j] * n[low + 1 : up + 2]
            i = low + int(cost.argmin())
            value = cost[i - low] + longest[j] * n[j + 1] - s[j + 1]
            if value < nxt[j]:
                nxt[j], cut[j] = value, i + 1
            todo += [(first, j - 1, low, i), (j + 1, last, i, high)]
        cuts.append(cut)
        best = nxt
    ends, j = [], m
    for cut in reversed([np.zeros(m, np.int64), *cuts]):
        ends.append(int(longest[j - 1]))
        j = int(cut[j - 1])
        if j == 0:
            break
    return ends[::-1]


def packed_lengths(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 11) -> DataFrame:
    """doc_id, length -> doc_id, length, bucket, boundary, batch, slot, padding."""
    cells = histogram(lengths)
    ends = boundaries(cells, buckets)
    if not ends:
        return lengths.select("doc_id", "length", *(F.lit(0).cast("long").alias(c) for c in ("bucket", "boundary", "batch", "slot", "padding")))
    held = np.zeros(len(ends), np.int64)
    for longest, n, _ in cells:
        held[np.searchsorted(ends, longest)] += n
    rows = [max(1, budget // max(1, e)) for e in ends]
    groups = [max(1, int(n) // max(r * GROUP_BATCHES, GROUP_ROWS)) for n, r in zip(held, rows, strict=True)]

    def pick(values, at="length"):
        out = F.lit(values[-1]).cast("long")
        for e, v in reversed(list(zip(ends[:-1], values[:-1], strict=True))):
            out = F.when(F.col(at) <= e, F.lit(v).cast("long")).otherwise(out)
        return out

    group = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("groups"))
    w = Window.partitionBy("bucket", "group").orderBy("key", "doc_id", "length")
    return (
        lengths.select("doc_id", "length", pick(list(range(len(ends)))).alias("bucket"), pick(ends).alias("boundary"), pick(rows).alias("rows"), pick(groups).alias("groups"), F.xxhash64("doc_id", F.lit(seed + 1)).alias("key"))
        .withColumn("group", group)
        .withColumn("at", F.row_number().over(w).cast("long") - 1)
        .select("doc_id", "length", "bucket", "boundary", ((F.col("bucket") * (1 << 24) + F.col("group")) * (1 << 24) + F.floor(F.col("at") / F.col("rows"))).alias("batch"), (F.col("at") % F.col("rows")).alias("slot"), (F.col("boundary") - F.col("length")).alias("padding"))
    )


def packed_documents(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Packs the rows of docs (doc_id, text); lengths are counts of words."""
    return packed_lengths(stored(docs.select("doc_id", n_words(F.col("text")).alias("length")), "pack-lengths"), buckets, budget)
