"""First-fit-decreasing sequence packing and its documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.session import ship

# Context length, tokens an image stands for, sentinels, caps of interleaved documents, SFT patches.
CONTEXT = 4096
IMAGE_TOKENS = 144
IMAGE, IGNORE = -200, -100
MOST_IMAGES, MOST_TOKENS = 10, 6000

Tokenizer = Callable[[str], list[int]]


def word_tokenizer(text: str) -> list[int]:
    """The default tokenizer: a number a word, from its bytes; stands in for a model's own."""
    return [int.from_bytes(w.encode()[:3], "big") + 10 for w in re.findall(r"\S+", text)]


def interleave(text: str, tokenizer: Tokenizer = word_tokenizer, bos: int | None = None) -> list[int]:
    """The tokens of the parts around <image>, with the image sentinel between; a start token stands first only."""
    out: list[int] = []
    for i, part in enumerate(text.split("<image>")):
        ids = tokenizer(part)
        if bos is not None and ids[:1] == [bos]:
            ids = ids[1:]
        if i:
            out.append(IMAGE)
        elif bos is not None:
            out.append(bos)
        out += ids
    return out


def caption_text(caption: Column) -> Column:
    """An image, then the caption with literal image marks made harmless."""
    return F.concat(F.lit("<image>\n"), F.replace(caption, F.lit("<image>"), F.lit("<image-placeholder>")))


def document_length(ids: Sequence[int]) -> int:
    """Tokens with images expanded."""
    return len(ids) + (IMAGE_TOKENS - 1) * sum(i == IMAGE for i in ids)


def interleaved(texts: Sequence[str | None], images: Sequence[object | None], tokenizer: Tokenizer = word_tokenizer, caps: bool = False) -> list[int] | None:
    """The valid positions of an interleaved document as tokens; P31 with `caps`. Null without an image or beyond the caps.

    With caps, images that end the document go (W10), and lengths count the images kept.
    """
    out: list[int] = []
    for text, image in zip(texts, images, strict=True):
        if image is not None:
            out.append(IMAGE)
        elif text is not None:
            out += tokenizer(f"{text}<|endofchunk|>")
    if caps:
        while out and out[-1] == IMAGE:
            out.pop()
    n = out.count(IMAGE)
    if not n or caps and (n >= MOST_IMAGES or len(out) > MOST_TOKENS):
        return None
    return out


def collapse_runs(ids: Column, value: int = IMAGE) -> Column:
    """Of a run of `value` the first stays."""
    return F.filter(ids, lambda x, i: ~((x == value) & (F.get(ids, i - 1) == value) & (i > 0)))


def labels(ids: Column) -> Column:
    """Image sentinels are not learnt."""
    return F.transform(ids, lambda x: F.when(x == IMAGE, F.lit(IGNORE)).otherwise(x))


def first_fit_decreasing(lengths: Sequence[int], capacity: int = CONTEXT) -> list[int]:
    """The bin of each item; items go by length, longest first, equal ones in order, to the first bin with room.

    A tree of the bins' largest rests finds that bin in O(log n); an item beyond the capacity is a bin of its own.
    """
    n = len(lengths)
    size = 1 << max(0, (max(n, 1) - 1).bit_length())
    rest = [capacity] * (2 * size)
    out = [0] * n
    for item in sorted(range(n), key=lambda i: -lengths[i]):
        need = lengths[item]
        if need > capacity:
            node = size  # the first bin that nothing has touched
            node = _first(rest, size, capacity)
            left = -1
        else:
            node = _first(rest, size, need)
            left = rest[node] - need
        out[item] = node - size
        rest[node] = left
        node //= 2
        while node:
            rest[node] = max(rest[2 * node], rest[2 * node + 1])
            node //= 2
    return out


def _first(rest: list[int], size: int, need: int) -> int:
    node = 1
    while node < size:
        node = 2 * node if rest[2 * node] >= need else 2 * node + 1
    return node


def pack(documents: DataFrame, capacity: int = CONTEXT) -> DataFrame:
    """(shard, key, length) -> shard, key, length, bin, at (place in the bin, in filling order). Bins do not cross shards.

    Only keys and lengths go to the packing task of a shard; a repeated key keeps its last length. Bounded by the shard's rows, which shard writers cap.
    """
    ship(documents.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable").drop_duplicates("key", keep="last").reset_index(drop=True)
        rows["bin"] = np.array(first_fit_decreasing(rows["length"].tolist(), capacity), np.int64)
        order = rows.sort_values(["bin", "length", "key"], ascending=[True, False, True], kind="stable")
        order["at"] = order.groupby("bin").cumcount().astype("int64")
        return order[["shard", "key", "length", "bin", "at"]]

    kinds = dict(documents.dtypes)
    return documents.select("shard", "key", F.col("length").cast("long").alias("length")).groupBy("shard").applyInPandas(run, f"shard {kinds['shard']}, key {kinds['key']}, length long, bin long, at long")


def concatenate(packed: DataFrame, ids: DataFrame) -> DataFrame:
    """(shard, key, bin, at) and (shard, key, ids) -> a row a bin with an image: input_ids, lengths, labels."""
    joined = packed.join(ids, ["shard", "key"])
    rows = F.array_sort(F.collect_list(F.struct("at", "ids", "length")))
    out = joined.groupBy("shard", "bin").agg(rows.alias("rows")).select("shard", "bin", F.flatten(F.transform("rows", lambda r: r["ids"])).alias("input_ids"), F.transform("rows", lambda r: r["length"]).alias("lengths"))
    return out.where(F.array_contains("input_ids", IMAGE)).withColumn("labels", labels(F.col("input_ids")))


def pending(shards: DataFrame, done: DataFrame) -> DataFrame:
    """Shards without a done marker."""
    return shards.join(done.select("shard"), "shard", "left_anti")
