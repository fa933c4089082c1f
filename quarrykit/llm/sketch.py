"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the range is kept.

Shingles are SHINGLE_BYTES-byte windows of the UTF-8 text (a shorter text is one
shingle), hashed to 40 bits.  Since the threshold is fixed, sketches of parts merge by union, the kept
hashes of a subset are a subset, and containment is estimated without bias however
different two documents' lengths are.  A text with fewer than LEAST kept hashes also has
its next smallest ones, up to LEAST in all: two sketches are compared over the range that both know
whole, which is the threshold's for long texts, wider for short ones, and everything for texts of
at most LEAST shingles, which compare exactly.

A fingerprint is the 16-digit hash of the text's whole shingle set, so equal texts have equal fingerprints,
the number of kept hashes below the threshold, a mark whether these are all shingles, and the hashes,
five bytes each, in base 64: about 7 / 128 of the text's length, and at most 180 characters for a short one.

`neighbours` pairs every document with the next one by doc_id without a global
window: rows are dealt to ranges of doc_id, each range also gets the first row of the next
range, and a task walks its ranges in order.

Defined cases: null text is empty; the empty text has no shingle, its likeness is 1
to another empty text and 0 to any other; rows that repeat a doc_id follow each other by text; a null doc_id comes
first; the only row of a table is its own next document; a very long text is sketched whole, by itself; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import CHUNK_BYTES, digest, mapped, partitions, prefix_hash, record, span_hash

SHINGLE_BYTES = 16
#: One shingle hash in FRACTION is kept.
FRACTION = 128
#: Hashes that a text of as many shingles has at least.
LEAST = 24
_BITS = 40
_LIMIT = (1 << _BITS) // FRACTION


@dataclass(frozen=True)
class Sketch:
    """name: hash of the shingle set; kept: its hashes below the threshold; more: the next smallest ones; whole: there are no others."""

    name: int
    kept: np.ndarray
    more: np.ndarray
    whole: bool

    @property
    def known(self) -> int:
        """All the text's hashes below this bound are in the sketch."""
        return 1 << _BITS if self.whole else max(_LIMIT, int(self.more[-1]) + 1 if len(self.more) else 0)

    def below(self, bound: int) -> np.ndarray:
        every = np.concatenate((self.kept, self.more))
        return every[: np.searchsorted(every, np.uint64(bound))]


def _kept(texts: list[bytes]) -> list[Sketch]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    sums = prefix_hash(data)
    out, at = [], 0
    ends = np.cumsum([len(t) for t in texts])
    starts = np.arange(max(0, len(data) - SHINGLE_BYTES + 1))
    every = span_hash(sums, starts, starts + SHINGLE_BYTES) if len(starts) else np.zeros(0, np.uint64)
    for end in ends.tolist():
        if end - at >= SHINGLE_BYTES:
            own = every[at : end - SHINGLE_BYTES + 1]
        elif end > at:
            own = span_hash(sums, np.array([at]), np.array([end]))
        else:
            own = np.zeros(0, np.uint64)
        # Equal texts only need to agree, so the order of shingles may count.
        name = digest(own)[0] & 0xFFFFFFFFFFFFFFFF if len(own) else 0
        own = own >> np.uint64(64 - _BITS)
        low = np.unique(own[own < _LIMIT])
        more, whole = low[:0], False
        if len(low) < LEAST:
            least = np.unique(own)
            low, more, whole = least[: len(low)], least[len(low) : LEAST], len(least) <= LEAST
        out.append(Sketch(name, low, more, whole))
        at = end
    return out


def encode(s: Sketch) -> str:
    every = np.concatenate((s.kept, s.more)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    return f"{s.name:016x}{len(s.kept):x}{'=' if s.whole else '+'}{base64.b64encode(every.tobytes()).decode()}"


def decode(fingerprint: str) -> Sketch:
    count = 16
    while fingerprint[count] not in "=+":
        count += 1
    raw = np.frombuffer(base64.b64decode(fingerprint[count + 1 :]), np.uint8).reshape(-1, 5)
    every = np.zeros((len(raw), 8), np.uint8)
    every[:, 3:] = raw
    every, n = every.view(">u8").ravel().astype(np.uint64), int(fingerprint[16:count], 16)
    return Sketch(int(fingerprint[:16], 16), every[:n], every[n:], fingerprint[count] == "=")


def merge(fingerprints: list[str]) -> np.ndarray:
    """The threshold's sketch of the union of documents."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(decode(f).kept for f in fingerprints)]))


def _both(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    bound = min(a.known, b.known)
    x, y = a.below(bound), b.below(bound)
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard likeness of the shingle sets."""
    if a.name == b.name:
        return 1.0
    common, m, n = _both(a, b)
    return common / (m + n - common) if m + n else 0.0


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has."""
    if a.name == b.name:
        return 1.0
    common, m, _ = _both(a, b)
    return common / m if m else 0.0


def edited(text: str, following: str) -> str:
    """The last quarter of the text's code points replaced by as many first ones of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def neighbours(docs: DataFrame) -> DataFrame:
    """bucket, last, doc_id, text: rows dealt by range of doc_id; rows with `last` are copies of the next range's first row."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.col("doc_id").isNull().alias("none"), F.coalesce("text", F.lit("")).alias("text"))
    parts = 4 * partitions(spark)
    cuts = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    found = F.lit(0)
    if cuts:
        found = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("id")))
    rows = rows.withColumn("bucket", found)
    heads = sorted((r["bucket"], r["id"]) for r in rows.groupBy("bucket").agg(F.min("id").alias("id")).collect())
    if not heads:
        return rows.select("bucket", F.lit(False).alias("last"), "id", "none", "text")
    before = {heads[i][1]: heads[i - 1][0] for i in range(len(heads))}
    at = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    tails = rows.where(F.col("id").isin(list(before))).withColumn("bucket", at[F.col("id")])
    return rows.withColumn("last", F.lit(False)).unionByName(tails.withColumn("last", F.lit(True))).select("bucket", "last", "id", "none", "text")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("contained_in_next", pa.float64())])


def _rows(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """pairs: (doc_id, text, next text)."""
    changed = [edited(t, n) for _, t, n in pairs]
    raw = [[x.encode("utf-8") for x in xs] for xs in ([t for _, t, _ in pairs], changed, [pairs[-1][2]])]
    own = _kept(raw[0] + raw[2])
    new = _kept(raw[1])
    m = len(pairs)
    return record(
        _OUT, [p[0] for p in pairs], [len(p[1]) for p in pairs], [hashlib.sha256(x).hexdigest() for x in raw[1]], [encode(x) for x in own[:m]], [encode(x) for x in new],
        [likeness(own[i], new[i]) for i in range(m)], [likeness(own[i], own[i + 1]) for i in range(m)], [containment(own[i], own[i + 1]) for i in range(m)],
    )


def fingerprinted(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs (doc_id, text)."""

    def run(batches):
        held, size, before, closed = [], 0, None, None
        for batch in batches:
            for bucket, last, doc_id, none, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if bucket == closed:  # other rows that share the first row's id
                    continue
                if before is not None:
                    held.append((before[0], before[1], text))
                    size += len(before[1])
                    # consecutive rows only: likeness() takes each pair's next text from the row that follows
                    if size >= CHUNK_BYTES or last:
                        yield _rows(held)
                        held, size = [], 0
                before = None if last else (None if none else doc_id, text)
                if last:
                    closed = bucket
        if held:
            yield _rows(held)

    dealt = neighbours(docs).repartition("bucket").sortWithinPartitions("bucket", "last", ~F.col("none"), "id", "text")
    return mapped(dealt.select("bucket", "last", "id", "none", "text"), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_in_next double")
