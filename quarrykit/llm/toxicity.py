"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct terms (lower-cased words without marks, and their
first few bytes), hashed to 2**HASH_BITS slots.  The score is
sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>): besides a weight for each term, every
pair of terms has a weight by the product of their factors, so an insult next to a
group's mention scores what neither does alone.

The model is fitted on the driver from at most SAMPLE labelled documents, those with
the smallest hashes of doc_id; their term slots are extracted on the executors, and only slots
of at least MIN_DOCS of these documents that go with a label, by themselves or beside a slot
that does, are learnt.  Every document is then
scored in full by its worker; nothing is shuffled.

Defined cases: null, empty and blank texts have no term and score the model's prior;
rows that repeat a doc_id are scored alike; a doc_id labelled more than once is toxic
if any label says so; labels other than 0 and 1, null labels and null ids are not learnt
from; without a label of both kinds the score is the (smoothed) share of toxic labels;
a null doc_id is never held out; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import Words, chunks, mapped, mix, packed, prefix_hash, record, span_hash

HASH_BITS = 20
#: Labelled documents the model is fitted on, at most.
SAMPLE = 20_000
MIN_DOCS = 4
FACTORS = 8
EPOCHS = 30
BATCH = 256
RATE = 0.1
DECAY = 1e-4
#: Besides the word itself, its first bytes are terms, as inflected words share them.
STEMS = (4, 5, 6)
#: Standard errors by which a slot's share of toxic documents must differ from the others' to be learnt.
SIGNAL = 3.0
_MARKS = b"\"'`.,;:!?()[]{}<>*_-~/\\|#$%&+="
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(_MARKS)] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def term_slots(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct term slots of each text, ascending: even ones of words, odd ones of their first bytes."""
    cleaned = [t.translate(_BLANK) for t in texts]
    words = Words(cleaned, lower=True)
    sums = prefix_hash(words.data)
    kinds = [words.hash]
    for n, size in enumerate(STEMS):
        kinds.append(mix(span_hash(sums, words.start, np.minimum(words.end, words.start + size)) + np.uint64(n + 1)))
    slots = [((mix(h) >> np.uint64(65 - HASH_BITS)).astype(np.int32) << 1) | (i > 0) for i, h in enumerate(kinds)]
    return [np.unique(np.concatenate([k[words.bounds[i] : words.bounds[i + 1]] for k in slots])) for i in range(len(texts))]


_BLANK = bytes(32 if _IS_MARK[i] else i for i in range(256))


@dataclass
class Machine:
    """slots: ascending; weights and factors in their order; bias: the prior's log-odds."""

    slots: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        if len(self.slots):
            lens = np.array([len(r) for r in rows])
            if lens.sum():
                flat = np.concatenate(rows)
                at = np.minimum(np.searchsorted(self.slots, flat), len(self.slots) - 1)
                known = self.slots[at] == flat
                doc = np.repeat(np.arange(len(rows)), lens)[known]
                out += self.logits(doc, at[known], len(rows))[0] - self.bias
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))

    def logits(self, doc: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of n documents and the sums of their factors; doc: ascending."""
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        own, v = doc[first], self.factors[at]
        linear, square, sums = np.zeros(n), np.zeros(n), np.zeros((n, v.shape[1]))
        if len(first):
            linear[own] = np.add.reduceat(self.weights[at], first)
            sums[own] = np.add.reduceat(v, first)
            square[own] = np.add.reduceat(np.einsum("ij,ij->i", v, v), first)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - square), sums


def _pieces(rows: list[np.ndarray], size: int = 1024):
    """(first row, values) of some rows at a time, as the driver's memory is small."""
    for a in range(0, len(rows), size):
        yield a, np.concatenate(rows[a : a + size])


def tally(rows: list[np.ndarray], m: int) -> np.ndarray:
    """How often the rows have each value below m."""
    out = np.zeros(m, np.int64)
    for _, values in _pieces(rows):
        out += np.bincount(values, minlength=m)
    return out


def _documents(rows: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    """The numbers of the rows that have each value, value by value."""
    out, at = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
    for a, values in _pieces(rows):
        row = np.repeat(np.arange(a, a + min(1024, len(rows) - a), dtype=np.int32), [len(r) for r in rows[a : a + 1024]])
        order = np.argsort(values, kind="stable")
        each = np.bincount(values, minlength=len(counts))
        rank = np.arange(len(values)) - np.repeat(np.cumsum(each) - each, each)
        out[at[values[order]] + rank] = row[order]
        at += each
    return out


def _divergence(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Kullback-Leibler divergence of shares q from s."""
    tiny = 1e-300
    return q * np.log(np.maximum(q, tiny) / np.maximum(s, tiny)) + (1 - q) * np.log(np.maximum(1 - q, tiny) / np.maximum(1 - s, tiny))


def beside(own: list[np.ndarray], labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Slots that tell toxic documents from others only together: a pair's share of toxic ones is neither slot's own.

    own: each document's slots, by number.  Every pair of a slot in `first` and any other is tallied.  A
    pair's c documents, t of them toxic, must stand out of the share s of either slot's by Chernoff's
    bound 2 exp(-c KL(t / c, s)), held under one over the number of pairs.  Neither needs to tell anything by itself.
    """
    m, out = len(first), np.zeros(len(first), bool)
    counts = tally(own, m)
    limit = np.log(2.0 * first.sum() * m) if first.any() else np.inf
    shares = tally([x for x, y in zip(own, labels, strict=True) if y], m) / np.maximum(counts, 1)
    doc, ends = _documents(own, counts), np.cumsum(counts)
    for i in np.flatnonzero(first):
        docs = doc[ends[i] - counts[i] : ends[i]]
        share = shares[i]
        most = -np.log(min(share, 1 - share)) if 0 < share < 1 else 0.0
        if len(docs) * most <= limit:  # no pair can stand out
            continue
        total = np.empty((2, m), np.int64)
        for kind in (0, 1):
            total[kind] = tally([own[d] for d in docs[labels[docs] == kind].tolist()], m)
        c = total[0] + total[1]
        used = np.flatnonzero(c * most > limit)
        c, q = c[used], total[1, used] / c[used]
        hit = used[(c * np.minimum(_divergence(q, share), _divergence(q, shares[used])) > limit) & (used != i)]
        out[hit] = True
        out[i] |= len(hit) > 0
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Machine:
    """AdaGrad on the logistic loss with weight decay; the rows' order is the given one, so a fit can be repeated."""
    n = len(rows)
    prior = (labels.sum() + 0.5) / (n + 1)
    machine = Machine(np.zeros(0, np.int32), float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, FACTORS)))
    if n == 0 or labels.min() == labels.max():
        return machine
    every = tally(rows, 1 << HASH_BITS)
    slots = np.flatnonzero(every >= MIN_DOCS)
    counts, toxic = every[slots], tally([r for r, y in zip(rows, labels, strict=True) if y], 1 << HASH_BITS)[slots]
    share = labels.mean()
    strong = np.abs(toxic - counts * share) >= SIGNAL * np.sqrt(counts * share * (1 - share))
    number = np.full(1 << HASH_BITS, -1, np.int32)
    number[slots] = np.arange(len(slots), dtype=np.int32)
    own = [n[n >= 0] for n in (number[r] for r in rows)]
    # Pairs of a strong slot and any other, and all pairs of words.
    word = np.flatnonzero(slots % 2 == 0)
    number = np.full(len(slots), -1, np.int32)
    number[word] = np.arange(len(word), dtype=np.int32)
    pairs = beside([n[n >= 0] for n in (number[x] for x in own)], labels, np.ones(len(word), bool))
    strong = strong | beside(own, labels, strong)
    strong[word[pairs]] = True
    slots = slots[strong]
    if not len(slots):
        return machine
    rng = np.random.default_rng(seed)
    machine.slots, machine.weights = slots, np.zeros(len(slots))
    machine.factors = rng.normal(0, 0.01, (len(slots), FACTORS))
    kept = np.full(len(strong), -1, np.int64)
    kept[strong] = np.arange(len(slots))
    own = [n[n >= 0] for n in (kept[x] for x in own)]
    gw, gv, gb = np.full(len(slots), 1e-2), np.full((len(slots), FACTORS), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            batch = order[a : a + BATCH]
            lens = np.array([len(own[i]) for i in batch])
            if not lens.sum():
                continue
            at = np.concatenate([own[i] for i in batch])
            doc = np.repeat(np.arange(len(batch)), lens)
            z, sums = machine.logits(doc, at, len(batch))
            error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[batch]) / len(batch)
            every = np.bincount(at, minlength=len(slots))
            used = np.flatnonzero(every)
            each = error[doc]
            dw = np.bincount(at, each, len(slots))[used] + DECAY * machine.weights[used]
            pull = (each[:, None] * (sums[doc] - machine.factors[at])).T.copy()
            dv = np.stack([np.bincount(at, p, len(slots))[used] for p in pull], 1) + DECAY * machine.factors[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += error.sum() ** 2
            machine.weights[used] -= RATE * dw / np.sqrt(gw[used])
            machine.factors[used] -= 0.5 * RATE * dv / np.sqrt(gv[used])
            machine.bias -= RATE * error.sum() / np.sqrt(gb)
    return machine


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Term slots and labels of the sample, in the order of the hash that chose it."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), packed(term_slots(texts))], ["doc_id", "toxic", "slots"])

    rows = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), run, "doc_id long, toxic int, slots binary")
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "slots").limit(sample).collect()
    return [np.frombuffer(r["slots"], np.int32) for r in found], np.array([r["toxic"] for r in found], np.float64)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.slots, machine.bias, machine.weights, machine.factors))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        own = Machine(*sent.value)
        for batch, texts in chunks(batches):
            score = own.score(term_slots(texts))
            yield record(schema, batch.column(0), batch.column(2), score, (score >= 0.5).astype(np.int32))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return mapped(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return scored(docs, fit(*training_rows(docs, labels, sample)))
