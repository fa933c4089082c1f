r"""Line dedup by an exact set-similarity join with prefix, positional and length filters.

A line is a \n-separated part of a text with a word; its tokens are its distinct
lower-cased words, as 64-bit hashes.  A line is removed if a line before it, by
(doc_id, line number) over the whole table, has a token set of Jaccard likeness of
at least the threshold; equal lines are the simplest case.

1.  One pass names every line by 128 bits of its token set and counts all words in
    2**COUNTER_BITS hashed counters (a table of fixed size), which order tokens by rarity: by
    counter, then by hash.  Lines of one token set become one *set* with its first place, its last and its copies.
2.  Every line sends its prefix - the rarest tokens, of which two lines that are
    similar enough must share one - to the groups of these tokens, in packed byte planes.  An entry
    has the set's name, its size, the token's position, the token before it and a parity bitmap of the set.
    Entries of one set and token are one.
3.  In a group, entries are sorted by size, so the length filter is a range.  A pair also has to pass the
    positional filter and the bitmap's upper bound of the overlap, and must not have the
    token before in common, as it then meets there.  Sets with such a partner are wanted in the group.
4.  Wanted sets come to their groups once each, with all tokens.  Overlaps are counted exactly, as bits over the
    group's tokens, and a pair counts in the group of its first common token only.  No pair
    leaves a task: what leaves is, for each set and task, the number of earlier sets it is
    linked with and the first document of them.
5.  A counter of more than HOT occurrences deals its groups in blocks of sets, block against block, so no
    task holds a group whole however common a token is.

Defined cases: null, empty and blank texts and lines have no tokens and are never removed; lines of rows
that repeat a doc_id take that id's place in the order, and two lines of one place
do not remove each other; a null doc_id comes first in the order; equal texts, repeated rows and ties
in rarity need no special care, as sets are compared and not lines; a very long text is worked
on whole, by itself; an empty table gives an empty result; other columns are ignored by `judged` and kept by
`deduplicated`, which brings an integer column n_chars in step with the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import Words, chunks, mapped, mix, partitions, small, stored

COUNTER_BITS = 17
#: Occurrences of a counter for each block that its tokens' groups are dealt in.
HOT = 4_000_000
#: Prefix entries a map task packs at a time.
PACK = 400_000
#: Pairs that are verified at a time.
PAIRS = 1 << 18
NO_ID = -(1 << 63)
_ORDER_BITS = 44
_U = np.uint64


class Lines:
    """The lines with a word of several texts: doc (index), number, and tokens [first[i]:first[i + 1]] in order of rarity.

    Tokens of one counter are ordered by hash, so tokens of the same upper 32 bits stand together.
    """

    def __init__(self, words: Words, rank: np.ndarray | None):
        breaks = np.flatnonzero(words.data == 10)
        line = np.searchsorted(breaks, words.start)  # by all line ends before it, those of earlier texts included
        h = words.hash
        order_bits = h >> _U(64 - _ORDER_BITS)
        if rank is not None:
            low = _U(_ORDER_BITS - COUNTER_BITS)
            order_bits = (rank[(h >> _U(64 - COUNTER_BITS)).astype(np.int64)].astype(np.uint64) << low) | (order_bits & ((_U(1) << low) - _U(1)))
        if len(breaks) < 1 << 20:
            at = np.argsort((line.astype(np.uint64) << _U(_ORDER_BITS)) | order_bits, kind="stable")
        else:
            at = np.lexsort((order_bits, line))
        h, line = h[at], line[at]
        # Equal words of a line are neighbours, as they have equal keys; a tie of others is broken by a second sort where it occurs.
        bits = order_bits[at]
        odd = np.flatnonzero((line[1:] == line[:-1]) & (bits[1:] == bits[:-1]) & (h[1:] != h[:-1]))
        if len(odd):
            at = np.lexsort((h, bits, line))
            h, line = h[at], line[at]
        new = np.ones(len(h), bool)
        new[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
        self.tokens, line = h[new], line[new]
        start = np.ones(len(line), bool)
        start[1:] = line[1:] != line[:-1]
        self.first = np.concatenate((np.flatnonzero(start), [len(line)]))
        at_line = line[self.first[:-1]]
        self.length = np.diff(self.first)
        ends = np.searchsorted(breaks, words.first[:-1])  # line ends before each text
        self.doc = np.searchsorted(ends, at_line, side="right") - 1
        self.number = at_line - ends[self.doc]
        mixed = mix(self.tokens)
        self.h1 = self.over(np.add, mixed)
        self.h2 = self.over(np.add, mix(mixed + _U(0x632BE59BD9B4E019)))

    def over(self, op: np.ufunc, values: np.ndarray) -> np.ndarray:
        """op over each line's values."""
        return op.reduceat(values, self.first[:-1]) if len(self.first) > 1 else np.zeros(0, np.uint64)


def needed(percent: int, a, b):
    """The least overlap of sets of a and b elements whose likeness is percent / 100 or more."""
    return -(-percent * (a + b) // (100 + percent))


def ranks(counts: np.ndarray) -> np.ndarray:
    """Each counter's place by rarity."""
    out = np.empty(len(counts), np.uint32)
    out[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint32)
    return out


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")


def _lines(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: a line (slot null), and a task's occurrences n of a counter."""
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("line", pa.int32())])

    def run(batches):
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch, texts in chunks(batches):
            words = Words(texts, lower=True)
            if not len(words.hash):
                continue
            total += np.bincount((words.hash >> _U(64 - COUNTER_BITS)).astype(np.int64), minlength=len(total))
            lines = Lines(words, None)
            n = len(lines.doc)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[lines.doc]
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in (lines.h1, lines.h2)), pa.array(ids), pa.array(lines.number.astype(np.int32))], schema=schema)
        used = np.flatnonzero(total)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used]), none, none, none, pa.nulls(len(used), pa.int32())], schema=schema)

    return mapped(_rows(docs), run, "slot int, n long, h1 long, h2 long, doc long, line int")


def _counts(lines: DataFrame) -> np.ndarray:
    out = np.zeros(1 << COUNTER_BITS, np.int64)
    rows = lines.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


# --------------------------------------------------------------------- entries

#: Fixed value: columns of an entry and their bytes: upper half of the token's hash, name of the set, size of the set,
#: position of the token, upper half of the token before it, parity bitmap, the two blocks that meet, and the set's own.
_WIDTHS = {"tok": 4, "cls": 8, "len": 4, "pos": 4, "prev": 4, "odd0": 8, "odd1": 8, "p": 2, "q": 2, "block": 2}


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, byte by byte: planes of zeros compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def prefix_entries(lines: Lines, blocks: np.ndarray, percent: int) -> list[np.ndarray]:
    """The columns of _WIDTHS of all lines' prefix entries; those of a counter of g blocks once for each block they meet."""
    prefix = lines.length + percent * -lines.length // 100 + 1
    own = np.repeat(np.arange(len(prefix)), prefix)
    pos = np.arange(len(own)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
    at = lines.first[:-1][own] + pos
    top = lines.tokens >> _U(32)
    bit = lines.tokens & _U(127)
    odd = [lines.over(np.bitwise_xor, np.where(bit >> _U(6) == w, _U(1) << (bit & _U(63)), _U(0))) for w in (0, 1)]
    g = blocks[(lines.tokens[at] >> _U(64 - COUNTER_BITS)).astype(np.int64)].astype(np.int64)
    block = (mix(lines.h1[own]) % g.astype(np.uint64)).astype(np.int64)
    if g.max(initial=1) > 1:
        again = np.repeat(np.arange(len(own)), g)
        other = np.arange(len(again)) - np.repeat(np.cumsum(g) - g, g)
        own, pos, at, block = own[again], pos[again], at[again], block[again]
    else:
        other = block
    cols = (top[at], lines.h1[own], lines.length[own], pos, np.where(pos > 0, top[np.maximum(at - 1, 0)], _U(0)), odd[0][own], odd[1][own], np.minimum(block, other), np.maximum(block, other), block)
    return [c.astype(np.uint64) for c in cols]


def _entries(docs: DataFrame, counts: np.ndarray, percent: int, buckets: int) -> DataFrame:
    """bucket, pack: the packed entries of a map task for each bucket of groups."""
    sent = docs.sparkSession.sparkContext.broadcast((ranks(counts), np.maximum(1, -(-counts // HOT)).astype(np.uint16)))
    schema = pa.schema([("bucket", pa.int32()), ("pack", pa.binary())])

    def packs(held):
        cols = dict(zip(_WIDTHS, (np.concatenate(x) for x in zip(*held, strict=True)), strict=True))
        bucket = mix(cols["tok"] + (cols["p"] << _U(32)) + (cols["q"] << _U(48))) % _U(buckets)
        at = np.lexsort((cols["cls"], cols["q"], cols["p"], (bucket << _U(32)) | cols["tok"]))
        at = at[_new(*(c[at] for c in (bucket, cols["tok"], cols["p"], cols["q"], cols["cls"])))]
        bucket = bucket[at]
        edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        full = np.flatnonzero(edges[1:] > edges[:-1])
        squeeze = zstandard.ZstdCompressor(level=1).compress
        body = [squeeze(b"".join(_planes(cols[c][at[edges[b] : edges[b + 1]]], w) for c, w in _WIDTHS.items())) for b in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(body, pa.binary())], schema=schema)

    def run(batches):
        rank, blocks = sent.value
        held, size = [], 0
        for _, texts in chunks(batches):
            lines = Lines(Words(texts, lower=True), rank)
            if not len(lines.doc):
                continue
            held.append(prefix_entries(lines, blocks, percent))
            size += len(held[-1][0])
            if size >= PACK:
                yield packs(held)
                held, size = [], 0
        if held:
            yield packs(held)

    return mapped(_rows(docs), run, "bucket int, pack binary")


class Bucket:
    """The entries of some groups (tok, p, q), one of each set, sorted by group and by size; groups of one entry are left out."""

    def __init__(self, packs: list[bytes]):
        row, parts = sum(_WIDTHS.values()), []
        for raw in map(zstandard.ZstdDecompressor().decompress, packs):
            n, at, part = len(raw) // row, 0, []
            for w in _WIDTHS.values():
                part.append(_from_planes(raw[at : at + n * w], w))
                at += n * w
            parts.append(part)
        cols = dict(zip(_WIDTHS, (np.concatenate(c) for c in zip(*parts, strict=True)), strict=True))
        at = np.lexsort((cols["cls"], cols["len"], cols["q"], cols["p"], cols["tok"]))
        key = [cols[c][at] for c in ("tok", "p", "q")]
        at = at[_new(*key, cols["cls"][at])]
        new = _new(*(cols[c][at] for c in ("tok", "p", "q"))) if len(at) else np.zeros(0, bool)
        alone = new & np.append(new[1:], True)
        at, new = at[~alone], new[~alone]
        self.cls, self.tok = cols["cls"][at], cols["tok"][at]
        self.p, self.q, self.block, self.size, self.pos = (cols[c][at].astype(np.int64) for c in ("p", "q", "block", "len", "pos"))
        self.prev, self.odd = cols["prev"][at], (cols["odd0"][at], cols["odd1"][at])
        self.group = np.cumsum(new) - 1

    def wanted(self, percent: int) -> np.ndarray:
        """Which entries have a partner that passes all filters."""
        hit = np.zeros(len(self.cls), bool)
        for i, j in partners(self, percent):
            first = (self.pos[i] == 0) | (self.pos[j] == 0) | (self.prev[i] != self.prev[j])
            i, j = i[first], j[first]
            apart = np.bitwise_count(self.odd[0][i] ^ self.odd[0][j]).astype(np.int64) + np.bitwise_count(self.odd[1][i] ^ self.odd[1][j])
            a, b = self.size[i], self.size[j]
            ok = a + b - apart >= 2 * needed(percent, a, b)
            hit[i[ok]] = True
            hit[j[ok]] = True
        return hit


def partners(rows, percent: int):
    """Pairs (i, j) of rows of one group that pass the length and positional filters, as arrays of at most about PAIRS pairs.

    rows: group, size (ascending in a group), pos, p, q, block.
    """
    n = len(rows.size)
    if not n:
        return
    base = int(rows.size.max()) + 1
    most = np.minimum(100 * rows.size // percent, base - 1)
    end = np.searchsorted(rows.group * base + rows.size, rows.group * base + most, side="right")
    live, step, held, total = np.arange(n), 1, [], 0
    while len(live := live[live + step < end[live]]):
        i, j = live, live + step
        a, b = rows.size[i], rows.size[j]
        ok = (np.minimum(a - rows.pos[i], b - rows.pos[j]) >= needed(percent, a, b)) & ((rows.p[i] == rows.q[i]) | (rows.block[i] != rows.block[j]))
        held.append((i[ok], j[ok]))
        total += len(held[-1][0])
        if total >= PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, total = [], 0
        step += 1
    if total:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _by_bucket(batches, columns: int):
    """The rows of each bucket (first column), which arrive sorted by it."""
    held, at = [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(columns)), strict=True):
            if row[0] != at:
                if held:
                    yield at, held
                held, at = [], row[0]
            held.append(row)
    if held:
        yield at, held


def _wanted(entries: DataFrame, percent: int) -> DataFrame:
    """bucket, tok, p, q, block, h1: the sets to be compared in each group."""
    schema = pa.schema([("bucket", pa.int32()), ("tok", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("block", pa.int32()), ("h1", pa.int64())])

    def run(batches):
        for bucket, rows in _by_bucket(batches, 2):
            b = Bucket([r[1] for r in rows])
            at = np.flatnonzero(b.wanted(percent))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), bucket, np.int32)), pa.array(b.tok[at].view(np.int64)), *(pa.array(x[at].astype(np.int32)) for x in (b.p, b.q, b.block)), pa.array(b.cls[at].view(np.int64))], schema=schema)

    return mapped(entries.repartition("bucket").sortWithinPartitions("bucket"), run, "bucket int, tok long, p int, q int, block int, h1 long")


# --------------------------------------------------------------------- verification


def _sets(docs: DataFrame, known: DataFrame, counts: np.ndarray) -> DataFrame:
    """h1, h2, tokens of the sets in known (h1, h2, doc, line), from the document of their first place; tokens in order of rarity."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks(counts))
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        for batch, texts in chunks(batches):
            picked = []
            for text, lines in zip(texts, batch.column(1).to_pylist(), strict=True):
                parts = text.split(b"\n")
                picked += [parts[n] for n in lines if n < len(parts)]
            lines = Lines(Words(picked, lower=True), sent.value)
            if len(lines.doc):
                sets = [lines.tokens[a:b].tobytes() for a, b in zip(lines.first, lines.first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(lines.h1.view(np.int64)), pa.array(lines.h2.view(np.int64)), pa.array(sets, pa.binary())], schema=schema)

    per_doc = stored(known.groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("lines")), "ld-places")
    found = mapped(_rows(docs).join(small(per_doc), "doc").select("text", "lines"), run, "h1 long, h2 long, tokens binary")
    # Rows that repeat a doc_id have other lines in these places, too.
    return found.join(small(known.select("h1", "h2")), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("tokens").alias("tokens"))


class Compared:
    """Rows (tok, p, q, block, set number) of a bucket's groups with all tokens of the sets, sorted by group and size."""

    def __init__(self, tok, p, q, block, number, sets: list[np.ndarray]):
        lens = np.array([len(s) for s in sets], np.int64)
        at = np.lexsort((number, lens[number], q, p, tok))
        self.tok, self.p, self.q, self.block, self.number = (x[at] for x in (tok, p, q, block, number))
        self.group = np.cumsum(_new(self.tok, self.p, self.q)) - 1
        self.size = lens[self.number]
        first = np.cumsum(self.size) - self.size
        flat = np.concatenate([sets[s] for s in self.number])
        row = np.repeat(np.arange(len(self.number)), self.size)
        place = np.arange(len(flat)) - first[row]
        self.pos = np.full(len(self.number), len(flat))
        np.minimum.at(self.pos, row, np.where(flat >> _U(32) == self.tok[row], place, len(flat)))
        self.bits = _Bits(self.group, row, flat)
        before = place < self.pos[row]
        self.before = _Bits(self.group, row[before], flat[before] >> _U(32))

    def links(self, percent: int):
        """Pairs of rows whose likeness is enough, each in the group of its first common token."""
        for i, j in partners(self, percent):
            first = self.before.common(i, j) == 0
            i, j = i[first], j[first]
            a, b = self.size[i], self.size[j]
            ok = self.bits.common(i, j) >= needed(percent, a, b)
            yield i[ok], j[ok]


class _Bits:
    """For each row a bit for each value that rows of its group share; values of one row only are left out."""

    def __init__(self, group: np.ndarray, row: np.ndarray, value: np.ndarray):
        of = group[row]
        at = np.lexsort((row, value, of))
        of, value, row = of[at], value[at], row[at]
        keep = _new(of, value, row) if len(row) else np.zeros(0, bool)  # a row has the upper half of two of its tokens once
        of, value, row = of[keep], value[keep], row[keep]
        new = _new(of, value) if len(row) else keep
        shared = ~(new & np.append(new[1:], True)) if len(row) else keep
        of, row, new = of[shared], row[shared], new[shared]
        groups = int(group.max()) + 1 if len(group) else 0
        column = np.cumsum(new) - 1
        start = np.concatenate(([0], np.cumsum(np.bincount(of[new], minlength=groups))))
        column = column - start[of]
        self.words = (-(-np.diff(start) // 64))[group]
        self.at = np.cumsum(self.words) - self.words
        self.bits = np.zeros(int(self.words.sum()), np.uint64)
        np.add.at(self.bits, self.at[row] + (column >> 6), _U(1) << (column & 63).astype(np.uint64))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, live, w = np.zeros(len(i), np.int64), np.arange(len(i)), 0
        while len(live := live[self.words[i[live]] > w]):
            out[live] += np.bitwise_count(self.bits[self.at[i[live]] + w] & self.bits[self.at[j[live]] + w])
            w += 1
        return out


_PLACE = pa.struct([("doc", pa.int64()), ("line", pa.int32())])
_LINKED = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("doc0", pa.int64()), ("later", pa.list_(_PLACE))])


def _linked(rows: DataFrame, percent: int, lists: bool) -> DataFrame:
    """h1, h2, n, doc0, later: of a set in a task, the number of sets with an earlier first place that it is linked with, the first
    document of these, and, with `lists`, the first places of others that stand before a copy of the set.

    rows: bucket, tok, p, q, block, h1, h2, doc, line, last (the set's last place, null without copies), tokens.
    """

    def solve(rows):
        number: dict[tuple, int] = {}
        of = np.array([number.setdefault((r[5], r[6]), len(number)) for r in rows], np.int64)
        one = {}
        for k, r in zip(of.tolist(), rows, strict=True):
            one.setdefault(k, r)
        names = list(number)
        sets = [np.frombuffer(one[k][10], np.uint64) for k in range(len(names))]
        doc, line = (np.array([one[k][c] for k in range(len(names))], np.int64) for c in (7, 8))
        place = np.empty(len(names), np.int64)  # places by number, equal ones alike
        order = np.lexsort((line, doc))
        place[order] = np.cumsum(_new(doc[order], line[order]))
        tok, p, q, block = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 3, 4))
        compared = Compared(tok.astype(np.uint64), p, q, block, of, sets)
        n, doc0 = np.zeros(len(names), np.int64), np.full(len(names), np.iinfo(np.int64).max)
        copied = np.array([one[k][9] is not None for k in range(len(names))])
        last_doc, last_line = (np.array([one[k][9][c] if one[k][9] else 0 for k in range(len(names))], np.int64) for c in ("doc", "line"))
        after: list[np.ndarray] = []
        for i, j in compared.links(percent):
            a, b = compared.number[i], compared.number[j]
            a, b = np.where(place[a] <= place[b], a, b), np.where(place[a] <= place[b], b, a)
            strict = place[a] < place[b]
            np.add.at(n, b[strict], 1)
            np.minimum.at(doc0, b[strict], doc[a[strict]])
            if lists:
                a, b = np.concatenate((a, b[~strict])), np.concatenate((b, a[~strict]))
                before = copied[a] & ((doc[b] < last_doc[a]) | ((doc[b] == last_doc[a]) & (line[b] < last_line[a])))
                after.append(np.stack((a[before], b[before])))
        a, b = np.concatenate(after, 1) if after else np.zeros((2, 0), np.int64)
        order = np.argsort(a, kind="stable")
        sizes, b = np.bincount(a, minlength=len(names)), b[order]
        out = np.flatnonzero((n > 0) | (sizes > 0))
        if len(out):
            ends = np.concatenate(([0], np.cumsum(sizes[out]))).astype(np.int32)
            places = pa.StructArray.from_arrays([pa.array(doc[b]), pa.array(line[b].astype(np.int32))], fields=list(_PLACE))
            columns = [pa.array([names[k][c] for k in out], pa.int64()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n[out]), pa.array(doc0[out], mask=n[out] == 0), pa.ListArray.from_arrays(ends, places, type=pa.list_(_PLACE))], schema=_LINKED)

    def run(batches):
        for _, held in _by_bucket(batches, 11):
            yield from solve(held)

    names = ["bucket", "tok", "p", "q", "block", "h1", "h2", "doc", "line", "last", "tokens"]
    return mapped(rows.select(*names).repartition("bucket").sortWithinPartitions("bucket"), run, "h1 long, h2 long, n long, doc0 long, later array<struct<doc:bigint,line:int>>")


def judged_lines(docs: DataFrame, threshold: float = 0.8, links: bool = True) -> DataFrame:
    """doc, line, doc0 (the document of the earliest line that removes it, null if it stays) and, with `links`, links (earlier distinct token sets, other than its own, that are alike)."""
    percent = round(100 * threshold)
    rows = stored(_lines(docs), "ld-lines")
    counts, lines = _counts(rows), rows.where("slot is null").select("h1", "h2", "doc", "line")
    place = F.struct("doc", "line")
    sets = lines.groupBy("h1", "h2").agg(F.min(place).alias("f"), F.max(place).alias("l"), F.count(F.lit(1)).alias("copies"))
    sets = stored(sets.select("h1", "h2", F.col("f.doc").alias("fdoc"), F.col("f.line").alias("fline"), F.when(F.col("copies") > 1, F.col("l")).alias("last")), "ld-first")
    wanted = stored(_wanted(_entries(docs, counts, percent, 2 * partitions(docs.sparkSession)), percent), "ld-wanted")
    known = sets.join(wanted.select("h1").distinct(), "h1", "left_semi").select("h1", "h2", F.col("fdoc").alias("doc"), F.col("fline").alias("line"), "last")
    known = stored(known, "ld-known")
    known = stored(known.join(_sets(docs, known, counts), ["h1", "h2"]), "ld-sets")
    found = stored(_linked(wanted.join(known, "h1"), percent, links), "ld-links")
    best = found.groupBy("h1", "h2").agg(F.min("doc0").alias("doc0"), F.sum("n").alias("n"))
    # Sets without copies and links say nothing of their lines.
    said = stored(sets.join(best, ["h1", "h2"], "left").where("last is not null or doc0 is not null"), "ld-said")
    copy = (F.col("doc") != F.col("fdoc")) | (F.col("line") != F.col("fline"))
    out = lines.join(said, ["h1", "h2"], "left").select("h1", "h2", "doc", "line", F.coalesce("doc0", F.when(copy, F.col("fdoc"))).alias("doc0"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(copy, F.lit(False)).alias("copy"))
    if not links:
        return out.select("doc", "line", "doc0")
    # A copy also comes after sets that are later than its own set's first line.
    later = found.where("size(later) > 0").select("h1", "h2", "later")
    since = out.where("copy").join(later, ["h1", "h2"]).select("doc", "line", F.lit(None).cast("long").alias("doc0"), F.size(F.filter("later", lambda x: x < place)).cast("long").alias("links"), F.lit(0).alias("one"))
    return out.select("doc", "line", "doc0", F.col("n").alias("links"), F.lit(1).alias("one")).unionByName(since)


def _per_document(docs: DataFrame, threshold: float, links: bool) -> DataFrame:
    gone = F.array_sort(F.collect_set(F.when(F.col("doc0").isNotNull(), F.col("line").cast("long")))).alias("removed")
    if not links:
        return judged_lines(docs, threshold, False).groupBy("doc").agg(F.count(F.lit(1)).alias("n_lines"), F.count("doc0").alias("n_removed"), gone)
    return judged_lines(docs, threshold).groupBy("doc").agg(F.sum("one").alias("n_lines"), F.count("doc0").alias("n_removed"), F.sum("links").alias("n_links"), F.min("doc0").alias("doc0"), gone)


def judged(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per row of docs (doc_id, text): n_lines, n_removed, n_links (pairs of a line and an earlier distinct set of other words that removes it), class_id, removed_lines.

    class_id is the smallest doc_id that holds a line which removes one of this document's, else its own; its own, too, where a line without doc_id is among these.
    """
    per_doc = _per_document(docs, threshold, True)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = ids.join(per_doc, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("doc"), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_lines", "n_removed", "n_links")]
    own = F.least(F.col("doc_id"), F.when(F.col("doc0") != NO_ID, F.col("doc0")))
    return out.select("doc_id", *zero, own.alias("class_id"), F.coalesce("removed", F.expr("cast(array() as array<long>)")).alias("removed_lines"))


def deduplicated(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents without their removed lines; those of which no word is left go. Columns are those of docs."""
    per_doc = stored(_per_document(docs, threshold, False).where("n_removed > 0").select(F.col("doc").alias("__ld_doc"), F.col("removed").alias("__ld_removed"), (F.col("n_removed") == F.col("n_lines")).alias("__ld_all")), "ld-removed")
    joined = docs.join(small(per_doc), F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col("__ld_doc"), "left")
    left = joined.where(~F.coalesce("__ld_all", F.lit(False)))
    numbered = F.filter(F.transform(F.split(docs["text"], "\n", -1), lambda x, i: F.when(~F.array_contains("__ld_removed", i.cast("long")), x)), lambda x: x.isNotNull())
    text = F.when(F.col("__ld_removed").isNull(), docs["text"]).otherwise(F.array_join(numbered, "\n"))
    kinds = dict(docs.dtypes)

    def column(c):
        if c == "text":
            return text.alias(c)
        if c == "n_chars" and kinds[c] in ("int", "bigint"):
            return F.when(F.col("__ld_removed").isNull(), docs[c]).otherwise(F.length(text).cast(kinds[c])).alias(c)
        return docs[c]

    return left.select(*(column(c) for c in docs.columns))
