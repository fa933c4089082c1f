"""Suffix-array dedup: every byte inside a LENGTH-byte string that also starts elsewhere is found.

A string that occurs twice has the same smallest GRAM-byte window hash in both
places.  Consecutive starts with the same smallest hash form a *group*; the hash is its key, and
equal strings always lie in groups of one key.  Keys of a single group are done.
The others' groups, as spans of bytes that hold all their strings, are collapsed to one of each distinct span
with its number of occurrences, and dealt to shards by key.

A shard's spans are one text.  Its suffix array is built by Larsson-Sadakane
refinement (ranks of 7 bytes, then doubling, sorting again only suffixes that still
tie), common prefixes of neighbours come from Kasai's algorithm, run for all spans in
step, and neighbours with LENGTH bytes in common mark both starts.  A key with more than
SHARD_SPANS spans is split over several shards; their sorted strings, named by
64-bit hashes within their key, are cut into ranges and merged by binary search range by range, so no
task grows with the number of spans of a key, and each shard is told once what it shares with others.

Defined cases: null text is empty; texts of fewer bytes than LENGTH have nothing to
remove; a very long text is worked on whole, by itself, and its groups are spread over shards like those of
other texts; ties need no order, as every start of a repeated string is marked; rows that repeat a doc_id are told apart by their texts, and equal rows repeat
each other; a null doc_id is kept as null; an empty table gives an empty result;
other columns are ignored by `spans` and `digests`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import chunks, mapped, mix, prefix_hash, small, span_hash, stored

LENGTH = 400
GRAM = 32
#: Starts that a group holds at most.
GROUP_STARTS = 512
#: Spans of one key in a shard.
SHARD_SPANS = 1024
#: Bytes of a shard; keys are packed together up to it.
SHARD_BYTES = 2 << 20
NO_ID = -(1 << 63)
_ID = ["id", "tag"]


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    out, step = values, 1
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def groups_of(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """doc (index), first start, number of starts, key, two content hashes, and whether the key's window occurs twice within."""
    lens = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(lens) - lens
    data = np.frombuffer(b"".join(texts), np.uint8)
    width = length - GRAM + 1
    if len(data) < length or lens.max() < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64, bool))
    sums = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = span_hash(sums, at, at + GRAM)
    least = _window_minimum(grams, width)
    starts = np.maximum(lens - length + 1, 0)
    doc = np.repeat(np.arange(len(lens)), starts)
    pos = np.repeat(first - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
    value = least[pos]
    new = np.ones(len(pos), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(pos)))
    if run.max() > GROUP_STARTS:
        inside = np.arange(len(pos)) - np.repeat(begin, run)
        new |= inside % GROUP_STARTS == 0
        begin = np.flatnonzero(new)
        run = np.diff(np.append(begin, len(pos)))
    s, own = pos[begin], doc[begin]
    key = value[begin]
    e = s + run - 1
    twice = np.zeros(len(s), bool)
    span = np.arange(width)
    for a in range(0, len(s), 2048):
        part = slice(a, a + 2048)
        left = (grams[s[part, None] + span] == key[part, None]).argmax(1) + s[part]
        right = e[part] + width - 1 - (grams[e[part, None] + span[::-1]] == key[part, None]).argmax(1)
        twice[part] = left != right
    c1 = span_hash(sums, s, e + length)
    half = (s + e + length) // 2
    c2 = mix(span_hash(sums, s, half) * np.uint64(0x9E3779B97F4A7C55) + span_hash(sums, half, e + length))
    return own, s - first[own], run, key, c1, c2, twice


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of symbols below 512, and each position's seven symbols as one number."""
    n = len(symbols)
    padded = np.concatenate((symbols.astype(np.uint64), np.zeros(7, np.uint64)))
    sevens = np.zeros(n, np.uint64)
    for j in range(7):
        sevens = (sevens << np.uint64(9)) | padded[j : j + n]
    sa = np.argsort(sevens)
    ordered = sevens[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = at
    tied = _shared(new)
    h = 7
    while len(tied):
        pos = sa[tied]
        after = pos + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        both = (rank[pos] << 32) | second
        order = np.argsort(both)
        pos, both = pos[order], both[order]
        sa[tied] = pos
        new = np.ones(len(tied), bool)
        new[1:] = both[1:] != both[:-1]
        rank[pos] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[_shared(new)]
        h *= 2
    return sa, sevens


def _shared(new: np.ndarray) -> np.ndarray:
    """Indices that share their group with another, given where groups begin."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    return np.flatnonzero(~alone)


def common_prefixes(sa: np.ndarray, sevens: np.ndarray, begin: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Kasai's common prefix, up to `most`, of each start with its predecessor in the suffix array; 0 at other positions.

    begin, starts: of each span its first position and its number of starts.  The
    spans advance together, each carrying its own prefix length from start to start.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int32)
    order = np.argsort(-starts, kind="stable")
    begin, starts = begin[order], starts[order]
    carried = np.zeros(len(begin), np.int64)
    active = np.searchsorted(-starts, -np.arange(1, int(starts.max()) + 1), side="right")
    shifts = np.arange(54, -1, -9, dtype=np.uint64)
    for t, a in enumerate(active.tolist()):
        i = begin[:a] + t
        j = before[i]
        h = np.maximum(carried[:a] - 1, 0)
        h[j < 0] = 0
        go = np.flatnonzero((j >= 0) & (h < most))
        while len(go):
            at, other = i[go] + h[go], j[go] + h[go]
            ok = other < n
            differ = np.where(ok, sevens[at] ^ sevens[np.minimum(other, n - 1)], np.uint64(1 << 62))
            same = differ == 0
            ends = go[~same]
            if len(ends):
                h[ends] += ((differ[~same][:, None] >> shifts) == 0).sum(1)
            go = go[same]
            h[go] += 7
            go = go[h[go] < most]
        h = np.minimum(h, most)
        carried[:a] = h
        out[i] = h
    return out


def repeated_starts(spans: list[bytes], starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of all spans' starts, one after the other, those whose string also starts elsewhere in the spans."""
    lens = np.array([len(s) + 1 for s in spans], np.int64)
    begin = np.cumsum(lens) - lens
    text = np.frombuffer(b"\0".join(spans) + b"\0", np.uint8).astype(np.uint16) + 1
    text[begin + lens - 1] = 0
    sa, sevens = suffix_array(text)
    prefix = common_prefixes(sa, sevens, begin, starts, length)
    hit = np.flatnonzero(prefix[sa] >= length)
    found = np.zeros(len(text), bool)
    found[sa[hit]] = True
    found[sa[hit - 1]] = True
    at = np.repeat(begin - (np.cumsum(starts) - starts), starts) + np.arange(int(starts.sum()))
    return found[at]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


# --------------------------------------------------------------------- Spark side


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("tag"), "text")


def _groups(rows: DataFrame, length: int) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("twice", pa.bool_())])

    def run(batches):
        for batch, texts in chunks(batches):
            own, s, n, key, c1, c2, twice = groups_of(texts, length)
            if len(own):
                ids, tags = (batch.column(c).to_numpy(zero_copy_only=False)[own] for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, tags, s)] + [pa.array(n.astype(np.int32))] + [pa.array(x.view(np.int64)) for x in (key, c1, c2)] + [pa.array(twice)], schema=schema)

    return mapped(rows.select("id", "tag", "text"), run, "id long, tag long, s long, n int, key long, c1 long, c2 long, twice boolean")


def _span_bytes(rows: DataFrame, distinct: DataFrame, length: int) -> DataFrame:
    """key, sub, c1, c2, many, starts, bytes of each distinct span, cut from the document that was named for it."""
    listed = distinct.groupBy("id", "tag").agg(F.collect_list(F.struct("key", "sub", "c1", "c2", "many", "s", "n")).alias("spans"))
    listed = stored(listed, "sx-named")
    names = ["key", "sub", "c1", "c2", "many", "n"]
    schema = pa.schema([("key", pa.int64()), ("sub", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("many", pa.bool_()), ("n", pa.int32()), ("bytes", pa.binary())])

    def run(batches):
        for batch, texts in chunks(batches):
            out = [(*(x[c] for c in names), text[x["s"] : x["s"] + x["n"] + length - 1]) for text, spans in zip(texts, batch.column(1).to_pylist(), strict=True) for x in spans]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    # Not broadcast, however few spans there are: texts are dealt by a shuffle at every size.
    joined = rows.join(listed, _ID).select("text", "spans")
    return mapped(joined, run, "key long, sub long, c1 long, c2 long, many boolean, n int, bytes binary")


def _shards(spans: DataFrame, length: int) -> DataFrame:
    """key, sub, c1, c2, runs (of starts that repeat inside the shard)."""
    schema = pa.schema([("key", pa.int64()), ("sub", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64())))])

    def solve(rows):
        starts = np.array([r[5] for r in rows], np.int64)
        flags = repeated_starts([r[6] for r in rows], starts, length)
        edges = np.concatenate(([0], np.cumsum(starts)))
        out = [(r[0], r[1], r[2], r[3], [[0, int(r[5]) - 1]] if r[4] else _runs(flags[a:b])) for r, a, b in zip(rows, edges[:-1], edges[1:], strict=True)]
        out = [x for x in out if x[4]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if row[:4] == last:  # equal rows of the table name their span twice
                    continue
                if held and row[:2] != last[:2] and size >= SHARD_BYTES:
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6]) + 1
                last = row[:4]
        if held:
            yield from solve(held)

    return mapped(spans.repartition("key", "sub").sortWithinPartitions("key", "sub", "c1", "c2"), run, "key long, sub long, c1 long, c2 long, runs array<array<bigint>>")


def string_names(span: bytes, starts: int, length: int) -> np.ndarray:
    at = np.arange(starts)
    return span_hash(prefix_hash(np.frombuffer(span, np.uint8)), at, at + length)


def _merged(spans: DataFrame, length: int) -> DataFrame:
    """key, c1, c2, runs of starts whose string also stands in another shard of the key. spans: those of split keys, with `subs`.

    Every shard's sorted names are cut, by binary search, into as many ranges as the key has shards.
    """
    cut = pa.schema([("key", pa.int64()), ("range", pa.int64()), ("sub", pa.int64()), ("names", pa.binary())])

    def cuts(batches):
        held, last, subs = [], None, 1

        def flush():
            names = np.unique(np.concatenate(held))
            edges = np.searchsorted(names, np.arange(1, subs, dtype=np.uint64) * np.uint64((1 << 64) // subs))
            parts = np.split(names, edges)
            yield pa.RecordBatch.from_arrays([pa.array([last[0]] * subs), pa.array(range(subs), pa.int64()), pa.array([last[1]] * subs), pa.array([p.tobytes() for p in parts], pa.binary())], schema=cut)

        for batch in batches:
            for key, sub, many, n, raw, parts in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if (key, sub) != last and held:
                    yield from flush()
                    held = []
                last, subs = (key, sub), parts
                held.append(string_names(raw, n, length))
        if held:
            yield from flush()

    def hits(batches):
        held, last = [], None

        def flush():
            arrays = [np.frombuffer(x[1], np.uint64) for x in held]
            found = [np.zeros(len(a), bool) for a in arrays]
            union = np.zeros(0, np.uint64)
            for k, a in enumerate(arrays):  # each against the union of those before, then backwards
                at = np.searchsorted(union, a)
                found[k] |= (at < len(union)) & (union[np.minimum(at, max(len(union) - 1, 0))] == a) if len(union) else False
                union = np.union1d(union, a)
            repeated = np.unique(np.concatenate([a[f] for a, f in zip(arrays, found, strict=True)]))
            out = []
            for (sub, _), a in zip(held, arrays, strict=True):
                at = np.searchsorted(repeated, a)
                own = a[(at < len(repeated)) & (repeated[np.minimum(at, len(repeated) - 1)] == a)] if len(repeated) else a[:0]
                if len(own):
                    out.append((last[0], sub, own.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], ["key", "sub", "hit"])

        for batch in batches:
            for key, part, sub, names in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if (key, part) != last and held:
                    yield from flush()
                    held = []
                last = (key, part)
                held.append((sub, names))
        if held:
            yield from flush()

    def marks(batches):
        schema = pa.schema([("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64())))])
        at, held, known = None, [], np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for key, sub, kind, c1, c2, n, raw in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if (key, sub) != at:
                    at, held, known = (key, sub), [], np.zeros(0, np.uint64)
                if kind == 0:  # the shard's repeated names come before its spans, range by range
                    held.append(np.frombuffer(raw, np.uint64))
                    continue
                if held:
                    known, held = np.sort(np.concatenate(held)), []
                if len(known):
                    names = string_names(raw, n, length)
                    runs = _runs(known[np.minimum(np.searchsorted(known, names), len(known) - 1)] == names)
                    if runs:
                        out.append((key, c1, c2, runs))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    shards = spans.select("key", "sub", "many", "n", "bytes", "subs").repartition("key", "sub").sortWithinPartitions("key", "sub")
    ranges = mapped(shards, cuts, "key long, range long, sub long, names binary").repartition("key", "range").sortWithinPartitions("key", "range")
    found = stored(mapped(ranges, hits, "key long, sub long, hit binary"), "sx-hits")
    none = F.lit(None).cast("long")
    names = found.select("key", "sub", F.lit(0).alias("kind"), none.alias("c1"), none.alias("c2"), F.lit(None).cast("int").alias("n"), F.col("hit").alias("bytes"))
    # Spans that occur more than once are covered whole already.
    rest = spans.where("not many").select("key", "sub", F.lit(1).alias("kind"), "c1", "c2", "n", "bytes")
    return mapped(names.unionByName(rest).repartition("key", "sub").sortWithinPartitions("key", "sub", "kind"), marks, "key long, c1 long, c2 long, runs array<array<bigint>>")


def merged_ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching ranges as one, ascending."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    return starts[new], ends[np.append(new[1:], True)]


def _per_text(hits: DataFrame, length: int) -> DataFrame:
    """hits (id, tag, s, runs), runs of starts that count from s -> id, tag, spans."""
    kind = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("spans", pa.list_(kind))])

    def run(batches):
        for batch in batches:
            bounds, edges = [], [0]
            for text in batch.column(2).to_pylist():
                rows = np.array([(g["s"] + a, g["s"] + b + length) for g in text for a, b in g["runs"]], np.int64)
                bounds.append(np.stack(merged_ranges(rows[:, 0], rows[:, 1])))
                edges.append(edges[-1] + bounds[-1].shape[1])
            if bounds:
                every = np.concatenate(bounds, 1)
                ranges = pa.StructArray.from_arrays([pa.array(every[0]), pa.array(every[1])], fields=list(kind))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), ranges, type=schema.field(2).type)], schema=schema)

    grouped = hits.groupBy("id", "tag").agg(F.collect_set(F.struct("s", "runs")).alias("found"))
    return mapped(grouped, run, "id long, tag long, spans array<struct<a:bigint,b:bigint>>")


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, tag, spans: the byte ranges [from, to) to remove, merged and ascending, of each text that has some."""
    rows = _identified(docs)
    groups = stored(_groups(rows, length), "sx-groups")
    keys = groups.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max("twice").alias("t")).where("k > 1 or t").select("key")
    found = stored(groups.join(keys, "key"), "sx-found")
    distinct = found.groupBy("key", "c1", "c2").agg(F.min(F.struct("id", "tag", "s", "n")).alias("f"), (F.count(F.lit(1)) > 1).alias("many"), F.max("twice").alias("twice"))
    distinct = stored(distinct.select("key", "c1", "c2", "many", "twice", "f.*"), "sx-distinct")
    per_key = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max("twice").alias("t")).withColumn("subs", F.ceil(F.col("k") / SHARD_SPANS))
    per_key = per_key.where("k > 1 or t").select("key", "subs")
    # One distinct span that occurs more than once covers itself; all others are compared.
    compared = distinct.join(per_key, "key").withColumn("sub", F.pmod(F.xxhash64("c1", "c2"), F.col("subs")))
    cut = stored(_span_bytes(rows, compared, length), "sx-bytes")
    local = stored(_shards(cut, length), "sx-local")
    split = per_key.where("subs > 1")
    across = _merged(cut.join(split, "key"), length)
    alone = distinct.where("many").join(per_key, "key", "left_anti").select("key", "c1", "c2", F.array(F.array(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"))).alias("runs"))
    results = local.select("key", "c1", "c2", "runs").unionByName(across).unionByName(alone)
    results = stored(results.groupBy("key", "c1", "c2").agg(F.flatten(F.collect_list("runs")).alias("runs")), "sx-runs")
    return stored(_per_text(found.join(results, ["key", "c1", "c2"]).select("id", "tag", "s", "runs"), length), "sx-spans")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch, texts in chunks(batches):
            out = []
            for text, ranges in zip(texts, batch.column(2).to_pylist(), strict=True):
                kept, at, removed = hashlib.sha256(), 0, 0
                for r in ranges or []:
                    kept.update(text[at : r["a"]])
                    removed += r["b"] - r["a"]
                    at = r["b"]
                kept.update(text[at:])
                out.append((len(text), removed, len(ranges or []), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[1:], strict=True))], schema=schema)

    found = small(spans(docs, length))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("tag"))
    return mapped(rows.join(found, _ID, "left").select("doc_id", "text", "spans"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
