"""MinHash near-dedup: universal hash minima, banding, signature check, full-set check, components.

1.  Every text becomes a set of 64-bit word-shingle hashes, PERMUTATIONS minima of
    universal hashes a*x + b, and BANDS band keys of ROWS minima each.  A pair at the
    threshold of 0.8 meets in a band with probability 1 - (1 - 0.8**6)**40 > 0.99999.
2.  Texts with equal sets are one class, represented by the smallest doc_id.
3.  In each band bucket every class is compared with the bucket's leader only; a pair
    must pass the signature check and then the exact check on full sets.
4.  Buckets whose members still lie in different components are compared in full,
    across components only, in blocks of bounded size: signatures first, then, of those
    that agree, full sets.  A bucket gives the links that join its components, and components
    are formed again; members of one component need no further comparison, so no
    link that joins components is lost.

Defined cases: null, empty and blank texts have empty sets and are linked with
nothing; a text of fewer words than a shingle is one shingle; equal texts are one
class whatever their number; rows that repeat a doc_id are rows of their own with
that id; a null doc_id can't name a class and stays alone (component null); an empty
table gives an empty result; other columns are ignored by `clustered` and kept by
`deduplicated`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import Words, chunks, digest, mapped, mix, packed, record, shingles, small, stored
from quarrykit.llm.components import components

BANDS, ROWS = 40, 6
PERMUTATIONS = BANDS * ROWS
#: Estimated likeness below the threshold that the signature check still lets through: over four standard errors.
MARGIN = 0.11
#: Rows of a bucket that are compared with each other in one piece.
BLOCK = 2048

_seeds = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A = (_seeds[:PERMUTATIONS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_seeds[PERMUTATIONS:] >> np.uint64(32)).astype(np.uint32)
_FP = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


def minima(values: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash over a non-empty set of 64-bit hashes."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    step = 4096
    for a in range(0, len(x), step):
        part = x[None, a : a + step]
        for p in range(0, PERMUTATIONS, 16):
            out[p : p + 16] = np.minimum(out[p : p + 16], (_A[p : p + 16, None] * part + _B[p : p + 16, None]).min(1))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, PERMUTATIONS) minima -> (n, BANDS) keys; a key holds its band's number."""
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C55) + sig[:, r::ROWS].astype(np.uint64))
    return key.view(np.int64)


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch, texts in chunks(batches):
            words = Words(texts, lower=True)
            n, h1, h2, sigs = [], [], [], np.zeros((len(texts), PERMUTATIONS), np.uint32)
            for i in range(len(texts)):
                own = shingles(words.hash[words.bounds[i] : words.bounds[i + 1]], k)
                n.append(len(own))
                a, b = digest(own)
                h1.append(a)
                h2.append(b)
                if len(own):
                    sigs[i] = minima(own)
            keys = band_keys(sigs)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield record(_FP, batch.column(0), n, h1, h2, bands, packed(list((sigs & np.uint32(255)).astype(np.uint8))))

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sig binary")


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Signature check of rows of 8-bit minima; one in 256 agrees by chance."""
    agree = (a == b).mean(-1)
    return (agree - 1 / 256) / (1 - 1 / 256) >= threshold - MARGIN


def _screened(pairs: DataFrame, threshold: float) -> DataFrame:
    """(u, v, su, sv) -> the (u, v) whose signatures agree."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, PERMUTATIONS) for i in (2, 3))
            keep = pa.array(alike(a, b, threshold))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["u", "v"])

    return mapped(pairs.select("u", "v", "su", "sv"), run, "u long, v long")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(node, set) of the classes named in ids; the rows of repeated ids must be told apart by their digest."""

    def run(batches):
        schema = pa.schema([("node", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("set", pa.binary())])
        for batch, texts in chunks(batches):
            words = Words(texts, lower=True)
            own = [shingles(words.hash[words.bounds[i] : words.bounds[i + 1]], k) for i in range(len(texts))]
            h = [digest(x) for x in own]
            yield record(schema, batch.column(0), [x[0] for x in h], [x[1] for x in h], packed(own))

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(ids.select(F.col("node").alias("doc_id")).distinct()), "doc_id", "left_semi")
    found = mapped(named, run, "node long, h1 long, h2 long, set binary")
    return found.join(small(ids), ["node", "h1", "h2"], "left_semi").groupBy("node").agg(F.first("set").alias("set"))


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (u, v) of classes whose full sets have at least the threshold in common."""
    percent = round(100 * threshold)

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                n = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * n >= percent * (len(a) + len(b) - n))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["u", "v"])

    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    ids = stored(classes.select("node", "h1", "h2").join(nodes, "node", "left_semi"), "mh-ids")
    sets = stored(_sets(docs, ids, k), "mh-sets")
    left, right = (sets.select(F.col("node").alias(x), F.col("set").alias(f"s{x}")) for x in ("u", "v"))
    return stored(mapped(pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv"), run, "u long, v long"), "mh-links")


def _across(members: DataFrame, threshold: float, exact: bool) -> DataFrame:
    """Compares the members of each bucket across components: (key, band, g, node, component, bands, sig[, set]).

    Not exact: (key, node) of the members whose signature agrees with that of another
    component's member.  Exact: links (u, v) that join components, as many a bucket as it takes
    to join them, at most one less than it has members.  A pair is compared in its first common
    band only.  A bucket of g blocks is compared block against block, so no task holds more than two.
    """
    percent = round(100 * threshold)
    block = F.pmod(F.xxhash64("node", F.lit(7)), F.col("g"))
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    names = ["node", "component", "block", "band", "bands", "sig", *(["set"] if exact else [])]
    dealt = dealt.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), *names)

    def partners(rows):
        comp, block = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
        bands = np.array([r[4] for r in rows], np.int64)[:, : rows[0][3] + 1]
        sig = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(-1, PERMUTATIONS)
        apart = rows[0][2] != rows[-1][2] or len(set(block.tolist())) > 1  # two blocks: pairs inside one meet in its own piece
        for i in range(len(rows) - 1):
            j = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
            if apart:
                j = j[block[j] != block[i]]
            j = j[(bands[j] == bands[i]).argmax(1) == bands.shape[1] - 1] if len(j) else j
            if len(j):
                j = j[alike(sig[j], sig[i], threshold)]
            if len(j):
                yield i, j

    def near(key, rows):
        hit = np.zeros(len(rows), bool)
        for i, j in partners(rows):
            hit[i] = True
            hit[j] = True
        return [(key, rows[i][0]) for i in np.flatnonzero(hit)]

    def joining(_, rows):
        root, out = {r[1]: r[1] for r in rows}, []
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, js in partners(rows):
            for j in js.tolist():
                u, v = find(rows[i][1]), find(rows[j][1])
                if u == v:
                    continue
                a, b = sets[i], sets[j]
                n = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                if 100 * n >= percent * (len(a) + len(b) - n):
                    root[max(u, v)] = min(u, v)
                    out.append((min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])))
        return out

    solve, out = (joining, ["u", "v"]) if exact else (near, ["key", "node"])

    def run(batches):
        held, at = [], None

        def flush():
            found = solve(at[0], held) if len(held) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[x] for f in found], pa.int64()) for x in (0, 1)], out)

        for batch in (b.slice(a, 256) for b in batches for a in range(0, b.num_rows, 256)):
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for key, p, q, *row in zip(*cols, strict=True):
                if (key, p, q) != at:
                    yield from flush()
                    held, at = [], (key, p, q)
                held.append(row)
        yield from flush()

    return mapped(dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q"), run, f"{out[0]} long, {out[1]} long").distinct()


def clustered(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, h1, h2 of every row of docs (doc_id, text)."""
    fp = stored(fingerprints(docs, k), "mh-fp")
    full = fp.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "mh-classes")
    # Two classes share a node only if rows repeat a doc_id with different texts; linking them is then what that id says.
    keys = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1")
    members = stored(keys.join(buckets, "key").select("key", "band", "node", "n", "leader"), "mh-buckets")
    star = members.where("node <> leader").select(F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v")).distinct()
    sigs = classes.groupBy("node").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    left, right = (sigs.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}")) for x in ("u", "v"))
    pairs = stored(_screened(star.join(left, "u").join(right, "v"), threshold), "mh-pairs")
    links = _verified(docs, pairs, classes, k, threshold)
    comp = stored(components(links), "mh-components")
    placed = members.join(comp, "node", "left").select("key", "band", "node", "n", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    rest = placed.join(split, "key").join(sigs, "node").select("key", "band", F.ceil(F.col("n") / BLOCK).alias("g"), "node", "component", "bands", "sig")
    rest = stored(rest, "mh-rest")
    near = stored(_across(rest, threshold, exact=False), "mh-near")
    if not near.isEmpty():
        ids = stored(classes.select("node", "h1", "h2").join(near.select("node").distinct(), "node", "left_semi"), "mh-ids")
        full_rows = rest.join(near, ["key", "node"], "left_semi").join(stored(_sets(docs, ids, k), "mh-sets"), "node")
        more = stored(_across(full_rows, threshold, exact=True), "mh-links")
        comp = stored(components(links.unionByName(more)), "mh-components")
    named = classes.select("h1", "h2", "node").join(comp, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("c"))
    out = fp.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "h1", "h2").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents without those that are linked to one of a smaller doc_id; columns are those of docs."""
    gone = clustered(docs, k, threshold).where(~F.col("kept")).select(F.col("doc_id").alias("__mh_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("__mh_id"), "left_anti")
