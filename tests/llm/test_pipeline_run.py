"""run() of the corpus pipeline against a plain Python version of its five stages."""

import collections
import math
import random
import re

import duckdb

from quarrykit.llm import packing, quality
from quarrykit.llm import queries as llm

WORD = r"[^\x20\x09-\x0D]+"


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def fixture():
    """Prose of two sources, near and exact copies, shared lines, junk that the bands reject, and short or repetitive texts."""
    rng = random.Random(12)
    words = "the house stands near river where people walk every day and talk about weather money books trains music garden letters winter summer children school market bread water light stone paper window".split()
    line = lambda n: " ".join(rng.choices(words, k=n))
    bodies = ["\n".join(line(14) for _ in range(rng.randint(6, 12))) for _ in range(14)]
    shared = line(16)
    texts = [*bodies, bodies[0], bodies[1].upper(), bodies[2] + "\n" + shared, bodies[3] + "\n" + shared + "\n" + line(12)]
    for body in bodies[4:8]:
        w = body.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \n\t", line(20), "same words again " * 40, " ".join("".join(rng.choices("#@%^&*~|0123456789", k=12)) for _ in range(80))]
    return [(3 * i, t, ["en", None][i % 2], ["a", "b", None][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]


def good(text, lang):
    w = re.findall(WORD, text or "")
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j + k for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for k in range(3)}
    if len(w) < 50 or 100 * len(covered) > 50 * len(w):
        return False
    measures = []
    for coder in quality.vocabularies(quality.VOCABULARIES):
        tokens = [t for ts in coder.encode(w) for t in ts]
        n = len(tokens)
        entropy = -sum(c / n * math.log2(c / n) for c in collections.Counter(tokens).values())
        measures.append((sum(map(len, w)) / n, sum(bool(coder.partial[t]) for t in tokens) / n, entropy, n))
    return quality.within(quality.band_of(lang, text.encode()), *measures)


def brute(rows, tmp):
    docs = [r for r in rows if good(r[1], r[2])]
    seen, kept = [], []
    for i, t, lang, source, _ in docs:
        left = []
        for x in t.split("\n"):
            s = set(re.findall(WORD, low(x)))
            if not (s and any(5 * len(s & o) >= 4 * len(s | o) for o in seen)):
                left.append(x)
            if s:
                seen.append(s)
        if re.search(WORD, "\n".join(left)):
            kept.append((i, "\n".join(left), lang, source))
    sets, root = {}, {}
    for i, t, *_ in kept:
        w = re.findall(WORD, low(t))
        n = min(5, len(w))
        sets[i], root[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}, i

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    alone = [r for r in kept if find(r[0]) == r[0]]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", alone)
    copies = {r[0]: r[1] for r in c.sql(f"SELECT doc_id, copies FROM ({llm.oracle_sql()['op7_mixing']})").fetchall()}
    stages = [len(docs), len(kept), len(alone)]
    return stages, sorted((i, len(re.findall(WORD, t))) for i, t, *_ in alone for _ in range(copies[i]))


def least_padding(lengths, buckets):
    cells = sorted(collections.Counter(lengths).items())
    best = [0] + [math.inf] * len(cells)
    for _ in range(buckets):
        best = [min([best[j], *(best[i] + sum(n * (cells[j - 1][0] - a) for a, n in cells[i:j]) for i in range(j))]) for j in range(len(cells) + 1)]
    return best[-1]


def test_run_matches_plain_python(spark, tmp_path):
    import corpus_pipeline

    rows = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    stages, want = brute(rows, tmp_path)
    assert len(rows) > stages[0] > stages[1] >= stages[2] > 5 or len(rows) > stages[0] >= stages[1] > stages[2] > 5
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.length) for r in got) == want
    assert sum(r.padding for r in got) == least_padding([n for _, n in want], packing.BUCKETS)
    batches = collections.defaultdict(list)
    for r in got:
        assert r.length <= r.boundary and r.padding == r.boundary - r.length
        batches[r.batch].append(r)
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1 and (len(b) == 1 or len(b) * b[0].boundary <= packing.BUDGET) and sorted(r.slot for r in b) == list(range(len(b)))


def test_stages_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
