"""Registered queries over whole tables and whole texts, against brute force on a small fixture."""

import collections
import hashlib
import math
import random

import pytest

from quarrykit.plans import queries as plans


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdef", k=rng.randint(2, 6))) for _ in range(40)]
    return [(i, " ".join(rng.choices(words, k=rng.randint(1, 150)))) for i in range(1, 13)] + [(13, ""), (15, "zz " * 90 + "the answer is (C).")]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    docs = [(i, t, "en", "s0", len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "x common"), (2, "rare longishword")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def grams(t, k):
    w = t.split()
    return collections.Counter(" ".join(w[j : j + k]) for j in range(len(w) - k + 1))


def brute_cider(rows):
    refs = {i: [t, t[20:]] for i, t in rows}
    df = [collections.Counter(g for rs in refs.values() for g in set().union(*(grams(r, k) for r in rs))) for k in range(1, 5)]
    logn, out = math.log(len(rows)), {}
    for i, t in rows:
        total = 0.0
        for r in refs[i]:
            v = 0.0
            for k in range(1, 5):
                h, q = ({g: n * (logn - math.log(max(df[k - 1][g], 1))) for g, n in grams(x, k).items()} for x in (t, r))
                norm = math.sqrt(sum(x * x for x in h.values())) * math.sqrt(sum(x * x for x in q.values()))
                v += sum(min(h[g], q[g]) * q[g] for g in q if g in h) / (norm or 1)
            total += v / 4 * math.exp(-((sum(grams(t, 2).values()) - sum(grams(r, 2).values())) ** 2) / 72)
        out[i] = total / 2 * 10
    return out


def test_cider_of_whole_corpus(spark, folder, rows):
    got = {r.image: r.cider for r in plans.queries()["e20_cider"](spark, folder).collect()}
    want = brute_cider(rows)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=2e-5) for i in want)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_anls_of_whole_texts(spark, folder, tmp_path):
    texts = [(i, "".join(random.Random(i).choices("abc ", k=100))) for i in range(1, 9)] + [(9, "short é")]
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.anls for r in plans.queries()["x09_anls_whole"](spark, str(tmp_path)).collect()}
    for i, t in texts:
        a, b = t.strip(" ").lower(), t[i % 8 :].strip(" ").lower()
        s = 1 - edits(a, b) / max(len(a), len(b))
        assert got[i] == pytest.approx(s if s >= 0.5 else 0, abs=1e-6)


def test_parsed_choice_of_whole_text(spark, folder):
    got = {r.doc_id: r.letter for r in plans.queries()["e12_mmmu_parse"](spark, folder).collect()}
    assert got[15] == "C"


def test_captions_and_lexicon_are_whole(spark, folder, rows, tmp_path):
    uid = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    d = str(tmp_path)
    docs = [(1, "12 34 " * 20 + "word", "en", "s0", 9), (2, "12 34 " * 20, "en", "s0", 9), (3, "a longishword", "en", "s0", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "longishword")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = {r.uid: r.no_bad_pattern for r in plans.queries()["p10_p11_bad_patterns_whole"](spark, d).collect()}
    assert got == {uid(1): True, uid(2): False, uid(3): True}
    assert [r.uid for r in plans.queries()["p25_text_entity"](spark, d).collect()] == [uid(3)]
