"""All links and the class of op4_linedup against brute force."""

import random

import numpy as np
import pytest
import zstandard

from quarrykit.llm import linedup


def brute(rows):
    """doc_id -> (n_lines, n_removed, n_links, class_id, removed_lines); a null id comes first."""
    places = sorted((-(1 << 63) if i is None else i, n, frozenset(x.lower().split())) for i, t in rows for n, x in enumerate((t or "").split("\n")))
    out = {}
    for i, n, s in places:
        o = out.setdefault(i, [0, 0, 0, i, []])
        if not s:
            continue
        before = [(d, w) for d, m, w in places if (d, m) < (i, n) and w and 5 * len(s & w) >= 4 * len(s | w)]
        o[0] += 1
        o[2] += len({w for _, w in before if w != s})
        if before:
            o[1] += 1
            o[3] = min([o[3], *(d for d, _ in before)])
            o[4].append(n)
    return {i: (*o[:3], i if o[3] == -(1 << 63) else o[3], o[4]) for i, o in out.items()}  # null has no class to give


def family(seed):
    """Near copies of a few lines, exact ones among them, in an order that mixes them."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    bases, texts = [rng.sample(words, 14) for _ in range(3)], []
    for _ in range(40):
        lines = []
        for _ in range(rng.randint(1, 3)):
            b = list(rng.choice(bases))
            for _ in range(rng.randint(0, 2)):
                b[rng.randrange(len(b))] = rng.choice(words)
            lines.append(" ".join(b))
        texts.append("\n".join(lines))
    return [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (None, texts[5]), (102, texts[3].upper())]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_class(spark, seed):
    rows = family(seed)
    want = brute(rows)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_links, r.class_id, r.removed_lines) for r in linedup.judged(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, _ in rows:
        w = want[-(1 << 63) if i is None else i]
        assert got[i][:3] == w[:3] and got[i][4] == w[4]
        assert i is None or got[i][3] == w[3]


def test_sets_that_agree_in_40_bits_are_two():
    values = {"tok": [7, 7], "cls": [5, 5 + (1 << 40)], "len": [3, 3]}
    raw = b"".join(linedup._planes(np.array(values.get(c, [0, 0]), np.uint64), w) for c, w in linedup._WIDTHS.items())
    assert len(linedup.Bucket([zstandard.ZstdCompressor().compress(raw)]).tok) == 2


def test_blocks_of_hot_tokens(spark, monkeypatch):
    """Groups dealt in many blocks, block against block, give the same links."""
    rows = family(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(map(repr, linedup.judged(docs).collect()))
    monkeypatch.setattr(linedup, "HOT", 9)
    monkeypatch.setattr(linedup, "PAIRS", 50)
    assert sorted(map(repr, linedup.judged(docs).collect())) == want


def test_repeated_ids(spark):
    """Rows of one doc_id with other texts, and rows that are there twice: lines of one place do not remove each other."""
    rows = [(1, "a b c d e f g h i j\nk"), (1, "a b c d e f g h i z\nk"), (1, "a b c d e f g h i z\nk"), (2, "a b c d e f g h i y"), (3, "a b c d e f g h i z\na b c d e f g h i j")]
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.n_links, r.class_id) for r in linedup.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 6, 0, 0, 1)] * 3 + [(2, 1, 1, 2, 1), (3, 2, 2, 4, 1)]
