"""Traps and exact small cases of operators that SQL can't express."""

import io
import random
import re
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.functions import answers, boxes, scores, text
from quarrykit.operators import batching, filters, packing
from quarrykit.sources import files


def column(spark, expr, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_score_parse(spark):
    values = ["85", "85,", "85\nbecause", ";90;,", "85.0", "1_0", " +7 ", "", None, "x"]
    assert column(spark, scores.score_value, values) == [85, 85, 85, 90, None, 10, 7, None, None, None]
    assert column(spark, scores.as_integer, ["85,", "85\nx"]) == [None, None]


def test_bad_patterns(spark):
    values = ["menu", "img_0012.jpg", "DSC_0001 sunset.jpeg", "e4yf 4a68", "a nice dog", "ii iv", "sd345"]
    assert column(spark, text.no_bad_pattern, values) == [False, False, True, False, True, False, False]
    assert column(spark, text.no_bad_prefix, ["IMG_x", "photo_12", "photo_12a", "http://a.b", "hello"]) == [False, False, True, False, True]


def test_vqa_normalise(spark):
    values = ["It's two dogs, ok?", "1,000 men.", "The cat/dog", "dont"]
    got = column(spark, lambda c: answers.plain_words(answers.plain_punctuation(c)), values)
    assert got == ["it's 2 dogs ok", "1000 men", "cat dog", "don't"]


def test_first_fit_decreasing_is_exact():
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(0, 80))]
        order, bins, want = sorted(range(len(lengths)), key=lambda i: -lengths[i]), [], [0] * len(lengths)
        for i in order:
            at = next((b for b, used in enumerate(bins) if used + lengths[i] <= 50), None)
            if at is None:
                bins.append(0)
                at = len(bins) - 1
            bins[at] += lengths[i]
            want[i] = at
        assert packing.first_fit_decreasing(lengths, 50) == want


def test_equal_buckets():
    assert batching.equal_buckets([9, 8, 2, 1], 2) == [0, 1, 1, 0]
    with pytest.raises(ValueError):
        batching.equal_buckets([1, 2, 3], 2)


def test_choice_and_open(spark):
    options = F.array(*map(F.lit, ("red", "green", "blue")))
    values = ["(A) or rather (C)", "B", "I think that it must be green here", "no idea", "C. or A.", "rather A than B now", "it is red or maybe Green for me", ""]
    assert column(spark, lambda c: answers.choice(c, options), values) == ["C", "B", "B", None, "A", "B", "B", None]
    assert column(spark, lambda c: answers.choice(c, options, spaced=True), ["B", "xA y"]) == ["B", None]
    match = lambda gold: lambda c: answers.open_match(F.array(F.lit(gold)), answers.open_answers(c))
    assert column(spark, match("3.14"), ["so the result is 3.14", "it is 3", "= 3.14", "x is\ny = 3.14"]) == [True, False, True, True]
    assert column(spark, match("7"), ["so the result is 3.14", "thus 7 cats", "7"]) == [False, True, True]
    assert column(spark, match("a"), ["the answer is a cat", "cat", "so a"]) == [True, False, True]


def test_numbers_and_forms(spark):
    values = ["1,234 and 5e3 or -2.5, .5", "", "12,345.6 - 7 x8 1e-4.", "-1,000,000 0.10"]
    assert column(spark, answers.numbers_in, values) == [[n for p in answers.NUMBERS for n in re.findall(p, v)] for v in values]
    forms = column(spark, answers.normal_forms, ["1,234.567", " A", "Cat", "1_0", "3d", "nan"])
    assert [[(f.s, f.n) for f in x] for x in forms[:5]] == [[(None, 1234.57)], [(" a", None), ("a ", None)], [("cat", None)], [(None, 10.0)], [("3d", None)]]
    assert column(spark, answers.key_answers, ["So it is final\nx = 4.", "plain text", "a\nthe answer is: red"]) == [["final", "4"], ["plain text"], ["is: red"]]


def test_boxes(spark):
    assert column(spark, boxes.parsed, ["[0.1, 0.2, 0.5, 0.6]", "[0.5, 0.2, 0.1, 0.6]", "[0, 0, 2, 1]", "none", "[0.1]"]) == [[0.1, 0.2, 0.5, 0.6], None, None, None, None]


def test_top_fraction_handles_nan(spark):
    t = spark.createDataFrame([(i, v) for i, v in enumerate([5.0, float("nan"), None, 4.0, 3.0, 3.0])], "uid int, s double")
    assert sorted(r.s for r in filters.by_fraction(t, "s", 0.34).collect()) == [3.0, 3.0, 4.0, 5.0]


@pytest.mark.parametrize(("name", "options"), [("nothing", {}), ("basic_filter", {"threshold": 1}), ("clip_score", {"score": "s"}), ("semantic_understanding_score", {"fraction": 0.3}), ("clip_score", {"score": "s", "fraction": 1.0})])
def test_option_checks(name, options):
    with pytest.raises(ValueError):
        filters.check_options(name, **options)


def test_tar_and_npy_round_trip(spark, tmp_path):
    body = io.BytesIO()
    with tarfile.open(fileobj=body, mode="w") as t:
        for name, data in (("a/1.jpg", b"x"), ("a/1.JSON", b'{"uid": "7"}'), ("a/2.jpg", b"y"), ("a/2.jpg", b"z")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (tmp_path / "s.tar").write_bytes(body.getvalue())
    (tmp_path / "broken.tar").write_bytes(body.getvalue()[:700])
    rows = files.read_tar_samples(spark, f"{tmp_path}/s.tar").collect()
    assert sorted((r.key, sorted(r.parts), r.uid) for r in rows) == [("a/1", ["jpg", "json"], "7"), ("a/2", ["jpg"], None), ("a/2", ["jpg"], None)]
    assert files.read_tar_members(spark, f"{tmp_path}/broken.tar").count() <= 1
    ids = np.array([(1, 2), (1, 2), (2**64 - 1, 0)], np.dtype("u8,u8"))
    np.save(tmp_path / "u.npy", ids)
    assert [r.uid for r in files.read_npy_uids(spark, f"{tmp_path}/u.npy").orderBy("at").collect()] == ["0" * 15 + "1" + "0" * 15 + "2"] * 2 + ["f" * 16 + "0" * 16]
    samples = spark.createDataFrame([(0, 0, "k", {"txt": bytearray(b"q")})], "shard long, at long, key string, parts map<string,binary>")
    assert [tuple(r) for r in files.write_tar_shards(samples, f"{tmp_path}/out").collect()] == [(0, 1)]
