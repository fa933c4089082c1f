"""Values of op5_pii that stand beside other numbers."""

import re

import pytest

from quarrykit.llm import pii

CASES = [
    ("card 4111 1111 1111 1111 12/25", "card", "4111 1111 1111 1111"),
    ("4111 1111 1111 1111 123", "card", "4111 1111 1111 1111"),
    ("12 4111 1111 1111 1111", "card", "4111 1111 1111 1111"),
    ("1234 4111 1111 1111 1111 1234", "card", "4111 1111 1111 1111"),
    ("3782 822463 10005 99", "card", "3782 822463 10005"),
    ("at 10:30 2024-02-29", "date", "2024-02-29"),
    ("12 34 56 78 2024-02-29", "date", "2024-02-29"),
    ("12 123-45-6789", "ssn", "123-45-6789"),
    ("10 555-234-4567", "phone", "555-234-4567"),
    ("1-555-234-4567", "phone", "555-234-4567"),
    ("+1 555-234-4567 2024-02-29", "phone", "+1 555-234-4567"),
    ("to DE89 3704 0044 0532 0130 00.", "iban", "DE89 3704 0044 0532 0130 00"),
    ("12 DE89370400440532013000 12", "iban", "DE89370400440532013000"),
    ("12 34 56 78 10.20.30.40", "ip", "10.20.30.40"),
    ("7 10.20.30.40 8", "ip", "10.20.30.40"),
]


def shape(value, kind):
    return re.sub("[0-9A-Z]+" if kind == "ip" else "[0-9A-Z]", "x", value)


@pytest.fixture(scope="module")
def out(spark):
    return pii.pseudonymised(spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "doc_id long, text string"), "k").collect()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_value_beside_numbers(out, i):
    text, kind, value = CASES[i]
    r = next(r for r in out if r.doc_id == i)
    before, after = text.split(value)
    made = [v.value for v in r.pii if v.kind == kind]
    assert len(made) == 1 and shape(made[0], kind) == shape(value, kind)
    assert value not in r.text and r.text.startswith(before + made[0])
    assert "2024-02-29" not in r.text and (after.strip() == "2024-02-29" or r.text == before + made[0] + after)


def test_what_fails_stays(spark):
    texts = ["4041 8949 7460 8796", "999.1.1.1", "DE88 3704 0044 0532 0130 00", "v1.2.3.4.5", "2023-02-30", "000-12-3456", "x4111111111111111"]
    rows = pii.pseudonymised(spark.createDataFrame([(t,) for t in texts], "text string"), "k").collect()
    assert sorted(r.text for r in rows) == sorted(texts) and all(r.pii == [] for r in rows)
