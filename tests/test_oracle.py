"""Every registered reference query against its DuckDB SQL."""

import math

import duckdb
import pytest

from quarrykit.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    df = plans.queries()[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    found = duck.sql(plans.oracle_sql()[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs_again(spark, sf, name):
    """Queries without SQL give rows, and the same ones when they are run again."""
    first, second = (sorted(map(repr, plans.queries()[name](spark, sf).collect())) for _ in range(2))
    assert first and first == second


def test_no_query_compares_nothing(spark, sf):
    for name in ("a11_roc_auc", "a13_average_precision", "e06_pope_f1"):
        rows = plans.queries()[name](spark, sf).collect()
        assert len(rows) == 3 and all(0 < r[-1] < 1 for r in rows)
