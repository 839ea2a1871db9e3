"""Queries of this subpackage that SQL can express equal DuckDB."""

import pytest

from textloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    res = duck.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(got.columns) == sorted(cols)
    rows = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)
    assert rows and rows == sorted(res.fetchall(), key=repr)


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
