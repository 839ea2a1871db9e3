"""Every query with an SQL oracle equals DuckDB on the smallest tables."""

import math

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
ORACLES = E.oracle_sql()


def _canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_canon(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def _rows(records, cols):
    return sorted((tuple(_canon(r[c]) for c in cols) for r in records), key=repr)


@pytest.mark.parametrize("qid", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, qid):
    sdf = E.queries()[qid](spark, SF)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    res = duck.execute(ORACLES[qid])
    dcols = [d[0] for d in res.description]
    drows = [dict(zip(dcols, r)) for r in res.fetchall()]
    assert sorted(sdf.columns) == sorted(dcols)
    cols = sorted(dcols)
    assert _rows(srows, cols) == _rows(drows, cols)


def test_every_query_has_a_callable():
    q = E.queries()
    assert set(ORACLES) <= set(q)
    assert len(q) >= 160


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 10 and df.columns == ["word", "cnt"]
