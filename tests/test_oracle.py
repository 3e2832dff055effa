"""Every registered query with an oracle agrees with DuckDB at sf0.001
(row count, column names, values; floats to 1e-9)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from creditlens.sources.tables import TABLES

from .conftest import SF_SMALL

from creditlens.plans.registry import load_all

ORACLE = {n: e.oracle for n, e in load_all().items() if e.oracle}
SKIP_HEAVY = {"logistic_invariants", "forest_invariants", "boosted_invariants", "persistence_roundtrip", "shap_additivity"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return "None" if v is None else str(v)


def _key(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if n not in SKIP_HEAVY))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _key(srows, sdf.columns) == _key(drows, dcols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[0] == "grade" and df.count() > 0
