"""Every query runs on the small tables, and gives its SQL's rows where it has SQL."""

import glob
import math
import os

import pytest

from quadrille.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _plain(v):
    if hasattr(v, "asDict"):
        v = list(v)
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{round(float(v), 6) + 0.0:.6f}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([_plain(r[c]) for c in columns] for r in df.collect())
    if name not in ORACLES:
        assert columns
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted([_plain(r[k]) for k in at] for r in result.fetchall())
