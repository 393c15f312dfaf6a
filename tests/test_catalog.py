"""Every catalogue query against its SQL at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from tessella.plans import catalog

HERE = Path("/root/testdata/sf0.001")


def rows(frame):
    out = []
    for r in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple(None if v is None or v != v else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else str(v) for v in r))
    return sorted(out, key=str)


@pytest.mark.skipif(not HERE.exists(), reason="no test data")
@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"create view {t} as select * from '{HERE}/{t}.parquet'")
    got, wanted = catalog.QUERIES[name](spark, str(HERE)).toPandas(), con.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got.astype(object)) == rows(wanted.astype(object))


def test_coverage_shuffles_each_side_once(spark):
    plan = catalog.coverage_details(spark, str(HERE))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
