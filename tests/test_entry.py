import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import SF001


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "pct1" in df.columns


def test_every_oracle_has_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


TABLES = ["nation", "customer", "orders", "lineitem", "documents", "labels", "conversations"]
FAST = [k for k in entry.oracle_sql()]


@pytest.mark.parametrize("name", FAST)
def test_oracle_matches_at_sf0001(spark, name):
    """Each S-checked query equals its DuckDB oracle on the smallest tables."""
    import math
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    sdf = entry.queries()[name](spark, SF001)
    cols = sorted(sdf.columns)
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert cols == sorted(dcols)

    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 5)
        return v
    a = sorted((tuple(str(norm(r[c])) for c in cols) for r in sdf.collect()))
    idx = {c: i for i, c in enumerate(dcols)}
    b = sorted((tuple(str(norm(float(r[idx[c]]) if hasattr(r[idx[c]], "as_tuple") else r[idx[c]]))
                      for c in cols) for r in res.fetchall()))
    assert a == b
