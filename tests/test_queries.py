"""Every query of the engine's own operators at the smallest scale; those that have SQL against DuckDB."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if hasattr(x, "asDict"):
        return x.asDict(True)
    return round(x, 9) if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, list) else x


def names():
    from millrace.plans import catalog

    return sorted(catalog.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", names())
def test_query_runs_and_equals_sql(spark, name):
    from millrace.plans import catalog

    if name not in catalog.oracle_sql():
        assert catalog.queries()[name](spark, SF).collect() is not None
        return
    db = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        db.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = catalog.queries()[name](spark, SF)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    result = db.execute(catalog.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == order
    assert got == sorted((tuple(plain(r[at[c]]) for c in order) for r in result.fetchall()), key=repr)
