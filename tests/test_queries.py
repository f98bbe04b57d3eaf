"""Every table query against its SQL in DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pytest

from shalebed import queries as Q

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in want.fetchall()), key=repr)
    got = Q.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()), key=repr) == want
