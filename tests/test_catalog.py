"""Every registered query of the compression operators against its SQL."""

import math

import duckdb
import pytest

from brindle.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: What rows of queries without SQL must hold to.
CLAIMS = {"dict_learned": lambda r: r["closer"], "patch_entropy_by_order": lambda r: all(0 < r[f"{o}_entropy"] <= math.log2(100) for o in ("mst", "random")), "logistic_accuracy": lambda r: 0 < r["accuracy"] < 1}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    if name not in catalog.SQL:
        assert got
        if name in CLAIMS:
            assert all(CLAIMS[name](dict(zip(columns, r, strict=True))) for r in got)
        return
    cursor = sql.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=str)
    assert got == want
