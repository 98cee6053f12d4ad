"""Every query of the catalogue against its SQL over the source tables."""

import math

import duckdb
import pytest

from foliospark.plans.queries import CATALOGUE

TABLES = "region nation customer supplier part orders lineitem documents".split()


def canonical(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        if isinstance(v, list | tuple):
            return tuple(map(one, v))
        return v.hex() if isinstance(v, bytes | bytearray) else v

    return sorted((tuple(sorted((k, one(v)) for k, v in r.items())) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_against_sql(spark, sf, name):
    f, sql = CATALOGUE[name]
    df = f(spark, sf)
    got = [r.asDict() for r in df.collect()]
    assert got
    if sql is None:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(got) == canonical([dict(zip(names, r)) for r in want.fetchall()])
