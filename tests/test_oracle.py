"""Every registered query of the reference's operators against its SQL in DuckDB, on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lodestone import plans

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = DATA / f"{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(repr([plain(r[k]) for k in order]) for r in rows)


#: Approximate by nature; test_vectors.py measures its recall.
WITHOUT_SQL = {"topk_vec_index"}


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - WITHOUT_SQL))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, str(DATA))
    got = table(df.columns, [tuple(r) for r in df.collect()])
    want = duck.sql(plans.ORACLE[name])
    assert got == table(want.columns, want.fetchall())


def test_inventory_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLE) | WITHOUT_SQL
