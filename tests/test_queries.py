"""Every query of the reference's operators against its oracle, on the smallest tables."""

import math
import os

import duckdb
import pytest

from folioflow.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_oracle(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    cursor = db.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_diverse_topk_caps_each_kind_before_it_backfills(spark):
    got = catalog.queries()["diverse_topk"](spark, DATA).collect()
    assert got and all(1 <= r.place <= 10 for r in got)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "item_id", "score", "rank"]
