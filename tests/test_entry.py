"""The registered queries against their SQL on the small tables, as the driver compares them."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_registry():
    from lumberline.plans import registry

    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) > 80


@needs_data
def test_queries_equal_their_sql(spark):
    import duckdb
    from lumberline.plans import registry

    con = duckdb.connect()
    for t in ("events", "documents", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    text = lambda v: "None" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = lambda df: sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    some = [n for i, n in enumerate(registry.ORACLES) if i % 4 == 0]
    wrong = [n for n in some if rows(registry.QUERIES[n](spark, DATA).toPandas()) != rows(con.execute(registry.ORACLES[n]).df())]
    assert wrong == []


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).columns == ["bucket", "grp", "n"]
