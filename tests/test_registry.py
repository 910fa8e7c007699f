"""Every core query against its SQL, and the driver's contract."""

import math

import pytest

import __spark_entry__
from foliospark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    import glob
    import os

    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(cell(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    place = [names.index(c) for c in cols]
    expected = sorted((tuple(cell(r[i]) for i in place) for r in found.fetchall()), key=repr)
    assert got == expected


def test_contract(spark, sf_dir):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) - set(SQL) == {"kmeans_topics", "p5_found"}
    assert 0 < __spark_entry__.entry(spark).count() <= 10


def test_kmeans_query(spark, sf_dir):
    got = QUERIES["kmeans_topics"](spark, sf_dir).collect()
    assert len(got) == 8 and sum(r.doc_count for r in got) == spark.read.parquet(f"{sf_dir}/paper_metadata.parquet").count()


def test_core_does_not_import_llm():
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"foliospark\.llm|from \.+llm", p.read_text()), p
