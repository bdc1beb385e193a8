"""All pN_ queries over empty tables, and over tables with more columns, named like those used inside; SQL where there is any."""

import glob
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folio.llm.queries import oracle_sql, queries

duckdb = pytest.importorskip("duckdb")
D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="test tables are not here")
EXTRA = ["q", "rank", "score", "key", "h", "h0", "salt", "seg", "s", "g", "i", "d", "t", "x", "n", "place", "mass", "forma", "classe", "rep", "tokens", "left", "pos", "estado"]


def copies(spark, folder, change):
    for p in glob.glob(D + "/*.parquet"):
        change(spark.read.parquet(p)).write.parquet(f"{folder}/{os.path.basename(p)}")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return copies(spark, tmp_path_factory.mktemp("empty"), lambda df: df.where("false"))


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    return copies(spark, tmp_path_factory.mktemp("wide"), lambda df: df.withColumns({c: F.lit(0) for c in EXTRA if c not in df.columns}))


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty(spark, empty, name):
    assert queries()[name](spark, empty).count() == 0


def plain(rows):
    return Counter(tuple("null" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", [n for n in sorted(queries()) if n.endswith("_found")])
def test_more_columns_and_sql(spark, wide, name):
    df = queries()[name](spark, wide)
    cols = sorted(df.columns)
    got = plain(df.select(cols).collect())
    sql = oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for p in glob.glob(D + "/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        assert got == plain(con.sql(sql).select(*[f'"{c}"' for c in cols]).fetchall())
    else:
        assert got == plain(queries()[name](spark, D).select(cols).collect())
