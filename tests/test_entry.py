"""Every query runs on the smallest tables and agrees with its SQL."""

import glob
import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")
D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="test tables are not here")


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for p in glob.glob(D + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(rows):
    return Counter(tuple("null" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


def core_names():
    from folio.plans.queries import queries

    return sorted(queries())


@pytest.mark.parametrize("name", core_names())
def test_query(spark, views, name):
    from folio.plans import queries as core

    df = core.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = df.select(cols).collect()
    sql = core.oracle_sql().get(name)
    if sql:
        rel = views.sql(sql)
        assert sorted(rel.columns) == cols
        assert plain(got) == plain(rel.select(*[f'"{c}"' for c in cols]).fetchall())


def test_masked_ranking_makes_no_row_for_each_pair(spark):
    from folio.plans import queries as core

    plan = core.queries()["bm25_masked"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_repeated_terms_make_no_row_for_each_pair_and_term(spark):
    from folio.plans import queries as core

    df = core.queries()["bm25_repeated_term"](spark, D)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    once = {(r.q, r.doc_ord): r.score for r in core.queries()["bm25_scores"](spark, D).collect()}
    twice = {(r.q, r.doc_ord): r.score for r in df.collect()}
    assert twice.keys() == once.keys() and all(abs(twice[k] - 2 * once[k]) < 2e-6 for k in once)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
