import hashlib
import os

import pytest

from eventlake.plans import catalog, lake_queries  # noqa: F401 - its queries are among those of the catalogue

from .oracle import database, same

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_agrees_with_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, FOLDER), con, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_term_filters_reach_the_scan(spark):
    plan = catalog.terms_equality_list(spark, FOLDER)._jdf.queryExecution().toString()
    assert "In(l_returnflag, [A,R])" in plan and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_returnflag:string>" in plan


def test_conservation_counts_both_sides(spark, tmp_path):
    rows = [("de", "both"), ("en", "both"), ("de", "only"), ("de", "only"), ("en", "kept"), (None, "no lang"), ("de", None), ("en", None)]
    spark.createDataFrame(rows, "lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.sha: (r.n_in, r.n_out) for r in catalog.QUERIES["conservation_check"](spark, str(tmp_path)).collect()}
    assert got == {sha("both"): (2, 1), sha("only"): (2, 0), None: (2, 1)}
