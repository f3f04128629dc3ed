"""Every registered query against its SQL, on the smallest tables."""

import os

import compare
import pytest

import __spark_entry__ as contract
from pagewright.storage import shared_path

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, connection, name):
    query, sql = contract.queries()[name], contract.oracle_sql().get(name)
    if sql is None:
        assert query(spark, SF_DIR).count() > 0
    else:
        assert compare.difference(spark, connection, query, sql, SF_DIR) is None


def test_scan_keeps_every_body_of_a_url(spark):
    rows = [(1, "https://h.e/a", "x"), (2, "https://h.e/a", "longer"), (2, "https://h.e/a", "longer"), (3, "https://h.e/b", ""), (4, None, "no url"), (5, "https://h.e/b", None)]
    folder = shared_path(spark)
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    got = contract.queries()["scan_fetched"](spark, folder).select("page_id", "requested_url", "html_chars").collect()
    want = [(i, url, html if html is None else len(html)) for i, url, html in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
