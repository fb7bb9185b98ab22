"""The queries of the training-data operators on the smallest tables: against SQL, and whole where there is none."""

import os

import pytest

from quillmesh.llm import line_dedup, ngram_join
from quillmesh.llm.queries import ORACLES, QUERIES, table
from tests.compare import check

SMALLEST = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="needs the driver's tables")


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name], SMALLEST)


def test_plainer_forms_against_sql(spark):
    check(spark, lambda s, d: line_dedup.deduplicated(table(s, d, "documents")), line_dedup.SQL, SMALLEST)
    check(spark, lambda s, d: ngram_join.linked(table(s, d, "documents"), n=4, percent=85), ngram_join.SQL, SMALLEST)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_are_whole(spark, name):
    rows = QUERIES[name](spark, SMALLEST)
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    assert ids(rows) == ids(table(spark, SMALLEST, "documents"))
