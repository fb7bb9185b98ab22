"""Every query of the engine against its SQL on the smallest tables."""

import os

import pytest

from quillmesh.queries import ORACLES, QUERIES
from tests.compare import check

SMALLEST = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="needs the driver's tables")


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name], SMALLEST)


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_literal_ratio_by_brute_force(spark):
    from quillmesh.functions.similarity import ratio
    from quillmesh.queries import sides

    targets, sources = sides(spark, SMALLEST)
    t = {(r["doc"], r["index"]): r["n"] for r in targets.collect()}
    s = {r["index"]: r["n"] for r in sources.collect()}
    rows = QUERIES["literal_ratio"](spark, SMALLEST).limit(300).collect()
    assert rows and all(abs(r["literal"] - ratio(t[r["doc"], r["index"]], s[r["item_id"]])) < 1e-8 for r in rows)


def test_literal_ratio_has_every_item_that_shares_a_gram(spark):
    from quillmesh.functions.similarity import grams_of, ratio
    from quillmesh.queries import sides

    targets, sources = sides(spark, SMALLEST)
    items = [(r["index"], r["n"], set(grams_of(r["n"]))) for r in sources.collect()]
    want = {}
    for r in targets.where("doc % 4 = 0").collect():
        own = set(grams_of(r["n"]))
        want |= {(r["doc"], r["index"], k): ratio(r["n"], n) for k, n, g in items if own & g}
    got = {(r["doc"], r["index"], r["item_id"]): r["literal"] for r in QUERIES["literal_ratio"](spark, SMALLEST).where("doc % 4 = 0").collect()}
    assert got.keys() == want.keys() and len(want) > 3000
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)
