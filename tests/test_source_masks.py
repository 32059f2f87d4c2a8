from pathlib import Path

import pytest

from gridlark.operators import rollups
from gridlark.plans import more_queries

SF = "/root/testdata/sf0.001"


def test_combined_and_declared_masks(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 3), ("b", 5)], "source string, class_id int")
    declared = spark.createDataFrame([("a", [1]), ("c", [2])], "source string, classes array<int>")
    got = {(r.source, r.kind): (r.observed, r.mask) for r in rollups.source_masks(rows, declared).collect()}
    assert got == {
        ("a", "source"): ([1, 0, 0, 1, 0, 0], [0, 1, 0, 0, 0, 0]),
        ("b", "source"): ([0, 0, 0, 0, 0, 1], [0, 0, 0, 0, 0, 1]),
        ("c", "source"): ([0, 0, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0]),
        (None, "combined"): ([1, 0, 0, 1, 0, 1], [0, 1, 1, 0, 0, 1]),
    }


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_masks_over_all_images(spark):
    assert {r["mask"] for r in more_queries.QUERIES["a04_source_masks"](spark, SF).collect()} == {"111111"}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_merged_masks_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    want = con.sql(more_queries.ORACLES["a04_merged_masks"]).fetchall()
    got = more_queries.QUERIES["a04_merged_masks"](spark, SF).select("scene", "kind", "observed", "mask").collect()
    assert sorted(want) == sorted(map(tuple, got)) and len({r["mask"] for r in got}) > 3
