"""Queries without SQL read every row of their tables."""

import os

import pytest

from terravela.plans.inputs import META, PLACED, dem, ragged
from terravela.plans.terrain_queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_all_lines_are_drawn(spark, tmp_path):
    rows = [(7, 1, 85, 135), (7, 2, 125, 135), (40, 1, 205, 235), (40, 2, 205, 255)]  # along a row, then along a column
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r["row"], r["col"]) for r in QUERIES["rasterize_lines"](spark, str(tmp_path)).collect()}
    top = META.height - 1
    assert got == {(top - 10, c) for c in range(5, 10)} | {(top - y, 17) for y in range(20, 23)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_all_cells_are_sampled(spark):
    got = sorted(r["id"] for r in QUERIES["dem_sampler"](spark, SF).collect())
    assert got == sorted(r["id"] for r in ragged(dem(spark, SF)).select(PLACED.cell_id().alias("id")).collect())
