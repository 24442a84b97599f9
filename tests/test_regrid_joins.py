"""Which side of a regridding join may be broadcast."""

import re

import pytest

from airgrid.operators import binding, regrid


@pytest.mark.parametrize("cells", [-1, 2_000_000])
def test_the_field_is_not_broadcast(spark, tmp_path, monkeypatch, cells):
    monkeypatch.setattr(binding, "BROADCAST_CELLS", cells)
    # a small file that is a long field
    spark.range(20).selectExpr("CAST(id AS INT) AS i").write.parquet(str(tmp_path / "nodes"))
    field = spark.read.parquet(str(tmp_path / "nodes")).selectExpr("i", "explode(sequence(1, 50)) AS time", "CAST(i % 2 AS INT) AS j", "i * 1e0 AS v")
    weights = spark.createDataFrame([(y, 0, y, y % 2, 1.0, 1) for y in range(20)], "y int, x int, i int, j int, w double, n_corners int")
    applied = regrid.apply_weights(field, weights, ["v"])
    rows = {(r["time"], r["y"]): r["v"] for r in applied.collect()}
    assert len(rows) == 1000 and rows[7, 13] == 13.0
    plan = applied._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert bool(re.search("BroadcastHashJoin", plan)) == (cells > 0)
    for build in re.findall(r"BroadcastHashJoin.*Build(Left|Right)", plan):
        assert build == "Right"
