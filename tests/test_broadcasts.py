"""Registered point joins on the grid broadcast cells of coarse levels, and no tables."""

import re

import pytest

from orbweave.operators import proximity
from orbweave.plans.queries import QUERIES

NAMES = ["id_label_projection", "knn3_part", "knn_within_r", "meta_fields_projection", "multipart_knn", "multipart_knn_features", "nearest_within_r", "bbox_both_sides", "radius_join_grid"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_broadcast_cells_only(spark, monkeypatch, name):
    for limit in ("ALL_PAIRS", "FEW_PARTS"):  # as with large tables, on which `auto` takes the grid
        monkeypatch.setattr(proximity, limit, 0, raising=False)
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [cell#" in plan and "BroadcastNestedLoopJoin" not in plan
    assert set(re.findall(r"BroadcastHashJoin \[(\w+)#", plan)) <= {"cell"}
    assert len(re.findall(r"BroadcastHashJoin", plan)) <= 1
