"""What plans must not have: Python in relational queries, joins of all pairs, unpruned scans."""

import re

import pytest

import __spark_entry__ as entry
from quadlark.operators import index as ix
from quadlark.sources.store import Dataset

SF = "/root/testdata/sf0.001"
QUERIES = {k: f for k, f in entry.queries().items() if not k.startswith("op") and k != "pipeline"}
#: Kernels whose steps depend on each other.
KERNELS = {"refine_mesh"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert name in KERNELS or not re.search("Python|Pandas|ArrowEval|MapInArrow|FlatMapGroups", text)
    # A nested-loop join may only meet a broadcast side: one-row statistics, or a registry's few nodes.
    assert all("BuildRight" in line or "BuildLeft" in line for line in text.splitlines() if "BroadcastNestedLoopJoin" in line)


def test_levels_prune_folders(spark, tmp_path):
    d = Dataset(spark, f"file://{tmp_path}/set")
    d.write(spark.range(2000).selectExpr("cast(id % 4 + 5 as int) as lod", "id % 32 as x", "id % 31 as y", "id % 7 + 1 as flags", "'unread' as more").dropDuplicates(["lod", "x", "y"]))
    text = plan(ix.statistics(ix.clamp(d.read(), 6, 6)))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert re.search(r"PartitionFilters: \[.*lod", scan) and "more" not in scan.split("ReadSchema")[1]


def test_filters_reach_the_scan(spark):
    scan = next(line for line in plan(QUERIES["ti_stat"](spark, SF)).splitlines() if "FileScan" in line)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in scan
    assert "l_comment" not in scan and "l_tax" not in scan
