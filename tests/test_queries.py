"""Registered queries against their SQL on the smallest tables, and plan checks."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import batching, intervals as I, noise
from workload import tables as T
from workload.check import compare, connect

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
# Every query is compared by ``python -m workload.check``; these are the quick ones.
QUICK = (
    "batch_by_times batch_bounds overlap_join_closed contain_join interval_clip noise_anti_join coast_distance "
    "scan_points interval_arity symmetric_atoms parse_all pair_expand shift_pair count_interpretations "
    "scan_statements chunk_merge merge_all activity_atoms label_lookup model_number state_changes foil_gain"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", QUICK)
def test_same_as_sql(spark, name):
    line = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert line.startswith("ok"), line


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["batch_id", "time", "part", "annotation", "narrative"]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loops(spark):
    points, intervals = T.points(spark, SF), T.intervals(spark, SF)
    bounds = batching.batch_bounds(batching.batch_times(batching.rank_times(points), 50))
    frames = [
        batching.batch_by_times(points, 50),
        I.overlap_join(intervals, bounds),
        I.interval_edges(intervals, bounds),
        I.contain_join(points.select("time"), intervals),
    ]
    for frame in frames:
        assert "NestedLoop" not in plan(frame) and "Cartesian" not in plan(frame)


def test_scans_are_pruned(spark):
    kept = T.points(spark, SF).where(F.col("lle").isin("signup", "purchase")).select("lle", "vessel")
    text = plan(kept)
    assert "In(event_type, [purchase,signup])" in text
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in text


def test_anti_join_reads_keys_only(spark):
    points = T.points(spark, SF).select("seq", "time", "vessel")
    kept = noise.drop_located(points, noise.located_keys(T.coords(spark, SF)), points["vessel"], points["time"])
    assert "lon" not in plan(kept) and "LeftAnti" in plan(kept)
