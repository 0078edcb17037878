"""Results and work that must not change where a group grows."""

import time

from pyspark.sql import functions as F

from tidemark.config import BatchOptions
from tidemark.operators import examples
from tidemark.session import stage_in
from tidemark.sources import tables
from tidemark.streaming.minibatches import TimeBatchStream
from workload.queries import QUERIES


def test_parts_of_a_dataset_make_one_text(spark):
    rows = [("a", t, 0, [f"n{t}"] if t % 3 == 0 else [], [f"x{t}", f"y{t}"]) for t in range(12)] + [("b", 5, 0, [], [])]
    stored = spark.createDataFrame(rows, "dataset string, time long, part long, annotation array<string>, narrative array<string>")
    parts = examples.merge_all(stored, max_atoms=5)
    assert parts.where("dataset = 'a'").count() > 1
    got = {r["dataset"]: (r["part"], r["time"], r["annotation"], r["narrative"]) for r in examples.whole_text(parts).collect()}
    assert got["a"] == (0, 0, "n0|n3|n6|n9", "|".join(f"x{t}|y{t}" for t in range(12)))


def test_rows_are_numbered_over_the_files_of_a_folder(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 2).cast("string").alias("subject"), "id", F.concat(F.lit("r"), "id").alias("value"))
    ranged = rows.repartitionByRange(5, "subject", "id").sortWithinPartitions("subject", "id").select("subject", "value")
    ranged.write.partitionBy("subject").text(str(tmp_path / "m"))
    assert len(list((tmp_path / "m").glob("subject=0/*.txt"))) > 1
    read = tables.read_matrix(spark, str(tmp_path / "m"), F.col("subject").cast("string"), {"code": 1}, in_files=True)
    got = {(r["subject"], r["time"]): r["code"] for r in read.collect()}
    assert got == {(str(n % 2), n // 2): f"r{n}" for n in range(40)}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_of_a_stored_frame_go_at_once(spark):
    before = shuffle_files(spark)
    frame = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    stored = stage_in(spark)(frame)
    until = time.time() + 20
    # The frame is still held here, so the driver's garbage collection would leave them.
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, frame.collect()))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_containment_queries_store_their_intervals(spark):
    for name in ("contain_join", "noise_interval"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan
        # The successor of every event is looked up before, so its shuffles are gone when the join runs.
        assert "Window" not in plan


def test_a_folder_of_intervals_gets_few_files(spark, tmp_path):
    wide = TimeBatchStream._SLICE
    rows = [(i, "stopped", ["v0"], "true", i % 40 * wide + i, i % 40 * wide + i + 5) for i in range(400)]
    spans = spark.createDataFrame(rows, "seq long, hle string, vessels array<string>, value string, stime long, etime long").repartition(8)
    stream = TimeBatchStream(spark, spans, BatchOptions(), str(tmp_path / "s"), str(tmp_path / "o"))
    assert {r["seq"] for r in stream.met_intervals(0, None).collect()} == set(range(400))
    files = list((tmp_path / "s" / "intervals").glob("first=*/length=*/*.parquet"))
    # Eight tasks with a file for each of 40 slices made 320.
    assert 40 <= len(files) <= 50
