"""What lies off the usual data: cut-off lines, far positions, restarts, exact parts, stored output read again."""

import tempfile

from pyspark.sql import functions as F

from tidemark.config import BatchOptions, StoredInput
from tidemark.functions import atoms as A
from tidemark.operators import batching, coast, examples, intervals as I, nesting, ordering
from tidemark.sinks import writers
from tidemark.sources import tables, vessels
from tidemark.streaming.minibatches import RowBatchStream, TimeBatchStream


def lines(spark, *texts):
    rows = [(i, t.split("|")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "seq long, fields array<string>")


def test_rejects_are_the_rest(spark):
    given = lines(
        spark, "proximity|5|1|5|true|v1|v2", "proximity|5|1|5|true|v1", "proximity|5|1|5|true|v1|", "proximity|5|1|5",
        "gap_end|7|7|v3", "gap_end|x|7|v3", "gap_end|7|7",
    )
    kept = vessels.point_events(given).collect()
    assert [(r["seq"], r["vessel"]) for r in kept] == [(0, "v1,v2"), (4, "v3")]
    assert sorted(r["seq"] for r in vessels.point_rejects(given).collect()) == [1, 2, 3, 5, 6]


def test_coord_rejects_are_the_rest(spark):
    given = lines(spark, "coord|5|5|v|1.0|2.0", "coord|5|5|v|1.0", "coord|a|5|v|1|2", "coord|5|5|v|NaN|2", "gap_end|7|7|v")
    assert vessels.positions(given).count() == 1
    assert sorted(r["seq"] for r in vessels.coord_rejects(given).collect()) == [1, 2, 3]


def test_far_positions_keep_their_row(spark):
    segments = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0)], "seg_id long, x1 double, y1 double, x2 double, y2 double")
    positions = spark.createDataFrame([("v", 1, 0.001, 0.5), ("v", 2, 56.0, 0.5), ("w", 3, -70.0, 60.0)], "vessel string, time long, lon double, lat double")
    got = {r["time"]: r["dist_m"] for r in coast.coast_distance(positions, segments, cell=0.001).collect()}
    assert 0 < got[1] < 200 and got[2] > 6e6 and got[3] > 6e6
    assert [r["dist_m"] for r in coast.coast_distance(positions, segments.limit(0)).collect()] == [None] * 3


def test_parts_are_exact(spark):
    rows = [("k", A.NARRATIVE if i % 2 else A.ANNOTATION, i, f"a{i}") for i in range(25)] + [("k", None, None, None), ("e", None, None, None)]
    atoms = spark.createDataFrame(rows, "k string, role string, seq bigint, atom string")
    got = {(r["k"], r["part"]): sorted(r["annotation"] + r["narrative"]) for r in nesting.nest_examples(atoms, ["k"], ["seq"], 10).collect()}
    assert got == {**{("k", p): sorted(f"a{i}" for i in range(10 * p, min(25, 10 * p + 10))) for p in range(3)}, ("e", 0): []}


def test_one_hot_key_in_one_order_value(spark):
    atoms = spark.range(3000).select(F.lit("k").alias("k"), F.lit(A.NARRATIVE).alias("role"), F.lit(0).alias("place"), F.col("id").alias("seq"), F.col("id").cast("string").alias("atom"))
    got = nesting.nest_examples(atoms, ["k"], ["place", "seq"], 700).orderBy("part").collect()
    assert [len(r["narrative"]) for r in got] == [700] * 4 + [200]
    assert [a for r in got for a in r["narrative"]] == [str(i) for i in range(3000)]


def test_row_stream_goes_on_after_a_stop(spark, tmp_path):
    places = (4, "n", str(tmp_path / "state"), str(tmp_path / "out"))
    numbers = spark.range(11).withColumnRenamed("id", "n")
    RowBatchStream(spark, *places).process(numbers.where("n < 7"), 0)
    RowBatchStream(spark, *places).process(numbers.where("n >= 7"), 1)
    RowBatchStream(spark, *places).finish()
    got = spark.read.parquet(str(tmp_path / "out" / "batches")).orderBy("n").collect()
    assert [(r["n"], r["batch_id"]) for r in got] == [(i, i // 4) for i in range(11)]


def test_time_stream_ends_after_a_stop(spark, tmp_path):
    intervals = spark.createDataFrame([], "seq bigint, hle string, vessels array<string>, value string, stime bigint, etime bigint")
    points = spark.createDataFrame([(t, "gap_end", t, "v", None) for t in (10, 12, 15)], "seq bigint, lle string, time bigint, vessel string, area string")
    places = (intervals, BatchOptions(size=2), str(tmp_path / "state"), str(tmp_path / "out"))
    TimeBatchStream(spark, *places).process(points, 0)
    TimeBatchStream(spark, *places).finish()
    got = spark.read.parquet(str(tmp_path / "out" / "batches")).collect()
    assert sorted(t for r in got for t in r["narrative"]) == [f"happensAt(gap_end(v),{t})" for t in (10, 12, 15)]


def test_time_stream_of_early_rows_and_later_intervals(spark, tmp_path):
    schema = "seq bigint, hle string, vessels array<string>, value string, stime bigint, etime bigint"
    intervals = spark.createDataFrame([(1, "gap", ["v"], "nearPorts", 11, 40), (2, "gap", ["w"], "nearPorts", 14, 30)], schema)

    def micro(*times):
        return spark.createDataFrame([(t, "gap_end", t, "v", None) for t in times], "seq bigint, lle string, time bigint, vessel string, area string")

    def atoms(*epochs):
        root = tempfile.mkdtemp(dir=tmp_path)
        places = (intervals, BatchOptions(size=2, target_events=("gap",)), f"{root}/state", f"{root}/out")
        for epoch, times in enumerate(epochs):
            TimeBatchStream(spark, *places).process(micro(*times), epoch)
        TimeBatchStream(spark, *places).finish()
        got = spark.read.parquet(f"{root}/out/batches").collect()
        return sorted((r["batch_id"], a) for r in got for a in r["annotation"] + r["narrative"])

    whole, cut = atoms((10, 12, 15, 21)), atoms((10, 12), (15, 21))
    assert whole == cut and any("(w" in a or ",w" in a or "w)" in a for _, a in whole)
    assert (0, "happensAt(gap_end(v),-3)") in atoms((-3,), (10, 12))


def test_merge_follows_the_sort_column(spark, tmp_path):
    rows = [(t, 0, 9 - t, [], [f"t{t}"], "d") for t in range(5)]
    stored = spark.createDataFrame(rows, "time long, part long, rank long, annotation array<string>, narrative array<string>, dataset string")
    writers.write_examples(stored, str(tmp_path))
    for sort_by, want in (("rank", [4, 3, 2, 1, 0]), (None, [0, 1, 2, 3, 4])):
        options = StoredInput(str(tmp_path), ("d",), chunk_size=9, sort_by=sort_by)
        assert tables.training_examples(spark, options).first()["narrative"] == [f"t{t}" for t in want]


def test_open_end_is_listed_up_to_the_last_point(spark):
    points = spark.createDataFrame([(t,) for t in (10, 20, 5000)], "time long")
    rows = [("open", 15, 1 << 40), ("early", -(1 << 40), 11), ("touching", 10, 20), ("apart", 6000, 7000)]
    intervals = spark.createDataFrame(rows, "hle string, stime long, etime long")
    got = {(r["hle"], r["time"]) for r in I.contain_join(points, intervals).collect()}
    assert got == {("open", 20), ("open", 5000), ("early", 10)}
    assert I.contain_join(points.limit(0), intervals).count() == 0


def test_last_batch_ends_behind_its_events(spark):
    points = spark.createDataFrame([(t,) for t in (-5, None, 1, 3_000_000_000, 3_000_000_001)], "time long")
    bounds = batching.batch_bounds(batching.batch_times(batching.rank_times(points), 2))
    assert [tuple(r)[:3] for r in bounds.orderBy("batch_id").collect()] == [(0, 0, 3_000_000_000), (1, 3_000_000_000, 3_000_000_002)]
    assert {r["time"] for r in batching.early_points(points).collect()} == {-5, None}


def test_many_parts_under_one_time(spark):
    rows = spark.range(9_000).selectExpr("'a' AS dataset", "7L AS time", "id AS part", "array(string(id)) AS annotation", "array('n') AS narrative")
    got = examples.merge_chunks(rows, 4_000).orderBy("chunk").collect()
    assert [int(a) for r in got for a in r["annotation"]] == list(range(9_000))
    assert [len(r["narrative"]) for r in got] == [4_000, 4_000, 1_000]


def test_slices_follow_the_shared_prefix(spark):
    names = spark.createDataFrame([(f"a/long/shared/prefix/{i:05}.csv",) for i in range(500)], "file string")
    slices = ordering.spread_slices(names, "file", 2, 4)
    numbered = ordering.number_rows(names, ["file"], slices, name="number")
    assert [r["number"] for r in numbered.orderBy("file").collect()] == list(range(1, 501))
    assert names.select(slices[-1]).distinct().count() == 500
    assert ordering.number_rows(names.limit(0), ["file"], ordering.spread_slices(names.limit(0), "file", 2)).count() == 0


def test_few_candidates_far_from_a_long_coast(spark):
    from math import cos, pi, sin

    n = 10_000
    rough = [1 + 0.03 * ((i * 37) % 11) for i in range(n + 1)]
    ring = [(0, i, 20 * r * cos(2 * pi * i / n), 12 * r * sin(2 * pi * i / n)) for i, r in enumerate(rough)]
    segments = coast.coast_segments(spark.createDataFrame(ring, "ring long, pos long, x double, y double"))
    places = [("v", i, -60.0 + 7 * i, 35.0 - 5.3 * i) for i in range(14)] + [("v", 99, 23.0, 0.02), ("w", 5, None, 3.0)]
    positions = spark.createDataFrame(places, "vessel string, time long, lon double, lat double")
    counts = coast.candidate_segments(positions, segments, cell=0.05).groupBy("cx", "cy").count().collect()
    assert len(counts) == 15 and max(r["count"] for r in counts) < 100
    listed = [tuple(r) for r in segments.select("x1", "y1", "x2", "y2").collect()]

    def plain(lon, lat):
        best = None
        for x1, y1, x2, y2 in listed:
            dx, dy = x2 - x1, y2 - y1
            u = max(0.0, min(1.0, ((lon - x1) * dx + (lat - y1) * dy) / (dx * dx + dy * dy)))
            near = ((lon - x1 - u * dx) ** 2 + (lat - y1 - u * dy) ** 2, y1 + u * dy, x1 + u * dx)
            best = near if best is None or near < best else best
        return best

    got = {r["time"]: r["dist_m"] for r in coast.coast_distance(positions, segments).collect() if r["vessel"] == "v"}
    from math import asin, radians, sqrt

    for _, time, lon, lat in places[:-1]:
        _, ny, nx = plain(lon, lat)
        h = sin(radians(ny - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(ny)) * sin(radians(nx - lon) / 2) ** 2
        assert abs(got[time] - 2 * 6372.8 * asin(sqrt(h)) * 1000) < 1e-3
