"""The programs on small files, the stream forms, and the sinks."""

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.config import BatchOptions, FileInput, StoredInput
from tidemark.plans import programs
from tidemark.sinks import writers
from tidemark.sources import recordings as R, tables, vessels
from tidemark.streaming.minibatches import RowBatchStream, TimeBatchStream

POINT_TEXT = """\
gap_start|10|10|v1
stop_start|12|12|v2
change_in_heading|12|12|v1
coord|12|12|v1|-4.47|48.38
velocity|12|12|v1|19.3|31.4|35.5
entersArea|15|a7|v1
proximity|15|11|15|true|v1|v2
gap_end|15|15|v1
gap_end|oops|15|v1
stop_end|20
stop_end|20|20|v2
"""
INTERVAL_TEXT = """\
stopped|v2| |true|12|20
rendezVous|v1|v2|true|11|16
withinArea|v1|fishing|true|3|9
flying|v1| |true|1|2
"""


@pytest.fixture
def vessel_files(tmp_path):
    (tmp_path / "HLEs").mkdir()
    (tmp_path / "LLEs.csv").write_text(POINT_TEXT)
    (tmp_path / "HLEs" / "all.csv").write_text(INTERVAL_TEXT)
    return FileInput(str(tmp_path / "LLEs.csv"), str(tmp_path / "HLEs"), batch=BatchOptions(size=10))


def test_vessel_scans(spark, vessel_files):
    lines = vessels.read_fields(spark, vessel_files.points_path)
    points = vessels.point_events(lines).orderBy("seq").collect()
    assert [(r["lle"], r["time"], r["vessel"], r["area"]) for r in points] == [
        ("gap_start", 10, "v1", None),
        ("stop_start", 12, "v2", None),
        ("change_in_heading", 12, "v1", None),
        ("entersArea", 15, "v1", "a7"),
        ("proximity", 15, "v1,v2", None),
        ("gap_end", 15, "v1", None),
        ("stop_end", 20, "v2", None),
    ]
    assert vessels.point_rejects(lines).count() == 2
    assert [tuple(r) for r in vessels.positions(lines).collect()] == [(12, "v1", -4.47, 48.38)]
    spans = vessels.read_fields(spark, vessel_files.intervals_path)
    assert {tuple(r["vessels"]) for r in vessels.interval_events(spans).collect()} == {
        ("v2",),
        ("v1", "v2"),
        ("v1", "fishing"),
    }
    assert [r["fields"][0] for r in vessels.interval_rejects(spans).collect()] == ["flying"]
    with pytest.raises(PySparkException):
        vessels.interval_events(spans, strict=True).collect()


def test_vessel_program(spark, vessel_files, tmp_path):
    row = tables.read_input("vessel_files", spark, vessel_files).first()
    assert "happensAt(entersArea(v1,a7),15)" in row["narrative"]
    assert "happensAt(proximity(v1,v2),15)" in row["narrative"]
    assert "holdsAt(rendezVous(v2,v1),12)" in row["annotation"]
    out = str(tmp_path / "documents")
    programs.write_vessel_documents(spark, vessel_files, out)
    documents = {r["time"]: r for r in spark.read.parquet(out).collect()}
    assert documents[10]["narrative"] == ["happensAt(gap_start(v1),10)"]
    assert set(documents) == {10, 11, 12, 15, 16, 20}


def test_one_ring_on_one_line_is_read_by_several_tasks(spark, tmp_path):
    n = 60_000
    ring = [(i / 1000, -i / 3000) for i in range(n)]
    (tmp_path / "coast.txt").write_text("POLYGON ((" + ", ".join(f"{x} {y}" for x, y in ring) + "), (1 1, 2 2))\n")
    (tmp_path / "more.txt").write_text("POLYGON ((7 7, 8 8))\nPOLYGON ((9 9, 10 10))\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        path = str(tmp_path)
        assert spark.read.option("lineSep", ",").text(path).rdd.getNumPartitions() > 4
        rows = vessels.coastline_vertices(spark, path).orderBy("ring", "pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rings = {}
    for r in rows:
        rings.setdefault(r["ring"], []).append((r["pos"], r["x"], r["y"]))
    by_size = sorted(rings.values(), key=lambda v: (-len(v), v))
    assert [(x, y) for _, x, y in by_size[0]] == ring and [p for p, _, _ in by_size[0]] == list(range(n))
    assert [[v[1] for v in ring] for ring in by_size[1:]] == [[1.0, 2.0], [7.0, 8.0], [9.0, 10.0]]


def test_coastline_text(spark, tmp_path):
    (tmp_path / "coast.txt").write_text("MULTIPOLYGON (((0 0, 1 0.5, 1e0 -2)), ((5 5, 6 6)))\n")
    rows = vessels.coastline_vertices(spark, str(tmp_path / "coast.txt")).orderBy("ring", "pos").collect()
    assert [(r["x"], r["y"]) for r in rows] == [(0, 0), (1, 0.5), (1, -2), (5, 5), (6, 6)]
    assert len({r["ring"] for r in rows}) == 2


@pytest.fixture
def recording_folders(tmp_path):
    files = {
        "2-walk/v2MovementIndv.pl": "% made. by hand\nhappensAt( walking( id1 ), 0 ).\nhappensAt( active( id2 ),\n 40 ). holdsAt( orientation( id1 )=7, 40 ).\n",
        "2-walk/v2SituationGrp.pl": "happensAt( interacting( grp_ID0, [ id1, id2 ]), 40 ).\n",
        "2-walk/notes.txt": "happensAt( running( id9 ), 0 ).\n",
        "10-run/v10MovementIndv.pl": "happensAt( running( id1 ), 80 ).\nhappensAt( flying( id1 ), 80 ).\n",
        "10-run/v10AppearenceIndv.pl": "holdsAt( appearance( id1 )=visible, 80 ).\n",
    }
    for name, text in files.items():
        path = tmp_path / "videos" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "videos")


def test_recordings(spark, recording_folders, tmp_path):
    lines = R.read_lines(spark, recording_folders)
    got = {(r["video"], r["statement"]) for r in R.statements(lines).collect()}
    assert (2, "happensAt(active(id2),40)") in got and len(got) == 7
    assert not any("id9" in s or "hand" in s for _, s in got)
    assert [tuple(r) for r in R.numbered_videos(lines).orderBy("number").select("video", "number").collect()] == [(2, 1), (10, 2)]

    out = str(tmp_path / "all")
    programs.write_recordings(spark, recording_folders, out)
    documents = {r["time"]: r for r in spark.read.parquet(out).collect()}
    assert set(documents) == {0, 40, 160}
    assert documents[40]["annotation"] == ["holdsAt(meeting(id1,id2),40)", "holdsAt(meeting(id2,id1),40)"]
    assert set(documents[160]["narrative"]) == {"holdsAt(visible(id1),160)", "happensAt(running(id1),160)"}

    out = str(tmp_path / "each")
    programs.write_recordings_per_video(spark, recording_folders, out)
    rows = {(r["dataset"], r["time"]): r for r in spark.read.parquet(out).collect()}
    assert set(rows) == {("video-1-meeting", 0), ("video-1-meeting", 40), ("video-2", 80)}
    assert rows[("video-1-meeting", 0)]["annotation"] == ["holdsAt(meeting(id1,id2),40)", "holdsAt(meeting(id2,id1),40)"]
    assert rows[("video-1-meeting", 40)]["annotation"] == []

    out = str(tmp_path / "same")
    programs.write_recordings_per_video(spark, recording_folders, out, shifted=False)
    rows = {(r["dataset"], r["time"]): r for r in spark.read.parquet(out).collect()}
    assert len(rows[("video-1-meeting", 40)]["annotation"]) == 2

    sizes = {r["video"]: r["size"] for r in programs.recording_sizes(spark, recording_folders).collect()}
    assert sizes == {2: 2, 10: 1, None: 3}


def test_matrix_text(spark, tmp_path):
    (tmp_path / "m").mkdir()
    zeros = ["0"] * 243
    lines = [
        " ".join(zeros + ["1", "102", "205", "321", "0", "0", "406520"]),
        " ".join(zeros + ["0"] * 7),
    ]
    (tmp_path / "m" / "S1-ADL1.dat").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "kernel")
    programs.write_matrix_text(spark, str(tmp_path / "m"), out)
    want = [
        "0 happensAt(stand(s1),0) happensAt(reach(s1,cup),0) happensAt(open(s1,fridge),0) holdsAt(coffee_time(s1),0)",
        "1 ",
    ]
    assert [r["value"] for r in spark.read.text(out).collect()] == want
    programs.write_matrix_text(spark, str(tmp_path / "m"), out)
    assert spark.read.text(out).count() == 4
    programs.write_matrix_text(spark, str(tmp_path / "m"), out, mode="overwrite")
    assert spark.read.text(out).count() == 2
    with pytest.raises(ValueError):
        programs.write_matrix_text(spark, str(tmp_path / "m"), out, mode="replace")
    (tmp_path / "m" / "S2-ADL1.dat").write_text(" ".join(zeros + ["77"] + ["0"] * 6) + "\n")
    with pytest.raises(PySparkException):
        programs.write_matrix_text(spark, str(tmp_path / "m"), out)


def test_sensor_csv(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("oven,tv,Activity,timestamp\n1,0,eat,2020-03-01 00:00:10\n0,0,0,2020-03-01 00:00:11\n")
    out = str(tmp_path / "documents")
    programs.write_sensor_documents(spark, str(tmp_path / "wide.csv"), out)
    rows = [tuple(r) for r in spark.read.parquet(out).orderBy("time").collect()]
    assert rows == [
        (1583020810, ["holdsAt(eat,1583020810)"], ["happensAt(oven,1583020810)"], "sensors"),
        (1583020811, ["holdsAt(0,1583020811)"], [], "sensors"),
    ]


def test_series_blocks(spark, tmp_path):
    folders = {}
    for label, names in (("interesting", ["b.csv", "a.csv"]), ("not_interesting", ["c.csv"])):
        folder = tmp_path / label
        folder.mkdir()
        for name in names:
            (folder / name).write_text(f"time,alive,necrotic,apoptotic\n12,{name[0]},l,m\n6,g,h,k\n")
        folders[label] = str(folder)
    out = str(tmp_path / "blocks")
    programs.write_series_blocks(spark, folders, out)
    text = [r["value"] for r in spark.read.text(out).collect()]
    assert text[:9] == [
        "begin(model(1)).",
        "interesting.",
        "obs(alive,g,6).",
        "obs(necrotic,h,6).",
        "obs(apoptotic,k,6).",
        "obs(alive,a,12).",
        "obs(necrotic,l,12).",
        "obs(apoptotic,m,12).",
        "end(model(1)).",
    ]
    assert text[18:20] == ["begin(model(3)).", "not_interesting."] and len(text) == 27


def test_stored_examples(spark, tmp_path):
    frame = spark.createDataFrame(
        [(d, t, 0, [f"a{d}{t}"], []) for d in ("x", "y", "z") for t in (3, 1, 2)],
        "dataset string, time bigint, part bigint, annotation array<string>, narrative array<string>",
    )
    out = str(tmp_path / "examples")
    writers.write_examples(frame, out)
    writers.write_examples(frame, out)
    got = tables.read_examples(spark, StoredInput(out, ("z", "x"), ascending=False)).collect()
    assert [(r["dataset"], r["time"]) for r in got] == [("z", 3), ("z", 2), ("z", 1), ("x", 3), ("x", 2), ("x", 1)]
    merged = tables.read_input("stored", spark, StoredInput(out, ("x",), purpose="testing")).first()
    assert merged["annotation"] == ["ax1", "ax2", "ax3"]


POINTS = "seq bigint, lle string, time bigint, vessel string, area string"
INTERVALS = "seq bigint, hle string, vessels array<string>, value string, stime bigint, etime bigint"


def test_stream_with_late_rows_and_a_repeated_epoch(spark, tmp_path):
    intervals = spark.createDataFrame([(0, "rendezVous", ["a", "b"], "true", 11, 16)], INTERVALS)
    options = BatchOptions(size=2)

    def micro(*times):
        return spark.createDataFrame([(t, "gap_end", t, "v", None) for t in times], POINTS)

    for join_late in (False, True):
        root = tmp_path / str(join_late)
        stream = TimeBatchStream(spark, intervals, options, f"{root}/state", f"{root}/out", join_late)
        stream.process(micro(10, 12), 0)
        stream.process(micro(15, 15, 20, 11), 1)
        stream.process(micro(15, 15, 20, 11), 1)
        stream.process(micro(21), 2)
        stream.finish()
        got = {r["time"]: r["narrative"] for r in spark.read.parquet(f"{root}/out/batches").collect()}
        want = {
            0: ["happensAt(gap_end(v),10)"],
            12: [f"happensAt(gap_end(v),{t})" for t in (12, 15, 15)],
            20: ["happensAt(gap_end(v),20)", "happensAt(gap_end(v),21)"],
        }
        if join_late:
            want[12].insert(0, "happensAt(gap_end(v),11)")
        else:
            late = spark.read.parquet(f"{root}/out/late").collect()
            assert [r["time"] for r in late] == [11]
        assert got == want


def test_long_rows_of_a_stream_stand_in_small_row_groups(spark, tmp_path):
    stream = TimeBatchStream(spark, spark.createDataFrame([], INTERVALS), BatchOptions(size=2), f"{tmp_path}/state", f"{tmp_path}/out")
    atoms = F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.md5(F.concat(i.cast("string"), F.col("id").cast("string"))))
    frame = spark.range(0, 40, 1, 1).select(F.col("id").alias("batch_id"), atoms.alias("narrative"))
    stream._emit(frame, 0)
    (file,) = (tmp_path / "out" / "batches" / "epoch=0").glob("*.parquet")
    told = pq.read_metadata(file)
    assert max(told.row_group(i).total_byte_size for i in range(told.num_row_groups)) < 4 << 20
    assert spark.read.parquet(str(tmp_path / "out" / "batches")).drop("epoch").exceptAll(frame).isEmpty()


def test_row_stream(spark, tmp_path):
    stream = RowBatchStream(spark, 4, "n", str(tmp_path / "state"), str(tmp_path / "out"))
    numbers = spark.range(11).withColumnRenamed("id", "n")
    stream.process(numbers.where("n < 3"), 0)
    stream.process(numbers.where("n >= 3"), 1)
    stream.finish()
    got = spark.read.parquet(str(tmp_path / "out" / "batches")).orderBy("n").collect()
    assert [r["batch_id"] for r in got] == [i // 4 for i in range(11)]


def test_an_epoch_reads_no_closed_and_no_future_intervals(spark, tmp_path):
    wide = TimeBatchStream._SLICE
    rows = [(0, "stopped", ["v1"], "true", 5, 9), (1, "stopped", ["v1"], "true", 3 * wide, 3 * wide + 7), (2, "stopped", ["v1"], "true", 1, 90 * wide)]
    rows += [(3, "stopped", ["v2"], "true", 50 * wide, 51 * wide), (4, "stopped", ["v2"], "true", None, 7), (5, "stopped", ["v2"], "true", 8, 2)]
    intervals = spark.createDataFrame(rows, "seq long, hle string, vessels array<string>, value string, stime long, etime long")
    stream = TimeBatchStream(spark, intervals, BatchOptions(size=2), f"{tmp_path}/state", f"{tmp_path}/out")
    assert {r["seq"] for r in stream.met_intervals(0, 9).collect()} == {0, 2, 5}
    # Folders of what is over by then, or starts later, are spoiled: reading them would fail.
    for folder in ("first=0/length=0", "first=50/length=1"):
        for file in (tmp_path / "state" / "intervals" / folder).glob("*.parquet"):
            file.write_bytes(b"not a table")
    assert {r["seq"] for r in stream.met_intervals(2 * wide, 4 * wide).collect()} == {1, 2}
    with pytest.raises(Exception):
        stream.met_intervals(0, None).collect()


def test_counts_and_rejects_of_one_read(spark, vessel_files, tmp_path):
    counts = programs.write_vessel_examples(spark, vessel_files, str(tmp_path / "out"), str(tmp_path / "rejects"))
    assert counts == {"points": {"kept": 7, "rejected": 2}, "intervals": {"kept": 2, "rejected": 0}}
    read = programs.read_vessels(spark, vessel_files)
    assert read.point_rejects.count() == 2 and read.points.count() == 7
    assert spark.read.parquet(str(tmp_path / "rejects" / "points")).count() == 2
    assert spark.read.parquet(str(tmp_path / "rejects" / "early")).count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
