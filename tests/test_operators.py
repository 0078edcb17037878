"""Ordering, nesting, statements, wide rows, series, scores and geometry on small rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import atoms as A
from tidemark.functions import geo, scores, text
from tidemark.operators import (
    coast,
    examples,
    nesting,
    noise,
    ordering,
    pairing,
    series as S,
    statements as ST,
    wide as W,
)


def test_running_sum_with_a_hot_group(spark):
    draw = random.Random(1)
    rows = [(("hot" if i % 3 else f"g{i % 5}"), i * 7 % 5000, draw.randint(-4, 9)) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, seq bigint, v bigint")
    got = ordering.running_sum(
        df, F.col("v"), ["seq"], ordering.int_slices("seq", 10, 6), ["g"], "total"
    ).collect()
    seen, want = {}, {}
    for g, seq, v in sorted(rows, key=lambda r: r[1]):
        seen[g] = seen.get(g, 0) + v
        want[(g, seq)] = seen[g]
    assert {(r["g"], r["seq"]): r["total"] for r in got} == want


@pytest.mark.parametrize("following", [False, True])
def test_neighbour_value_across_slices(spark, following):
    times = sorted(random.Random(2).sample(range(100_000), 400))
    df = spark.createDataFrame([(t, None if t % 4 == 0 else t * 2) for t in times], "time bigint, v bigint")
    got = ordering.neighbour_value(
        df, F.col("v"), F.col("time"), ordering.int_slices("time", 12, 6), [], "near", following
    ).collect()
    shift = 1 if following else -1
    for r in got:
        at = times.index(r["time"]) + shift
        near = times[at] if 0 <= at < len(times) else None
        assert r["near"] == (None if near is None or near % 4 == 0 else near * 2)


def test_large_groups_are_split_and_whole(spark):
    rows = [("hot", A.NARRATIVE if i % 2 else A.ANNOTATION, i % 3, i) for i in range(1000)]
    rows += [(f"small{i}", A.NARRATIVE, 0, i) for i in range(20)]
    atoms = spark.createDataFrame(rows, "k string, role string, place int, seq bigint").withColumn(
        "atom", F.concat("k", F.lit("-"), F.col("seq").cast("string"))
    )
    got = nesting.nest_examples(atoms, ["k"], ["place", "seq"], max_atoms=100).orderBy("k", "part").collect()
    hot = [r for r in got if r["k"] == "hot"]
    assert len(hot) > 5 and max(len(r["annotation"]) + len(r["narrative"]) for r in hot) <= 200
    ordered = sorted(((p, s, role) for _, role, p, s in rows[:1000]))
    for role in (A.ANNOTATION, A.NARRATIVE):
        assert [a for r in hot for a in r[role]] == [f"hot-{s}" for _, s, x in ordered if x == role]
    assert all(r["part"] == 0 and len(r["narrative"]) == 1 for r in got if r["k"] != "hot")


def test_statements(spark):
    cases = {
        "happensAt(walking(id0),40)": ["happensAt(walking(id0),40)"],
        "holdsAt(orientation(id0)=128,40)": ["orientation(id0,128,40)"],
        "holdsAt(appearance(id0)=appear,40)": ["happensAt(appear(id0),40)"],
        "holdsAt(appearance(id0)=visible,40)": ["holdsAt(visible(id0),40)"],
        "holdsAt(coord(id0)=(77,60),40)": ["coords(id0,77,60,40)"],
        "happens(interacting(grp_ID0,[id0,id2,id3]),40)": [
            f"holdsAt(meeting({a},{b}),40)"
            for a, b in (("id0", "id2"), ("id2", "id0"), ("id0", "id3"), ("id3", "id0"), ("id2", "id3"), ("id3", "id2"))
        ],
        "happensAt(leaving_object(grp_ID0,[id0,id1]),40)": ["holdsAt(leavingObject(id0,id1),40)"],
        "happensAt(moving(grid5,[id1,id1]),8)": ["holdsAt(moving(id1,id1),8)"] * 2,
        "happensAt(active(id1),8)happensAt(abrupt(id2),8)": ["happensAt(active(id1),8)", "happensAt(abrupt(id2),8)"],
        "happensAt(fighting(g,[id1]),8)": [],
        "happensAt(leaving_object(g,[id1]),8)": [],
        "happensAt(flying(id0),40)": [],
        "happensAt(walking(id0),40)junk": [],
        "": [],
    }
    df = spark.createDataFrame([(s,) for s in cases], "statement string").withColumn("key", F.col("statement"))
    atoms = ST.recording_atoms(ST.parse_statements(df)).withColumn("atom", ST.render_recording())
    got = {s: [] for s in cases}
    for r in atoms.orderBy("key", "place", "pair").collect():
        got[r["key"]].append(r["atom"])
    assert got == cases
    rejected = {r["statement"] for r in ST.rejected_statements(df).collect()}
    assert rejected == {
        "happensAt(leaving_object(g,[id1]),8)",
        "happensAt(flying(id0),40)",
        "happensAt(walking(id0),40)junk",
    }


def test_long_statement_does_not_overflow(spark):
    long = "".join(f"happensAt(walking(id{i}),{i})" for i in range(20_000))
    df = spark.createDataFrame([(long,)], "statement string")
    assert ST.parse_statements(df).count() == 20_000


def test_offsets_and_sizes(spark):
    times = [(v, t) for v, last in ((1, 100), (2, 60), (10, 20)) for t in range(0, last + 1, 20)]
    df = spark.createDataFrame(times, "video bigint, time bigint")
    assert {r["video"]: r["offset"] for r in ST.video_offsets(df).collect()} == {1: 0, 2: 140, 10: 240}
    seen = spark.createDataFrame(
        [(1, t, f"id{i}") for t in range(10) for i in range(4)] + [(2, t, "id0") for t in range(10)],
        "video bigint, time bigint, id string",
    )
    sizes = {r["video"]: r["size"] for r in ST.count_interpretations(seen).collect()}
    assert sizes == {1: 60, 2: 10, None: 70}


def test_shifted_pairs_and_names(spark):
    rows = [
        (1, 0, "narrative", "n0"),
        (1, 40, "narrative", "n40"),
        (1, 40, "annotation", "meeting"),
        (1, 80, "annotation", "moving"),
        (1, 200, "annotation", "late"),
        (2, 0, "annotation", "moving-alone"),
    ]
    atoms = spark.createDataFrame(rows, "video bigint, time bigint, role string, atom string").withColumn(
        "seq", F.monotonically_increasing_id()
    )
    for limit in (1000, 1):
        docs = pairing.shift_pairs(atoms, ["video"], ["seq"], max_atoms=limit)
        got = {}
        for r in docs.orderBy("part").collect():
            old = got.setdefault((r["video"], r["time"]), ([], []))
            got[(r["video"], r["time"])] = (old[0] + r["annotation"], old[1] + r["narrative"])
        assert got == {
            (1, 0): (["meeting"], ["n0"]),
            (1, 40): (["moving"], ["n40"]),
            (1, 80): ([], []),
            (1, 200): ([], []),
            (2, 0): ([], []),
        }
    named = pairing.activity_flags(docs, ["video"]).select(
        "video", pairing.dataset_name(F.concat(F.lit("video-"), "video")).alias("n")
    )
    assert {r["video"]: r["n"] for r in named.collect()} == {1: "video-1-meeting-moving", 2: "video-2"}


def stored(spark):
    rows = [
        (d, t, 0, [f"holdsAt(x(a),{t})", f"holdsAt(y(a),{t})"], [f"happensAt(z(a),{t})"])
        for d, n in (("a", 5), ("b", 2))
        for t in range(10, 10 * n + 1, 10)
    ]
    return spark.createDataFrame(
        rows, "dataset string, time bigint, part bigint, annotation array<string>, narrative array<string>"
    )


def test_chunks_and_target(spark):
    kept = examples.keep_target(stored(spark), "x(")
    got = examples.merge_chunks(kept, 2).orderBy("dataset", "time").collect()
    assert [(r["dataset"], r["time"], r["annotation"], len(r["narrative"])) for r in got] == [
        ("a", 10, ["holdsAt(x(a),10)", "holdsAt(x(a),20)"], 2),
        ("a", 30, ["holdsAt(x(a),30)", "holdsAt(x(a),40)"], 2),
        ("a", 50, ["holdsAt(x(a),50)"], 1),
        ("b", 10, ["holdsAt(x(a),10)", "holdsAt(x(a),20)"], 2),
    ]
    down = examples.merge_chunks(kept, 2, ascending=False).where("dataset = 'a'").collect()
    assert sorted(r["time"] for r in down) == [10, 30, 50]
    assert examples.merge_chunks(kept, 1) is kept


def test_merge_all_in_parts(spark):
    whole = examples.merge_all(stored(spark)).where("dataset = 'a'").first()
    assert (whole["time"], whole["part"], len(whole["annotation"])) == (10, 0, 10)
    parts = examples.merge_all(stored(spark), max_atoms=4).where("dataset = 'a'").orderBy("part").collect()
    assert len(parts) > 1
    assert [a for p in parts for a in p["annotation"]] == whole["annotation"]


MATRIX = "subject string, time bigint, " + ", ".join(f"{c} string" for c in W.MATRIX_COLUMNS)


def test_matrix_atoms(spark):
    rows = [
        ("s1", 0, "1", "102", "205", "321", "0", "0", "406520"),
        ("s1", 1, "0", "0", "206", "320", "406", "520", "406520"),
        ("s1", 2, "77", "0", "0", "0", "0", "0", "0"),
    ]
    labelled = W.label_lookup(spark.createDataFrame(rows, MATRIX), W.code_dictionary(spark), list(W.MATRIX_COLUMNS))
    got = {r["time"]: r["atoms"] for r in W.matrix_atoms(labelled).collect()}
    assert got[0] == [
        "happensAt(stand(s1),0)",
        "happensAt(reach(s1,cup),0)",
        "happensAt(open(s1,fridge),0)",
        "holdsAt(coffee_time(s1),0)",
    ]
    assert got[1] == ["happensAt(open(s1,fridge),1)"]
    assert [r["time"] for r in W.unknown_codes(labelled, list(W.MATRIX_COLUMNS)).collect()] == [2]


def test_sensor_documents(spark):
    wide = spark.createDataFrame([("1", "0", "3", "eat", 7)], "oven string, tv string, door string, Activity string, time bigint")
    row = W.sensor_documents(wide, ["oven", "tv", "door"], "Activity").first()
    assert row["annotation"] == ["holdsAt(eat,7)"]
    assert row["narrative"] == ["happensAt(door,7)", "happensAt(oven,7)"]


def test_series(spark):
    df = spark.createDataFrame(
        [("m", t, a, "n", "p") for t, a in ((6, "g"), (7, "g"), (70, "h"), (71, "h"), (200, "g"))],
        "model_id string, time bigint, alive string, necrotic string, apoptotic string",
    )
    first = S.observations(df).where("time = 6").orderBy("place").collect()
    assert [r["atom"] for r in first] == ["obs(alive,g,6)", "obs(necrotic,n,6)", "obs(apoptotic,p,6)"]
    changes = S.state_changes(df, ["model_id"], ordering.int_slices("time", 4))
    assert sorted(r["time"] for r in changes.collect()) == [6, 70, 200]


def test_scores(spark):
    rows = [(48, 0, 182, 182), (10, 5, 20, 20), (0, 5, 20, 20), (5, 5, 20, 0), (1, 9, 20, 20), (0, 0, 20, 20)]
    df = spark.createDataFrame(rows, "tp bigint, fp bigint, ptp bigint, pfp bigint")
    gain = scores.normalised_gain(*(F.col(c) for c in df.columns))
    got = [r[0] for r in df.select(gain).collect()]
    assert got[0] == pytest.approx(0.26373626373626374)
    assert got[1] == pytest.approx(0.20751874963942185)
    assert got[2:5] == [0, 0, 0] and got[5] is None
    raw = scores.information_gain(F.col("tp"), scores.precision(F.col("tp"), F.col("fp")), F.lit(0.5))
    assert df.select(raw).first()[0] == pytest.approx(33.27106466687737)


def haversine(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2
    a += math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6372.8 * math.asin(math.sqrt(a))


def test_haversine(spark):
    df = spark.createDataFrame([(36.12, -86.67, 33.94, -118.40), (0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.haversine_km(*(F.col(c) for c in "abcd"))).collect()]
    assert got == pytest.approx([2887.2599506071106, 111.22634257109463])


def test_coast_distance_is_exact(spark):
    draw = random.Random(3)
    shore = [(-5 + i * 0.03, 48 + draw.random() * 0.2) for i in range(40)] + [(20.0, 60.0), (25.0, 41.0)]
    places = [(-4.5 + draw.random(), 47.5 + draw.random()) for _ in range(30)]
    places += [(draw.uniform(-180, 180), draw.uniform(-80, 80)) for _ in range(30)]
    vertices = spark.createDataFrame([(0, i, x, y) for i, (x, y) in enumerate(shore)], "ring bigint, pos bigint, x double, y double")
    coords = spark.createDataFrame([(i, "v", x, y) for i, (x, y) in enumerate(places)], "time bigint, vessel string, lon double, lat double")
    got = {r["time"]: r["dist_m"] for r in coast.coast_distance(coords, coast.coast_segments(vertices)).collect()}
    assert len(got) == len(places)
    for i, (x, y) in enumerate(places):
        best = None
        for (x1, y1), (x2, y2) in zip(shore, shore[1:]):
            dx, dy = x2 - x1, y2 - y1
            u = max(0, min(1, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
            nx, ny = x1 + u * dx, y1 + u * dy
            best = min(best or (1e18, 0), ((x - nx) ** 2 + (y - ny) ** 2, haversine(y, x, ny, nx) * 1000))
        assert got[i] == pytest.approx(best[1], rel=1e-9)


def test_noise_by_distance(spark):
    points = spark.createDataFrame([(i, "e", i, "v") for i in range(500)], "seq bigint, lle string, time bigint, vessel string")
    near = points.select("vessel", "time", F.lit(5_000.0).alias("dist_m"))
    assert noise.drop_far_from_coast(points, near).count() == 500
    far = points.select("vessel", "time", F.lit(20_000.0).alias("dist_m"))
    kept = noise.drop_far_from_coast(points, far)
    assert 150 < kept.count() < 350
    assert kept.exceptAll(noise.drop_far_from_coast(points, far)).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("S1-ADL1.dat", "12-walk", "2020-03-01 00:00:10")], "f string, d string, t string")
    row = df.select(
        text.subject_name(F.col("f")),
        text.folder_number(F.col("d")),
        text.epoch_seconds(F.col("t")),
        text.epoch_seconds(F.col("t"), "America/New_York"),
        A.capitalised(F.lit("gap_End")),
        A.render_mln(F.lit("gap_end"), F.array(F.lit("v1")), F.lit(7)),
    ).first()
    assert tuple(row) == ("s1", 12, 1583020810, 1583020810 + 5 * 3600, "Gap_End", "HappensAt(Gap_end_v1,7)")
