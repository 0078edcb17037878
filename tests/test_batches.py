"""Mini-batches against hand-checked batches and against a loop over the events."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import BatchOptions
from tidemark.operators import batching, intervals as I
from tidemark.plans import vessel_batches as V
from tidemark.session import stage_in

POINTS = "seq bigint, lle string, time bigint, vessel string, area string"
INTERVALS = "seq bigint, hle string, vessels array<string>, value string, stime bigint, etime bigint"
INF = 2_000_000_000
GOLDEN_POINTS = [
    (10, "gap_start", "v1"),
    (12, "stop_start", "v2"),
    (12, "change_in_heading", "v1"),
    (15, "gap_end", "v1"),
    (20, "stop_end", "v2"),
    (21, "gap_start", "v3"),
    (21, "gap_start", "v4"),
]
GOLDEN_INTERVALS = [
    ("rendezVous", ["v1", "v2"], "true", 11, 16),
    ("stopped", ["v2"], "true", 12, 20),
    ("lowSpeed", ["v3"], "true", 5, 9),
]


def frames(spark, points, intervals):
    rows = [(i, name, time, vessel, None) for i, (time, name, vessel) in enumerate(points)]
    spans = [(i, *interval) for i, interval in enumerate(intervals)]
    return spark.createDataFrame(rows, POINTS), spark.createDataFrame(spans, INTERVALS)


def run(spark, points, intervals, options):
    """{batch start: sorted (time, name, first vessel)} and {batch start: time points}."""
    batches = V.build_batches(*frames(spark, points, intervals), options, stage=stage_in(spark))
    atoms = {r["batch_start"]: [] for r in batches.bounds.collect()}
    for r in V.example_atoms(batches).where("side = 0").select("batch_start", "time", "name").collect():
        atoms[r["batch_start"]].append((r["time"], r["name"]))
    times = {}
    for r in batches.times.collect():
        times.setdefault(r["batch_start"], []).append(r["time"])
    return {k: sorted(v) for k, v in atoms.items()}, {k: sorted(v) for k, v in times.items()}


def loop(points, intervals, size, closed=False, drop_tail=True):
    """The same, one event after the other."""
    source = list(points)
    carried, at, start, atoms, times = [], 0, 0, {}, {}
    point_like = set(BatchOptions().point_events)
    while at < len(source) or (carried and not drop_tail):
        seen, current, carried = {start}, carried, []
        while len(seen) <= size and at < len(source):
            time, name, _ = source[at]
            at += 1
            seen.add(time)
            (carried if len(seen) > size else current).append((time, name))
        more = at < len(source) or (carried and not drop_tail)
        stop = max(seen) if more else INF
        seen.add(stop)
        meets = [
            i
            for i in intervals
            if (i[3] <= stop and i[4] >= start if closed else i[3] < stop and i[4] > start)
        ]
        found = list(current)
        for i in meets:
            if i[3] >= start:
                found.append((i[3], i[0]))
                if i[0] in point_like:
                    seen.add(i[3])
        inner = sorted(seen)[-2]
        for i in meets:
            if i[4] <= inner:
                found.append((i[4], i[0]))
                if i[0] in point_like:
                    seen.add(i[3])
        for t in sorted(seen)[:-1]:
            found += [(t, i[0]) for i in meets if i[3] < t < i[4]]
        atoms[start], times[start] = sorted(found), sorted(seen)
        start = stop
    return atoms, times


def test_batches_of_two(spark):
    atoms, times = run(spark, GOLDEN_POINTS, GOLDEN_INTERVALS, BatchOptions(size=2))
    assert times == {0: [0, 5, 10, 12], 12: [12, 15, 20], 20: [20, 21, INF]}
    assert atoms[0] == [(5, "lowSpeed"), (9, "lowSpeed"), (10, "gap_start"), (11, "rendezVous")]
    assert atoms[12] == [
        (12, "change_in_heading"),
        (12, "rendezVous"),
        (12, "stop_start"),
        (12, "stopped"),
        (15, "gap_end"),
        (15, "rendezVous"),
        (15, "stopped"),
    ]
    assert atoms[20] == [(20, "stop_end"), (21, "gap_start"), (21, "gap_start")]


def test_batches_of_three_keep_the_stale_time(spark):
    atoms, times = run(spark, GOLDEN_POINTS, GOLDEN_INTERVALS, BatchOptions(size=3))
    assert times == {0: [0, 5, 10, 12, 15], 15: [12, 15, 20, 21, INF]}
    assert (12, "rendezVous") in atoms[0] and (12, "rendezVous") in atoms[15]
    _, fresh = run(spark, GOLDEN_POINTS, GOLDEN_INTERVALS, BatchOptions(size=3, stale_times=False))
    assert fresh[15] == [15, 20, 21, INF]


def test_closed_ends(spark):
    atoms, times = run(spark, GOLDEN_POINTS, GOLDEN_INTERVALS, BatchOptions(size=2, closed=True))
    assert (12, "stopped") in atoms[0] and (20, "stopped") in atoms[20]
    assert times[20] == [12, 20, 21, INF]


def test_dangling_tail(spark):
    points = [*GOLDEN_POINTS[:-1], (30, "gap_end", "v3")]
    dropped = BatchOptions(size=3, drop_dangling_tail=True)
    atoms, times = run(spark, points, GOLDEN_INTERVALS, dropped)
    assert times[15] == [12, 15, 20, 21, 30, INF]
    assert (30, "gap_end") not in atoms[15] and set(atoms) == {0, 15}
    atoms, _ = run(spark, points, GOLDEN_INTERVALS, BatchOptions(size=3))
    assert atoms[30] == [(30, "gap_end")]


@pytest.mark.parametrize("seed", range(6))
def test_same_as_the_loop(spark, seed):
    draw = random.Random(seed)
    names = ["gap_start", "gap_end", "stop_start"]
    points = sorted(
        (draw.randint(1, 40), draw.choice(names), f"v{draw.randint(1, 3)}")
        for _ in range(draw.randint(1, 30))
    )
    intervals = []
    for _ in range(draw.randint(0, 12)):
        begin = draw.randint(0, 45)
        name = draw.choice(["rendezVous", "stopped", "lowSpeed"])
        vessels = ["v1", "v2"] if name == "rendezVous" else ["v3"]
        intervals.append((name, vessels, "true", begin, begin + draw.randint(0, 20)))
    size, closed, drop = draw.randint(1, 6), seed % 2 == 1, seed % 3 == 0
    options = BatchOptions(size=size, closed=closed, drop_dangling_tail=drop, bucket_seconds=8)
    intervals = intervals or [("stopped", ["v9"], "true", 3, 4)]
    assert run(spark, points, intervals, options) == loop(points, intervals, size, closed, drop)


def test_examples_text_and_order(spark):
    points = [(10, "gap_end", "v1"), (10, "gap_start", "v2"), (11, "gap_end", "v3")]
    intervals = [("rendezVous", ["a", "b"], "near", 5, 12)]
    options = BatchOptions(size=10)
    row = V.batch_examples(V.build_batches(*frames(spark, points, intervals), options), options).first()
    assert row["narrative"] == [
        "happensAt(gap_end(v1),10)",
        "happensAt(gap_end(v3),11)",
        "happensAt(gap_start(v2),10)",
    ]
    assert row["annotation"] == [
        "holdsAt(rendezVous(a,b,near),5)",
        "holdsAt(rendezVous(b,a,near),5)",
        "holdsAt(rendezVous(a,b,near),10)",
        "holdsAt(rendezVous(b,a,near),10)",
        "holdsAt(rendezVous(a,b,near),11)",
        "holdsAt(rendezVous(b,a,near),11)",
    ]


def test_noise(spark):
    points = [(10, "gap_end", "v1"), (12, "gap_end", "v2")]
    intervals = [("stopped", ["v1"], "true", 5, 20), ("rendezVous", ["v1", "v2"], "true", 5, 20)]
    coords = spark.createDataFrame([(10, "v1", 0.0, 0.0)], "time bigint, vessel string, lon double, lat double")
    options = BatchOptions(size=10, remove_noise=True)
    batches = V.build_batches(*frames(spark, points, intervals), options, coords)
    found = {(r["time"], r["name"]) for r in V.example_atoms(batches).collect()}
    assert (10, "gap_end") not in found and (12, "gap_end") in found
    assert (10, "stopped") not in found and (10, "rendezVous") in found and (12, "stopped") in found
    assert {r["time"] for r in batches.times.collect()} >= {10, 12}


def test_one_time_may_hold_most_rows(spark):
    hot = spark.range(20_000).selectExpr(
        "id AS seq", "'gap_end' AS lle", "CASE WHEN id % 3 = 0 THEN 77 ELSE id END AS time", "'v' AS vessel", "'' AS area"
    )
    got = batching.batch_by_times(hot, 50)
    assert got.count() == hot.where("time >= 0").count()
    sizes = got.groupBy("batch_id").agg(F.countDistinct("time").alias("n")).collect()
    last = max(r["batch_id"] for r in sizes)
    assert all(r["n"] == 50 for r in sizes if r["batch_id"] not in (0, last))


def test_overlap_and_clip(spark):
    points, intervals = frames(spark, GOLDEN_POINTS, GOLDEN_INTERVALS)
    times = batching.batch_times(batching.rank_times(points), 2)
    bounds = batching.batch_bounds(times)
    got = {(r["batch_id"], r["hle"]) for r in I.overlap_join(intervals, bounds).collect()}
    assert got == {(0, "lowSpeed"), (0, "rendezVous"), (1, "rendezVous"), (1, "stopped")}
    low, high = F.lit(0), F.lit(10)
    df = spark.createDataFrame([(2, 5), (-3, 4), (-3, 20)], "s bigint, e bigint")
    (a, b), (c, d) = (
        I.clip(F.col("s"), F.col("e"), low, high),
        I.window_clip(F.col("s"), F.col("e"), low, high),
    )
    rows = [tuple(r) for r in df.select(a, b, c, d).collect()]
    assert rows == [(2, 5, 2, 10), (0, 4, 0, 4), (0, 10, 0, 10)]
