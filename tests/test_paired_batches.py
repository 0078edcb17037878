"""Batches from paired interval ends: equal rows however they are put together, noise lists, lookups over gaps."""

import hashlib
from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.config import BatchOptions, FileInput
from tidemark.operators import batching, intervals as I, nesting, noise, ordering
from tidemark.plans import programs, vessel_batches as V
from tidemark.session import stage_in
from workload.queries import OPTIONS as QUERY_OPTIONS, QUERIES, _batches

FAR = 5_000_000_000


def events(spark):
    names = ["gap_end", "stop_start", "lowSpeed"]
    rows = [(i, names[i % 3], i // 2, f"v{i % 4}", None) for i in range(90)]
    rows += [(90 + i, "stop_end", FAR + 40 * i, "v1", None) for i in range(7)]
    return spark.createDataFrame(rows, "seq long, lle string, time long, vessel string, area string")


def spans(spark):
    rows = [(i, ["rendezVous", "stopped", "lowSpeed"][i % 3], ["v1", "v2"] if i % 3 == 0 else [f"v{i % 4}"], "true", i, i + (i * 7) % 23) for i in range(40)]
    rows += [(40, "stopped", ["v1"], "near", -5, 9 * FAR), (41, "rendezVous", ["v3", "v1"], "true", 44, FAR + 41), (42, "stopped", ["v2"], "true", FAR, FAR + 80), (43, "lowSpeed", ["v0"], "true", 9, 3)]
    return spark.createDataFrame(rows, "seq long, hle string, vessels array<string>, value string, stime long, etime long")


OPTIONS = BatchOptions(size=5, point_events=("gap_end", "stop_start", "stop_end", "stopped", "lowSpeed"), target_events=("rendezVous",))


def plain_pairs(bounds, intervals, closed):
    def meets(b, i):
        if closed:
            return i["stime"] <= b["batch_end"] and i["etime"] >= b["batch_start"]
        return i["stime"] < b["batch_end"] and i["etime"] > b["batch_start"]

    return sorted((b["batch_id"], i["seq"]) for b in bounds for i in intervals if meets(b, i))


def test_overlaps_over_gaps_and_open_ends(spark):
    for width in (4, 4096):
        for closed in (False, True):
            bounds = batching.batch_bounds(batching.batch_times(batching.rank_times(events(spark)), 5))
            found = I.overlap_join(spans(spark), bounds, closed, width)
            assert sorted((r["batch_id"], r["seq"]) for r in found.collect()) == plain_pairs(bounds.collect(), spans(spark).collect(), closed)
    nothing = I.overlap_join(spans(spark), batching.batch_bounds(batching.batch_times(batching.rank_times(events(spark).limit(0)), 5)))
    assert nothing.count() == 0


def test_values_are_carried_over_slices(spark):
    rows = [(n, None if n % 5 else n) for n in (0, 1, 5, 7, 4095, 4096, 9000, 1 << 30, (1 << 30) + 1, -3, -10)]
    carried = ordering.carry_forward(spark.createDataFrame(rows, "at long, v long"), F.col("v"), "at", shift=4)
    got = {r["at"]: r["carried"] for r in carried.collect()}
    last, want = None, {}
    for at, v in sorted(rows):
        want[at] = last
        last = v if v is not None else last
    assert got == want


def built(spark, options=OPTIONS, **more):
    return V.build_batches(events(spark), spans(spark), options, stage=stage_in(spark), **more)


def flat(rows, *keys):
    out = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        lists = out.setdefault(tuple(r[k] for k in keys), ([], []))
        lists[0].extend(r["annotation"])
        lists[1].extend(r["narrative"])
    return out


def test_numbered_and_grouped_batches_are_equal(spark):
    for options in (replace(OPTIONS, closed=True),):
        batches = built(spark, options)
        whole = V.batch_examples(batches, options).collect()
        assert {r["part"] for r in whole} == {0}
        cut = V.batch_examples(batches, replace(options, max_atoms=7)).collect()
        assert max(len(r["annotation"]) + len(r["narrative"]) for r in cut) == 7
        assert flat(cut, "batch_id", "time") == flat(whole, "batch_id", "time")
        # Some batches are numbered, others are not.
        some = V.batch_examples(batches, replace(options, max_atoms=160)).collect()
        assert flat(some, "batch_id", "time") == flat(whole, "batch_id", "time")
        documents = V.batch_documents(batches, options).collect()
        cut = V.batch_documents(batches, replace(options, max_atoms=3)).collect()
        assert flat(cut, "batch_id", "time") == flat(documents, "batch_id", "time")
        atoms = V.example_atoms(batches).groupBy("batch_id", "time").count().collect()
        assert {(r["batch_id"], r["time"]): r["count"] for r in atoms} == {
            (r["batch_id"], r["time"]): len(r["annotation"]) + len(r["narrative"]) for r in documents
        }


def test_contained_times_like_a_loop(spark):
    batches = built(spark)
    got = sorted((r["batch_id"], r["seq"], r["time"]) for r in batches.inside.where("side = 0").collect())
    want = []
    for t in batches.inner.collect():
        for i in spans(spark).collect():
            if i["stime"] < t["time"] < i["etime"] and i["etime"] > t["batch_start"]:
                want.append((t["batch_id"], i["seq"], t["time"]))
    assert got == sorted(want)


def test_nothing_is_rendered_before_the_exchange(spark):
    frame = V._expanded(built(spark))
    text = nesting.nest_small(frame, ["batch_id"], V.EXAMPLE_ORDER)._jdf.queryExecution().executedPlan().toString()
    # Read from the top down: nothing is dealt between the grouping and the expansion of the pairs.
    above = text[: text.index("Generate")]
    assert "Exchange" not in above and "REPARTITION_BY_COL" in text


def test_noise_by_distance_is_the_same_on_both_ways(spark):
    odds = spark.createDataFrame([(f"v{v}", t, 10_000.0 * (1 + t % 4)) for v in range(3) for t in range(45)], "vessel string, time long, dist_m double")
    batches = built(spark, distances=odds)
    every = built(spark)
    left, all_of = V.batch_atoms(batches).count(), V.batch_atoms(every).count()
    assert 0 < left < all_of
    whole, cut = (flat(V.batch_examples(batches, replace(OPTIONS, max_atoms=n)).collect(), "batch_id") for n in (100_000, 7))
    assert whole == cut and sum(len(a) + len(b) for a, b in whole.values()) == left
    near = odds.withColumn("dist_m", F.lit(9_999.0))
    assert V.batch_atoms(built(spark, distances=near)).count() == all_of
    # Certain removal lets go exactly the point-like atoms at a located vessel and time.
    located = built(spark, replace(OPTIONS, remove_noise=True), coords=odds)
    keys = {(r["vessel"], r["time"]) for r in odds.collect()}
    kept = sorted((r["batch_id"], r["seq"], r["side"], r["time"]) for r in located.inside.collect())
    assert kept == sorted(
        (r["batch_id"], r["seq"], r["side"], r["time"])
        for r in every.inside.collect()
        if not (r["hle"] in OPTIONS.point_events and (r["vessels"][0], r["time"]) in keys)
    )


def test_noise_is_drawn_before_pairs_become_atoms(spark):
    odds = spark.createDataFrame([(f"v{v}", t, 10_000.0 * (1 + t % 4)) for v in range(3) for t in range(45)], "vessel string, time long, dist_m double")
    batches, every = built(spark, distances=odds), built(spark)
    chance = {(r["vessel"], r["time"]): 1 - 10_000.0 / r["dist_m"] for r in odds.collect()}

    def stays(r):
        if r["hle"] not in OPTIONS.point_events or (r["vessels"][0], r["time"]) not in chance:
            return True
        text = f"{r['vessels'][0]}|{r['time']}|{r['hle']}|{r['seq']}|0"
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32 > chance[r["vessels"][0], r["time"]]

    key = ("batch_id", "seq", "side", "time")
    kept = sorted(tuple(r[k] for k in key) for r in batches.inside.collect())
    assert kept == sorted(tuple(r[k] for k in key) for r in every.inside.collect() if stays(r))
    assert 0 < len(kept) < every.inside.count()
    # A draw takes an MD5; none stands above the expansion of the pairs.
    text = batches.inside._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in text[: text.index("Generate")].lower()


def test_atoms_are_counted_without_a_row_each(spark):
    odds = spark.createDataFrame([(f"v{v}", t, 10_000.0 * (1 + t % 4)) for v in range(3) for t in range(45)], "vessel string, time long, dist_m double")
    batches = built(spark, distances=odds)
    counts = V.atom_counts(batches)
    want = V.example_atoms(batches).groupBy("batch_id", "role", "name").count()
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))
    text = counts._jdf.queryExecution().executedPlan().toString()
    assert "explode(_inside" not in text and "explode(_inside" in want._jdf.queryExecution().executedPlan().toString()


def test_coast_file_and_spelling_reach_the_program(spark, tmp_path):
    (tmp_path / "HLEs").mkdir()
    lines = [f"gap_start|{t}|{t}|v{t % 2}" for t in range(10, 40)]
    lines += [f"coord|{t}|{t}|v{t % 2}|{0.01 if t % 2 else 40.0}|0.5" for t in range(10, 40)]
    (tmp_path / "LLEs.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "HLEs" / "all.csv").write_text("stopped|v0| |true|12|20\nstopped|v1| |true|12|20\n")
    (tmp_path / "coast.txt").write_text("POLYGON ((0 0, 0 1, -1 1, 0 0))\n")
    files = FileInput(str(tmp_path / "LLEs.csv"), str(tmp_path / "HLEs"), batch=BatchOptions(size=100))
    near = replace(files, coastline_path=str(tmp_path / "coast.txt"))

    def atoms(where):
        (row,) = programs.vessel_examples(spark, where).collect()
        return row["narrative"]

    every, kept = atoms(files), atoms(near)
    # v1 is 1 km off the coast and keeps its events; v0 is far out and loses nearly all that it has a position for.
    assert [a for a in every if "(v1)" in a] == [a for a in kept if "(v1)" in a]
    far = [a for a in kept if "(v0)" in a and "gap_start" in a]
    assert len(far) <= 2 < len([a for a in every if "(v0)" in a and "gap_start" in a])
    assert sum("stopped(v0)" in a for a in kept) < sum("stopped(v0)" in a for a in every)
    spelled = atoms(replace(files, batch=BatchOptions(size=100, spelling="predicates")))
    assert "HappensAt(Gap_start_v0,10)" in spelled and len(spelled) == len(every)


def test_located_times_go_before_intervals_are_multiplied(spark):
    times = spark.createDataFrame([(t,) for t in range(0, 60, 2)] + [(t,) for t in range(4090, 4110)], "time long")
    at = [("v0", 10), ("v0", 11), ("v1", 20), ("v1", 4095), ("v1", 4097), ("v2", 4100), ("v3", 4100)]
    located = spark.createDataFrame(at, "vessel string, time long")
    plain = noise.drop_located_intervals(I.contain_join(times, spans(spark)), located, ("stopped", "lowSpeed"))
    found = noise.contained_without_located(times, spans(spark), located, ("stopped", "lowSpeed"))
    rows = sorted((r["time"], r["seq"]) for r in found.collect())
    assert rows == sorted((r["time"], r["seq"]) for r in plain.collect())
    assert 0 < len(rows) < I.contain_join(times, spans(spark)).count()
    # Rows of the containment are not joined again: the anti join would move all of them.
    query = QUERIES["noise_interval"](spark, "/root/testdata/sf0.001")
    assert "LeftAnti" not in query._jdf.queryExecution().executedPlan().toString()


def test_whole_batches_make_no_row_per_atom(spark):
    batches = built(spark)
    uncut = replace(OPTIONS, max_atoms=None)
    whole = flat(V.batch_examples(batches, uncut).collect(), "batch_id", "time")
    cut = flat(V.batch_examples(batches, replace(OPTIONS, max_atoms=7)).collect(), "batch_id", "time")
    assert whole == cut
    documents = flat(V.batch_documents(batches, uncut).collect(), "batch_id", "time")
    assert documents == flat(V.batch_documents(batches, replace(OPTIONS, max_atoms=3)).collect(), "batch_id", "time")
    # Atoms are written inside the rows of the batches: nothing multiplies rows above the last grouping.
    text = V.batch_examples(batches, uncut)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text[: text.index("ObjectHashAggregate")]


def test_a_dense_batch_is_one_row_as_its_sql_says(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i % 40:02d}", i // 40, "view" if i % 40 < 39 else "click") for i in range(40 * 90)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    batches = _batches(spark, str(tmp_path))
    spread = [r["n"] for r in V.example_atoms(batches).groupBy("batch_id").agg(F.count("*").alias("n")).collect()]
    found = V.batch_examples(batches, QUERY_OPTIONS, stage_in(spark)).collect()
    assert [r["part"] for r in found] == [0] and [len(r["annotation"]) + len(r["narrative"]) for r in found] == spread
    assert QUERY_OPTIONS.max_atoms is None


def test_neighbouring_batches_are_dealt_together(spark):
    batches = built(spark, replace(OPTIONS, max_atoms=None, size=2))
    number = batches.bounds.count()
    assert number >= 8

    def rows(some, whole):
        out = V._gathered(some, 1, whole).select("batch_id", "batch_start", "_times", *[V._batch_list(r).alias(r) for r in ("annotation", "narrative")])
        return sorted(out.collect())

    together, alone = rows(batches, True), rows(batches, False)
    assert together == alone and len(together) == number
    assert rows(V.before(batches, 5), True) == [r for r in alone if r["batch_id"] < 5]
    # An interval moves once for several batches, and no text of atoms moves.
    dealt = [V._dealt(batches, 1, whole)._jdf.queryExecution().optimizedPlan().toString() for whole in (True, False)]
    assert all("holdsAt" not in text and "happensAt" not in text for text in dealt)
    listed = batches.spans.selectExpr("sum(floor(end / 2) - floor(begin / 2) + 1)").first()[0]
    assert listed < batches.met.count()
