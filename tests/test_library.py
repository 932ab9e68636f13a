import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import oracles, params, queries, sources
from ridgeline.operators import kernels, linking, scores, segmentation, spatial, tracks
from ridgeline.params import Params
from ridgeline.plans import run_detections, tuning
from ridgeline.sources import sinks
from ridgeline.streaming import NEEDED, link_stream

P = Params()
TABLES = "region nation customer events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(rows):
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({oracles.SQL[name]})").fetchall()
    assert plain(tuple(r) for r in got.select(columns).collect()) == plain(want)


def det(stack, z, n, x, y, width=1.0, length=10.0, area=20.0, orientation=0.0, half=2.0):
    box = (y - half, x - half, y + half, x + half) if half is not None else (None,) * 4
    return (stack, z, n, float(x), float(y), length, 1.1, width, area, orientation, *box)


SCHEMA = "stack_id int, z_slice int, sperm_id int, centroid_x double, centroid_y double, length_um_geodesic double, tortuosity double, width_um double, area_px double, orientation double, bbox_min_y double, bbox_min_x double, bbox_max_y double, bbox_max_x double"


def tracks_of(spark, rows, linker="overlap_first", p=P):
    out = linking.link(spark.createDataFrame(rows, SCHEMA), p, linker).collect()
    return {(r["z_slice"], r["sperm_id"]): r["track_no"] for r in out}


def test_linker_golden(spark):
    assert tracks_of(spark, [det(0, 0, 1, 50, 50), det(0, 2, 1, 51, 50), det(0, 5, 1, 51, 50)]) == {(0, 1): 1, (2, 1): 1, (5, 1): 2}  # a gap of one links, of two doesn't
    assert tracks_of(spark, [det(0, 0, 1, 50, 50), det(0, 1, 1, 52, 50), det(0, 1, 2, 48, 50)]) == {(0, 1): 1, (1, 1): 1, (1, 2): 2}  # a tie goes to the earlier row
    assert tracks_of(spark, [det(0, 0, 1, 50, 50), det(0, 0, 2, 54, 50), det(0, 1, 1, 53, 50)])[1, 1] == 2  # wanted by two, the nearer has it
    far, near = det(0, 1, 1, 80, 50, half=14.0), det(0, 1, 2, 50, 61, half=None)
    assert tracks_of(spark, [det(0, 0, 1, 50, 50, half=12.0), far, near])[1, 1] == 1  # overlap beats distance
    refused = [det(0, 0, 1, 50, 50, half=None), det(0, 1, 1, 51, 50, width=9.0, half=None), det(0, 2, 1, 52, 50, half=None)]
    assert tracks_of(spark, refused) == {(0, 1): 1, (1, 1): 2, (2, 1): 1}  # a refused pair leaves the track alive
    zero = [det(0, 0, 1, 50, 50, width=0.0, half=None), det(0, 1, 1, 50, 50, half=None)]
    assert tracks_of(spark, zero) == {(0, 1): 1, (1, 1): 2}
    bare = [det(0, 0, 1, 50, 50, orientation=None, half=None), det(0, 1, 1, 55, 50, orientation=None, half=None)]
    assert tracks_of(spark, bare) == {(0, 1): 1, (1, 1): 1}
    assert tracks_of(spark, []) == {}


def by_the_book(rows, p):
    """The overlap-first linker as its description says, one detection and track at a time."""
    from ridgeline.streaming import pair_score

    names = ["stack_id", "z_slice", "sperm_id", "centroid_x", "centroid_y", "length_um_geodesic", "tortuosity", "width_um", "area_px", "orientation", "bbox_min_y", "bbox_min_x", "bbox_max_y", "bbox_max_x"]
    rows = sorted((dict(zip(names, r, strict=True)) for r in rows), key=lambda r: (r["z_slice"], r["sperm_id"]))
    active, out, count = {}, {}, 0
    for z in sorted({r["z_slice"] for r in rows}):
        mine = [r for r in rows if r["z_slice"] == z]
        offers = []
        for k, r in enumerate(mine):
            for t in sorted(active):
                if 1 <= z - active[t]["z_slice"] <= p.track_max_gap_slices + 1 and (s := pair_score(active[t], r, p)) is not None:
                    offers.append((s, k, t))
        taken = {}
        for s, k, t in sorted(offers, key=lambda o: o[0]):
            if k not in taken and t not in taken.values():
                taken[k] = t
        for k, r in enumerate(mine):
            if k not in taken:
                count += 1
                taken[k] = count
            active[taken[k]] = r
            out[z, r["sperm_id"]] = taken[k]
    return out


def test_linker_equals_description(spark):
    rng = random.Random(3)
    rows = [
        det(0, z, n, rng.uniform(0, 120), rng.uniform(0, 120), rng.uniform(0.5, 1.5), rng.uniform(6, 14), rng.uniform(8, 30), rng.uniform(-1.5, 1.5), rng.uniform(1, 4))
        for z in range(8) if z != 4 for n in range(1, 26)
    ]
    got = tracks_of(spark, rows)
    assert got == by_the_book(rows, P)
    rng.shuffle(rows)
    assert tracks_of(spark, rows) == got
    for name in linking.LINKERS:
        d = linking.link(spark.createDataFrame(rows, SCHEMA), P, name)
        if name != "adjacent":
            assert linking.link_faults(d, P).isEmpty()


def test_stream_equals_batch(spark, tmp_path):
    d = sources.detections(spark, "/root/testdata/sf0.001").where("stack_id < 2 AND z_slice < 8")
    want = {r["event_id"]: r["track_no"] for r in linking.link(d, P).collect()}
    base, schema = d.select(NEEDED), d.select(NEEDED).schema
    for z in range(8):
        base.where(f"z_slice = {z}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([(s, 7, None) for s in (0, 1)], "stack_id int, z_slice int, event_id bigint")
    for c in NEEDED:
        if c not in end.columns:
            end = end.selectExpr("*", f"cast(null as {schema[c].dataType.simpleString()}) as {c}")
    end.select(NEEDED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = link_stream(rows, P).writeStream.format("memory").queryName("linked").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = {r["event_id"]: r["track_no"] for r in spark.table("linked").where("NOT late").collect()}
    assert got == want


def test_published_score(spark):
    facts = spark.createDataFrame([(2807, 1595.0, 4695.0, 4695 / 1595, 1212.0, 249.0, 57.0, 7.0, 201.0, 9.533, 10.155, 2.081)], "n_tracks bigint, multi_slice double, total_linked double, avg_depth double, single_slice double, n_long double, n_tort double, n_thick double, n_taper double, l3d_median_um double, l3d_mean_um double, zextent_median_um double")
    facts = facts.selectExpr("*", "single_slice / n_tracks as single_frac", "multi_slice / n_tracks as multi_frac", "n_long / n_tracks as long_frac")
    assert abs(scores.score_tuned(facts).first()["score"] - 1406.72) < 0.05


def test_tuning(spark, sf_dir):
    d = sources.detections(spark, sf_dir).where("z_slice < 5").persist()
    best, history = tuning.evolve(d, P, generations=1, size=1, polish=1)
    again, _ = tuning.evolve(d, P, generations=1, size=1, polish=1)
    assert best == again and len(history) == 9 + 9 + 18 and history[0]["score"] == max(h["score"] for h in history)


def test_sets_as_rows_equal_one_plan_each(spark, sf_dir):
    d = sources.detections(spark, sf_dir).where("z_slice < 8")
    sets = [P, *tuning.grid(P, {"conservative_max_width_jump_ratio": [0.4, 0.6], "track_max_dist_um": [4.0, 9.0]}), P.overlay({"track_max_gap_slices": 0, "track_bbox_padding_px": 2.0, "overlap_min_stable_count": 3, "overlap_multiplier": 1.1})]
    got = tuning.linked_by_sets(d, sets).select("set_id", "event_id", "track_no").collect()
    for i, p in enumerate(sets):
        expected = {r["event_id"]: r["track_no"] for r in linking.link(d, p).collect()}
        assert {r["event_id"]: r["track_no"] for r in got if r["set_id"] == i} == expected


def test_evaluation_is_few_jobs_and_equals_one_run_each(spark, sf_dir):
    d = sources.detections(spark, sf_dir).where("z_slice < 8")
    sets = tuning.grid(P, {"track_max_dist_um": [4.0, 9.0]})
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    got = {r["set_id"]: (r["n_tracks"], r["multi_slice"], r["n_long"], r["n_taper"]) for r in tuning.evaluate(d, sets).collect()}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before < 40
    for i, p in enumerate(sets):
        f = scores.run_facts(tracks.summarise(linking.with_track_ids(linking.link(d, p)), p).withColumn("one", F.lit(1)), ["one"]).first()
        assert got[i] == (f["n_tracks"], f["multi_slice"], f["n_long"], f["n_taper"])


def test_params():
    good = {k: list(v) if isinstance(v, tuple) else v for k, v in vars(P).items()}
    assert params.problems(good) == []
    bad = good | {"threshold_lo": 90, "run_mode": "x", "clahe_kernel": 1.5, "do_tracking": 1}
    assert len(params.problems(bad)) == 4
    assert params.problems(good | {"max_width_px": 8}) == []
    assert Params.from_json('{"TRACK_MAX_DIST_UM": 5.5, "unknown": 1}') == P.overlay({"track_max_dist_um": 5.5})


def test_sources(spark, tmp_path):
    assert sources.slices_of("3, 10-7,5,3") == [3, 5, 7, 8, 9, 10]
    image = np.zeros((4, 5), np.uint8)
    for name in ("s_z10_a.PGM", "s_z2_a.PGM", "plain.pgm"):
        (tmp_path / name).write_bytes(b"P5 5 4 255\n" + image.tobytes())
    (tmp_path / "note.txt").write_text("no image")
    files = sources.image_files(spark, str(tmp_path), "*.tif").orderBy("position").collect()
    assert [r["z_slice"] for r in files] == [0, 2, 10]
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        sources.image_files(spark, str(tmp_path / "none"))
    assert segmentation.decode((tmp_path / "plain.pgm").read_bytes()).shape == (4, 5)
    with pytest.raises(ValueError):
        segmentation.decode(b"\x89PNG....")
    df = spark.createDataFrame([(1, 2.0)], "Track_ID int, tortuosity double")
    assert sources.canonical(df).columns == ["track_id", "tortuosity_3d"]
    with pytest.raises(ValueError):
        sources.canonical(df, ["n_slices"])


def test_sinks(spark, tmp_path, sf_dir):
    t = tracks.with_audit(tracks.summarise(sources.with_cell_track(sources.detections(spark, sf_dir)), P), P)
    base = f"file://{tmp_path}/run"
    assert sinks.free_folder(spark, base) == base
    sinks.write_run({"track_summary": t.select(tracks.SUMMARY), "empty": t.select("track_id").limit(0)}, base)
    assert sinks.free_folder(spark, base) == f"{base}_1"
    schema = t.select(tracks.SUMMARY).schema.simpleString()[7:-1].replace(":", " ")
    assert sources.read_run(spark, base, "track_summary", schema).count() == t.count()
    sinks.write_by_flag(t.select("track_id", *[f"flag_{n}" for n in tracks.FLAGS]), f"{base}/flags", list(tracks.FLAGS))
    assert os.path.isdir(f"{tmp_path}/run/flags/flag=long")


def test_report_tables(spark, sf_dir):
    run = run_detections(sources.detections(spark, sf_dir), P)
    tables = run.report()
    assert tables["raw_detections"].count() == 1000 and tables["histogram_thickness_um"].count() == 20
    assert tables["funnel"].count() == 3 and run.tracks.where("nearest_neighbor_um IS NULL").count() == 0
    alone = run_detections(spark.createDataFrame([det(0, 0, 1, 5, 5)], SCHEMA), P)
    assert alone.tracks.first()["nearest_neighbor_um"] is None


def test_topology():
    line = kernels.topology(np.array([[0, i] for i in range(10)]))
    assert line["length_px_geodesic"] == 9 and abs(line["tortuosity"] - 1) < 1e-6 and line["n_endpoints"] == 2
    assert abs(kernels.topology(np.array([[i, i] for i in range(10)]))["length_px_geodesic"] - 9 * math.sqrt(2)) < 1e-9
    bend = kernels.topology(np.array([[0, i] for i in range(6)] + [[i, 5] for i in range(1, 6)]))
    assert bend["n_endpoints"] == 2 and bend["tortuosity"] > 1.2
    cross = kernels.topology(np.array([[5, i] for i in range(11)] + [[i, 5] for i in range(11) if i != 5]))
    assert cross["n_endpoints"] == 4 and cross["n_branch_nodes"] >= 1
    ring = np.array([[0, 1], [0, 2], [1, 0], [1, 3], [2, 0], [2, 3], [3, 1], [3, 2]])
    assert kernels.topology(ring)["has_loop"] and kernels.topology(ring, allow_loops=False) is None


def test_kernels():
    edge = np.zeros((6, 8), bool)
    edge[1, 7] = edge[2, 0] = True
    assert kernels.labelled(edge)[1] == 2  # rows don't wrap
    block = np.zeros((15, 15), bool)
    block[3:12, 4:11] = True
    want = np.sqrt([[min(((y - v) ** 2 + (x - u) ** 2) for v in range(15) for u in range(15) if not block[v, u]) for x in range(15)] for y in range(15)])
    assert np.allclose(kernels.distances(block), want)
    bar = np.zeros((20, 60), bool)
    bar[8:13, 5:55] = True
    thin = kernels.thinned(bar)
    assert kernels.labelled(thin)[1] == 1 and thin.sum(0).max() <= 2 and thin.sum() > 40
    assert kernels.pruned(np.pad(np.ones((1, 12), bool), 2), 3).sum() == 6
    gap = np.zeros((9, 30), bool)
    gap[4, 2:12] = gap[4, 15:25] = True
    assert kernels.labelled(kernels.bridged(gap, kernels.labelled(gap)[0], 5))[1] == 1
    inside = kernels.polygon_mask((20, 20), [(3, 3), (15, 3), (15, 15), (3, 15)])
    assert inside[5, 5] and not inside[1, 1]
    image = np.random.default_rng(0).normal(10, 1, (96, 96))
    image[40, 20:60] += 60
    image = kernels.blurred(image, 1.0)
    rows = kernels.measure(kernels.segment(image, P), P)
    assert any(abs(r["centroid_y"] - 40) < 3 and r["length_px_geodesic"] > 15 for r in rows)
    roi = np.zeros((96, 96), bool)
    roi[30:50, 15:65] = True
    assert all(roi[round(r["centroid_y"]), round(r["centroid_x"])] for r in kernels.two_pass(image, roi, P)[:1])


def test_nearest_other(spark):
    rng = random.Random(5)
    points = [(s, s * 1000 + i, rng.uniform(0, 500), rng.uniform(0, 20), rng.uniform(0, 9)) for s in (0, 1) for i in range(60)] + [(2, 5000, 1.0, 1.0, 1.0)]
    got = {r["id"]: r["nearest_um"] for r in spatial.nearest_other(spark.createDataFrame(points, "stack_id int, id int, x double, y double, z double"), first=4.0).collect()}
    for s, i, *a in points:
        others = [math.dist(a, b) for t, j, *b in points if t == s and j != i]
        assert (got[i] is None) if not others else abs(got[i] - min(others)) < 1e-9


def test_region_of_interest(spark, tmp_path):
    def stored(name, image):
        np.save(tmp_path / name, image)
        return str(tmp_path / name)

    region = np.zeros((6, 8), np.uint8)
    region[2:4, 5:8] = 255
    mask = sources.roi_mask(spark, stored("roi.npy", region), 6, 8)
    assert {(r["y"], r["x"]) for r in mask.collect()} == {(y, x) for y in (2, 3) for x in (5, 6, 7)}
    points = spark.createDataFrame([(1, 2.5, 6.5), (2, 1.4, 5.0), (3, 3.0, 99.0), (4, -7.0, 5.0), (5, None, 5.0)], "id int, centroid_y double, centroid_x double")
    assert {r["id"] for r in spatial.inside_region(points, mask, 6, 8).collect()} == {1, 3}  # half to even, and clamped
    for image in (region[:, :7], np.zeros((6, 8), np.uint8)):
        with pytest.raises(ValueError):
            sources.roi_mask(spark, stored("bad.npy", image), 6, 8)


def test_positions_by_group(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice([None, 1.0, 2.0, rng.random()]), i) for i in range(500)]
    from pyspark.sql import functions as F

    got = tracks.positions_by(spark.createDataFrame(rows, "g string, v double, i int").repartition(5), "g", F.desc_nulls_last("v"), "i").collect()
    for g in "ab":
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [r["i"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["position"])] == [r[2] for r in want]
        assert sorted(r["position"] for r in got if r["g"] == g) == list(range(1, len(want) + 1))


def test_kernels_take_lines_together(monkeypatch):
    """A blur convolves an axis at once, to the bits that line by line gives; distances are only made for rows of the mask."""
    image, calls, plain_convolve = np.random.default_rng(4).random((40, 33)), [], np.convolve
    monkeypatch.setattr(np, "convolve", lambda *a: calls.append(1) or plain_convolve(*a))
    got = kernels.blurred(image, 2.0)
    assert len(calls) == 2
    taps = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    want = image
    for axis in (0, 1):
        want = np.apply_along_axis(plain_convolve, axis, np.pad(want, [(8, 8) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric"), taps / taps.sum(), "valid")
    assert (got == want).all()
    mask = image > 0.2
    mask[3:9] = False
    y, x = np.mgrid[:40, :33]
    outside = np.argwhere(~mask)
    assert np.allclose(kernels.distances(mask), np.sqrt(((y[..., None] - outside[:, 0]) ** 2 + (x[..., None] - outside[:, 1]) ** 2).min(-1)))
    assert kernels.labelled(np.zeros((3, 4), bool))[1] == 0 and kernels.labelled(np.eye(5, dtype=bool))[1] == 1
