"""Skeletons as tables against the same skeletons as graphs."""

import heapq
import math

import numpy as np
from test_pixels import as_table, masks

from ridgeline.operators import kernels, skeletons

STEPS = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x]


def farthest(points, start):
    best, heap = {start: 0}, [(0, start)]
    while heap:
        d, (y, x) = heapq.heappop(heap)
        for dy, dx in STEPS:
            q, e = (y + dy, x + dx), d + (141421356 if dy and dx else 100000000)
            if q in points and e < best.get(q, math.inf):
                best[q] = e
                heapq.heappush(heap, (e, q))
    assert len(best) == len(points)
    return min(((-d, q) for q, d in best.items()))[1], max(best.values())


def measured(points):
    around = {(y, x): [(dy, dx) for dy, dx in STEPS if (y + dy, x + dx) in points] for y, x in points}
    ends = sorted(p for p, s in around.items() if len(s) == 1)
    counts = (len(points), len(ends), sum(len(s) > 2 for s in around.values()))
    if not ends:
        return (*counts, sum(math.hypot(*s) for n in around.values() for s in n) / 2, 1.0, True)
    a, _ = farthest(points, ends[0])
    b, d = farthest(points, a)
    return (*counts, d / 1e8, d / 1e8 / (math.dist(a, b) + 1e-9), False)


def check(spark, arrays):
    got = {(r["image"], r["label"]): tuple(r)[2:] for r in skeletons.skeleton_measures(as_table(spark, arrays)).select("image", "label", "n_pixels", "n_endpoints", "n_branch_nodes", "length_px_geodesic", "tortuosity", "has_loop").collect()}
    want = {}
    for k, m in enumerate(arrays):
        labels, n = kernels.labelled(m)
        for i in range(1, n + 1):
            want[k, i] = measured({tuple(map(int, p)) for p in np.argwhere(labels == i)})
    assert got.keys() == want.keys()
    for key, w in want.items():
        assert got[key][:3] == w[:3] and got[key][5] == w[5] and np.allclose(got[key][3:5], w[3:5], rtol=1e-7), (key, got[key], w)


def test_lengths_ends_and_rings(spark):
    check(spark, masks())


def test_rings_can_be_left_out(spark):
    ring = [(0, y, x, 1) for y in range(3) for x in range(3) if (y, x) != (1, 1)]
    table = spark.createDataFrame([*ring, (0, 9, 9, 1), (0, 9, 10, 1), (1, 4, None, 1)], "image bigint, y int, x int, value int")
    assert [(r["n_pixels"], r["length_px_geodesic"]) for r in skeletons.skeleton_measures(table, loops=False).collect()] == [(2, 1.0)]
    assert skeletons.skeleton_measures(table.limit(0)).count() == 0


def test_ways_through_many_tiles_and_batches(spark):
    spiral, y, x, turn = np.zeros((61, 61), bool), 30, 30, 0
    for leg in range(2, 12, 2):
        for _ in range(leg):
            spiral[y, x] = True
            y, x = y + (0, 1, 0, -1)[turn % 4], x + (1, 0, -1, 0)[turn % 4]
        turn += 1
    rows = [(0, int(a) - 30, int(b) + 98, 1) for a, b in np.argwhere(spiral)]  # rows above the origin too
    table = spark.createDataFrame(rows, "image bigint, y int, x int, value int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 12)
    try:
        got = skeletons.skeleton_measures(table).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1
    want = measured({(r[1], r[2]) for r in rows})
    assert abs(got[0]["length_px_geodesic"] - want[3]) < 1e-6 and (got[0]["n_endpoints"], got[0]["n_branch_nodes"]) == want[1:3]


def test_links_are_counted_in_bands(spark):
    """Pixels of several bands, dealt to a given number of tasks, count their neighbours by frames: no pixel is told to its eight neighbours."""
    runs = spark.createDataFrame([(0, y, y % 3, y % 3, 1) for y in range(130)], "image long, y int, lo int, hi int, label int")
    links = skeletons.linked_pixels(runs, 3)
    assert "sequence" in (plan := links._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(image" in plan and ", 3)" in plan
    got = {r["y"]: (r["straight"], r["slant"]) for r in links.collect()}
    assert got == {y: (0, sum(0 <= v < 130 and abs(v % 3 - y % 3) == 1 for v in (y - 1, y + 1))) for y in range(130)}


def test_objects_are_measured_in_their_band_or_as_a_whole_or_spread(spark):
    """Whatever bands, pieces and batches cut, and whether what goes on beyond a band is held by one task or spread over several, objects are the same."""
    rng = np.random.default_rng(21)
    arrays = [np.pad(rng.random((70, 33)) < share, 1) for share in (0.15, 0.3, 0.5)]
    arrays.append(np.zeros((72, 35), bool))
    arrays[3][1:71, 4] = arrays[3][30, 4:30] = arrays[3][60:63, 20:23] = True
    arrays[3][61, 21] = False
    table = as_table(spark, arrays).where("y IS NOT NULL")
    columns = ["image", "label", "n_pixels", "n_endpoints", "n_branch_nodes", "length_px_geodesic", "tortuosity", "has_loop"]
    want = {}
    for k, m in enumerate(arrays):
        labels, n = kernels.labelled(m)
        want |= {(k, i): measured({tuple(map(int, p)) for p in np.argwhere(labels == i)}) for i in range(1, n + 1)}
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for how, rows in (({"band": 16, "chunk": 50}, 19), ({"band": 100}, batch), ({"band": 16, "chunk": 7, "parts": 3}, batch), ({"band": 32, "large": 40}, batch)):
        try:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            got = {(r[0], r[1]): tuple(r)[2:] for r in skeletons.skeleton_measures(table, **how).select(columns).collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert got.keys() == want.keys()
        for key, w in want.items():
            assert got[key][:3] == w[:3] and got[key][5] == w[5] and np.allclose(got[key][3:5], w[3:5], rtol=1e-7), (how, key, got[key], w)


def test_objects_inside_a_band_are_not_dealt_again(spark, monkeypatch):
    """What ends in its band leaves the first pass as one row: no pixel or run of it is written, and no round is made."""
    written, plain = [], skeletons.settled
    monkeypatch.setattr(skeletons, "settled", lambda df: written.append(plain(df)) or written[-1])
    monkeypatch.setattr(skeletons, "farthest_pixels", None)
    rows = [(i, 10 + y, 5 + 7 * k, 1) for i in range(3) for k in range(4) for y in range(9)]
    table = spark.createDataFrame([*rows, (0, 1, 1, 1), (2, 30, 40, 1)], "image bigint, y int, x int, value int")
    assert skeletons.skeleton_measures(table).where("length_px_geodesic = 8").count() == 12
    # the first and the last row of a piece may go on in another one
    assert sum(w.count() for w in written) < 3 * len(rows) / 4


def test_pieces_hold_whole_rows_and_few_pixels():
    import pyarrow as pa

    image, lo = np.repeat(np.arange(6), 5), np.tile(np.arange(5) * 30, 6)
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in (image[k : k + 10], image[k : k + 10], lo[k : k + 10], lo[k : k + 10] * 0, lo[k : k + 10] * 0 + 24)], names=list("abcde")) for k in (0, 10, 20)]
    got = list(skeletons._pieces(iter(batches), 100, 2, pixels=lambda c: c[4] - c[3] + 1))
    assert (np.concatenate([g[2] for g in got]) == lo).all() and all(set(np.unique(g[0], return_counts=True)[1]) == {5} for g in got)
    assert len(got) >= 3 and all(len(g[0]) <= 10 for g in got)  # two objects at most
